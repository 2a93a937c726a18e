"""Files to results with a made-up extractor; the sink and the command line."""

from __future__ import annotations

import io
import os
import zipfile

from tests.test_documents import handbook

from quireflow.__main__ import main
from quireflow.plans import convert
from quireflow.sources import files as sources
from quireflow.sources import wordlist


class Plain:
    """A 'PDF' is text with form feeds between pages; a page that is only '?' has to be recognised, '!' fails."""

    def pages(self, content):
        if content.startswith(b"broken"):
            raise ValueError("damaged")
        return [{"page_no": k, "width": 612.0, "height": 792.0, "has_fonts": True, "text": t} for k, t in enumerate(content.decode().split("\f"), 1)]

    def words(self, content, page_no, route, dpi):
        text = content.decode().split("\f")[page_no - 1]
        if text == "!":
            raise ValueError("no bitmap")
        text = "Recognised words of a page." if route == "ocr" else text
        return [{"text": w, "x0": 72.0 + 40 * k, "x1": 102.0 + 40 * k, "top": 300.0, "bottom": 307.2, "size": 10.0 if route == "text" else None, "fontname": "F", "conf": 90.0, "block_num": 1, "par_num": 1, "line_num": 1} for k, w in enumerate(text.split())]


def folder(tmp_path) -> str:
    path = tmp_path / "in"
    path.mkdir()
    for name, content in {"a.docx": handbook(), "b.PDF": b"Calm body text with words.\f?\fMore calm text at the end.", "c.txt": b"x", "d.pdf": b"broken", "e.pdf": b"Text of one page here, long enough.\f!", "f.doc": b"old"}.items():
        (path / name).write_bytes(content)
    return str(path)


def test_convert(spark, tmp_path):
    files = sources.read_files(spark, folder(tmp_path))
    rows = {os.path.basename(r.doc_id): r for r in convert.convert(files, wordlist.dictionary(None, spark), Plain()).collect()}
    assert len(rows) == 6
    assert rows["a.docx"].markdown.startswith("# Harbour Atlas") and rows["a.docx"].warnings == []
    b = rows["b.PDF"]
    assert [x for x in b.markdown.split("\n") if x] == ["Calm body text with words.", "Recognised words of a page.", "More calm text at the end."]
    assert (b.stats.pages, b.stats.ocr_pages, b.stats.mean_conf, b.stats.text_layer) == (3, 1, 90.0, "partial (1 pages without)")
    assert "Unsupported" in rows["c.txt"].warnings[0] and "damaged" in rows["d.pdf"].warnings[0] and "extractor" in rows["f.doc"].warnings[0]
    assert rows["e.pdf"].markdown.strip() == "Text of one page here, long enough." and "Page 2 failed" in rows["e.pdf"].warnings[0]


def test_plans_and_attempts(spark, tmp_path):
    """Figures of the memory plan, seconds and the outcome of attempts stand in the results; a short memory is told."""
    files = sources.read_files(spark, folder(tmp_path)).where("ext = 'pdf'")
    b = files.where("doc_id like '%b.PDF'").first().doc_id
    tries = spark.createDataFrame([(b, 1, "--redo-ocr", 4, 0, "bad\nworse"), (b, 2, "--force-ocr", 10, 5, "")], convert.ATTEMPTS)
    rows = {os.path.basename(r.doc_id): r for r in convert.convert_pdfs(files, Plain(), wordlist.dictionary(None, spark), machine=convert.Machine(150.0, 4), tries=tries).collect()}
    stats = rows["b.PDF"].stats
    assert stats.outcome == "--force-ocr" and rows["e.pdf"].stats.outcome == "original" and rows["d.pdf"].stats.outcome is None
    assert stats.schedule == "sequential" and stats.preflight.startswith("file=b.PDF size=0.0MB pages=3 ") and "dpi=200" in stats.preflight and stats.seconds >= 0
    assert "instead of 300" in rows["b.PDF"].warnings[0]


class Layers(Plain):
    recognises = False


class Strict(Plain):
    def words(self, content, page_no, route, dpi):
        if route == "ocr":
            raise sources.FatalError("no language data")
        return super().words(content, page_no, route, dpi)


def test_without_recognition(spark, tmp_path):
    """Pages that nothing recognises are left out and told; an extractor's fatal error fails the document."""
    files = sources.read_files(spark, folder(tmp_path)).where("doc_id like '%b.PDF'")
    known = wordlist.dictionary(None, spark)
    left = convert.convert_pdfs(files, Layers(), known).first()
    assert "Recognised" not in left.markdown and left.warnings == ["1 page(s) without a text layer were left out: nothing here recognises them."]
    lost = convert.convert_pdfs(files, Strict(), known).first()
    assert lost.markdown is None and lost.warnings == ["no language data"]


class Office(Plain):
    def to_docx(self, content):
        if content != b"old":
            raise ValueError("not an old file")
        return handbook()

    def to_pdf(self, content):
        return b"?\f?"


def test_word_files_through_the_extractor(spark, tmp_path):
    """Old Word files are converted first; those with hardly any text are recognised."""
    (tmp_path / "in").mkdir()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Scan</w:t></w:r></w:p></w:body></w:document>')
    for name, content in {"f.doc": b"old", "g h.docx": out.getvalue(), "x.doc": b"?"}.items():
        (tmp_path / "in" / name).write_bytes(content)
    files = sources.read_files(spark, str(tmp_path / "in"))
    rows = {os.path.basename(r.doc_id): r for r in convert.convert(files, wordlist.dictionary(None, spark), Office()).collect()}
    assert len(rows) == 3 and rows["f.doc"].markdown.startswith("# Harbour Atlas") and "not an old file" in rows["x.doc"].warnings[0]
    scan = rows["g h.docx"]
    assert "Recognised words of a page." in scan.markdown and scan.warnings == [convert.SCANNED] and (scan.stats.pages, scan.stats.ocr_pages, scan.stats.text_layer) == (2, 2, convert.NATIVE)


def test_equal_files_once(spark, tmp_path):
    for name in ("1.pdf", "2.pdf"):
        (tmp_path / name).write_bytes(b"same")
    assert [os.path.basename(r.doc_id) for r in convert.once(sources.read_files(spark, str(tmp_path))).collect()] == ["1.pdf"]


def test_command_line(spark, tmp_path, capsys):
    out = tmp_path / "out"
    assert main([folder(tmp_path), "-o", str(out)]) == 1
    assert os.listdir(out) == ["a.md"] and (out / "a.md").read_text().startswith("# Harbour Atlas")
    told = capsys.readouterr().err
    assert "Unsupported file type" in told and "files=6 failed=5 pages=0 recognised=0 seconds=0 written=1" in told


def test_command_line_options(spark, tmp_path, capsys):
    """Resolution, memory and deadlines reach the plan and the extractor; the figures come from the run itself."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"Some words on a page.\fMore words on a page.")
    args = [str(tmp_path / "in"), "-o", str(tmp_path / "out"), "--extractor", "tests.test_dealing:Seen", "--force-ocr", "--cpus", "4"]
    assert main([*args, "--dpi", "400", "--free-mb", "8000", "--page-seconds", "30"]) == 0
    told = capsys.readouterr().err
    assert "Word400" in (tmp_path / "out/a.md").read_text() and "files=1 failed=0 pages=2 recognised=2" in told and "instead of" not in told
    assert main([*args, "--free-mb", "150", "--memory-threshold", "100", "--no-pdf", "--page-seconds", "0", "--file-seconds", "0"]) == 0
    assert "Word200" in (tmp_path / "out/a.md").read_text() and "at 200 instead of 300" in capsys.readouterr().err
