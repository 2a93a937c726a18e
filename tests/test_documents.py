"""Profiles, plans, attempts, Word documents, incremental runs."""

from __future__ import annotations

import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from quireflow import oracles
from quireflow.operators import attempts, docx, profile, resources
from quireflow.queries import QUERIES
from quireflow.sources import docx as docx_source
from quireflow.streaming import incremental

RAW = "doc_id long, page_no int, width double, height double, has_fonts boolean, text string"


def pages(spark, chars: list[int], fonts: bool):
    return spark.createDataFrame([(1, k, 612.0, 792.0, fonts, "x" * n) for k, n in enumerate(chars, 1)], RAW)


@pytest.mark.parametrize(
    ("chars", "fonts", "force", "modes", "label"),
    [
        ([0, 0, 0], True, False, ["--redo-ocr", "--force-ocr"], "hidden/empty (fonts, no extractable text)"), ([0, 0], False, False, ["--redo-ocr", "--force-ocr"], "none (image-only)"),
        ([900, 0, 800], True, False, ["--redo-ocr", "--force-ocr"], "partial (1 pages without)"), ([900, 800], True, False, ["--skip-text"], "present"), ([900, 800], True, True, ["--force-ocr"], "present"),
    ],
)
def test_modes(spark, chars, fonts, force, modes, label):
    r = profile.profile(pages(spark, chars, fonts)).select("*", profile.recognition_modes(force).alias("modes")).first()
    assert r.modes == modes and r.text_layer == label


def test_page_routing(spark):
    raw = pages(spark, [900, 3, 800], True)
    assert [r.route for r in profile.pages_to_recognise(raw, profile.profile(raw)).orderBy("page_no").collect()] == ["text", "ocr", "text"]


@pytest.mark.parametrize(("free", "forced", "want"), [(800.0, False, "sequential"), (4000.0, False, "concurrent"), (1500.0, False, "concurrent"), (4000.0, True, "sequential"), (None, False, "sequential")])
def test_schedule(spark, free, forced, want):
    assert spark.range(1).select(resources.schedule(F.lit(free).cast("double"), F.lit(forced)).alias("s")).first().s == want


def planned(spark, free: float, cpus: int, forced: bool = True):
    row = spark.createDataFrame([((612.0, 792.0), free, cpus, forced)], "largest struct<width:double,height:double>, free_mb double, cpus int, forced boolean")
    return resources.plan(row).first()


def test_plans(spark):
    r = planned(spark, 1000.0, 16)
    assert (r.ocr_workers, r.jobs, r.dpi, r.schedule) == (3, 2, 300, "sequential") and r.est_peak_mb in (652, 653)
    r = planned(spark, 250.0, 16)
    assert (r.ocr_workers, r.dpi) == (1, 200)
    r = planned(spark, 1000.0, 8)
    assert (r.ocr_workers, r.jobs) == (3, 2)


def test_capped_dpi(spark):
    got = spark.range(1).select(resources.capped_dpi(F.lit(612.0), F.lit(792.0), F.lit(300)).alias("a"), resources.capped_dpi(F.lit(7200.0), F.lit(7200.0), F.lit(300)).alias("b"), resources.capped_dpi(F.lit(1e5), F.lit(1e5), F.lit(300)).alias("c")).first()
    assert (got.a, got.b, got.c) == (300, 77, 72)


@pytest.mark.parametrize(
    ("tries", "outcome", "tried", "named"),
    [
        ([("--redo-ocr", 6, 0), ("--force-ocr", 0, 4210)], "--force-ocr", 2, []), ([("--skip-text", 0, 0), ("--redo-ocr", 0, 0), ("--force-ocr", 0, 4210)], "--force-ocr", 3, []), ([("--redo-ocr", 2, 0), ("--force-ocr", 0, 0)], "failed", 2, ["--redo-ocr", "--force-ocr"]),
        ([("--redo-ocr", 9, 0), ("--force-ocr", 0, 9)], "failed", 1, ["--redo-ocr"]), ([("--redo-ocr", 10, 7)], "--redo-ocr", 1, []), ([("--redo-ocr", 137, 0), ("--force-ocr", 0, 7)], "failed", 1, ["--redo-ocr"]), ([("--redo-ocr", -9, 0)], "failed", 1, ["--redo-ocr"]),
    ],
)
def test_attempts(spark, tries, outcome, tried, named):
    rows = [(1, k, mode, rc, chars, "") for k, (mode, rc, chars) in enumerate(tries)]
    r = attempts.outcomes(spark.createDataFrame(rows, "doc_id long, attempt_no int, mode string, rc int, text_chars long, log string")).first()
    assert (r.outcome, r.tried) == (outcome, tried) and (all(n in r.warning for n in named) if named else r.warning is None)


NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def para(*runs: str, style: str = "", num: str = "") -> str:
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{num[2:] or 0}"/><w:numId w:val="{num[0]}"/></w:numPr>' if num else "")
    return f"<w:p><w:pPr>{props}</w:pPr>{''.join(x if x.startswith('<') else run(x) for x in runs)}</w:p>"


def run(text: str, marks: str = "") -> str:
    return f'<w:r><w:rPr>{"".join(f"<w:{m}/>" for m in marks)}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'


def handbook() -> bytes:
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/>{extra}</w:style>' for i, n, extra in (("T", "Title", ""), ("H1", "heading 1", ""), ("H2", "heading 2", ""), ("LN", "List Number", ""), ("LB", "List Bullet", '<w:pPr><w:numPr><w:numId w:val="2"/></w:numPr></w:pPr>')))
    numbering = '<w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="lowerLetter"/></w:lvl></w:abstractNum><w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="1"/></w:num>'
    cell = lambda t: f"<w:tc>{para(t)}</w:tc>"
    table = "<w:tbl>" + "".join(f"<w:tr>{''.join(map(cell, r))}</w:tr>" for r in (("Light", "Keeper"), ("North", "Ana"), ("A|B",))) + "</w:tbl>"
    body = (
        para("Harbour Atlas", style="T") + para("Tides and Winds", style="H1") + para("Check the ", run("barometer", "b"), " before each ", run("short", "i"), run(" crossing", "i"), ".") + para("Count the buoys", style="LN") + para("Note the lights", style="LN")
        + para("Instruments", style="H2") + para("Sextant for clear nights", style="LB") + para("") + para("Radar for thick fog", style="LB") + table + para("First", num="1") + para("Deep", num="1 1") + para("Second", num="1") + para("Deep again", num="1 1")
        + para('<w:hyperlink r:id="r1">' + run("the site") + "</w:hyperlink>", " and ", run("  both  ", "bi")) + para("# not a heading")
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {NS}>{styles}</w:styles>")
        z.writestr("word/numbering.xml", f"<w:numbering {NS}>{numbering}</w:numbering>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="http://site"/></Relationships>')
    return out.getvalue()


def test_docx(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(handbook())
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "other.txt").write_bytes(b"x")
    rows = {r.path.rsplit("/", 1)[1]: r for r in docx.docx_markdown(docx_source.read_docx(spark, str(tmp_path))).collect()}
    text = rows["a.docx"].markdown
    for part in ("# Harbour Atlas", "## Tides and Winds", "### Instruments", "**barometer**", "*short crossing*", "1. Count the buoys\n2. Note the lights", "- Sextant for clear nights\n- Radar for thick fog", "| North | Ana |", "| A\\|B |  |", "1. First\n   1. Deep\n2. Second\n   1. Deep again", "[the site](http://site) and ***both***", "\\# not a heading"):
        assert part in text, part
    assert rows["bad.docx"].markdown is None and "Not a readable" in rows["bad.docx"].error and len(rows) == 2


def test_docx_items_of_one_position(spark, tmp_path):
    """Parts from 1,000,000 on share positions with the next line's: such items are peers in the statement's windows, in an order that it leaves open."""
    rows = [(order, line, part) for order, kind in enumerate([0, 1, 2, 3, 4, 6]) for line, part in ((1, 500007), (2, 1000000 + kind), (3, kind), (4, 900008), (5, 11))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    made = {r.path: r.markdown for r in QUERIES["docx_markdown"](spark, str(tmp_path)).collect()}
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as base:
        base.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        told = dict(base.execute(oracles.sql()["docx_markdown"]).fetchall())
    open_ends = lambda md: [sorted(re.sub(r"^( *)\d+\.", r"\1", x) for x in part.split("\n")) for part in md.split("\n\n")]
    assert {k: open_ends(v) for k, v in made.items()} == {k: open_ends(v) for k, v in told.items()}
    assert "**Note** 1000003\n**Note** 3\n" in made["3"] and "1. Part 1\n2. Part 1000001\n" in made["1"]


def test_list_counters(spark):
    items = [("d", k, 1, "1", lvl) for k, lvl in enumerate([0, 0, 1, 1, 2, 1, 0, 1])] + [("d", 20 + k, 2, "1", 0) for k in range(2)]
    got = [r.n for r in docx.list_counters(spark.createDataFrame(items, "path string, pos int, run int, num_id string, ilvl int")).orderBy("pos").collect()]
    assert got == [1, 2, 1, 2, 1, 3, 3, 1, 1, 2]


def test_stream_adds_each_content_once(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "content_key string, text string"
    build = lambda d: d.select("content_key", F.upper("text").alias("markdown"))
    for batch in ([("a", "x"), ("b", "y"), ("a", "x")], [("b", "y"), ("c", "z")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        incremental.structure_stream(spark.readStream.schema(schema).parquet(source), build, out, mark).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [("a", "X"), ("b", "Y"), ("c", "Z")]
