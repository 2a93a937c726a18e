"""WARC archives: exact round trips, revisits, pushed predicates."""

from __future__ import annotations

import base64
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull

from quireflow.llm import warc
from quireflow.llm.common import scratch_dir, table

ROWS = [
    (1, "http://a/1", "<p>same</p>", "x"), (2, "http://a/2", "<p>same</p>", "x"), (3, "http://b/ü?q=\r\nWARC-Type: fake", "日本\r\n\r\nWARC/1.1\r\n", "x"), (4, None, None, "x"), (5, "http://c", "", "x"),
    (6, "http://d", "x" * 300_000, "x"), (7, "http://d2", "x" * 300_000, "x"), (8, "http://e", "\x00\x1f\x8b", None), (9, "\\u0041 back", "nine", "x"), (9, "\\u0041 back", "nine", "x"), (None, "http://n", "only", "x"),
]
SCHEMA = "page_id long, url string, html string, payload string"


def expected(rows: list[tuple], least: int = 0) -> list[tuple]:
    first: dict = {}
    for r in rows:
        body = (r[2] or "").encode()
        if r[0] is not None and len(body) >= least:
            first[body] = min(first.get(body, r[0]), r[0])
    out = []
    for r in rows:
        body = (r[2] or "").encode()
        again = body in first and first[body] != r[0] and len(body) >= least
        out.append((r[0], len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first[body] if again else None))
    return sorted(out, key=str)


def got(df) -> list[tuple]:
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


@pytest.mark.parametrize("least", [0, 5, 1000])
def test_round_trip(spark, least):
    assert got(warc.round_trip(spark.createDataFrame(ROWS, SCHEMA), least)) == expected(ROWS, least)


def test_table(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    assert got(warc.round_trip(pages)) == expected([tuple(r) for r in pages.select("page_id", "url", "html").collect()])


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.fixture(scope="module")
def archive(spark) -> str:
    path = scratch_dir(spark)
    warc.write_warc(spark.createDataFrame(ROWS, SCHEMA).repartition(3), path)
    return path


def test_payloads_and_headers_come_back(spark, archive):
    rows = {r.record_id: r for r in warc.read_warc(spark, archive).collect() if r.record_id is not None}
    for page, url, html, _ in ROWS:
        if page is not None and rows[page].record_type == "response":
            assert bytes(rows[page].payload) == (html or "").encode() and rows[page].target_uri == url
    assert rows[2].payload is None and rows[2].refers_to == 1


def test_files_are_gzip_members(archive):
    folder = archive.removeprefix("file://")
    text = b"".join(gzip.open(os.path.join(folder, f)).read() for f in os.listdir(folder) if f.endswith(".warc.gz"))
    assert text.count(b"WARC/1.1\r\nWARC-Type: re") == len(ROWS) + 0 and text.count(b"WARC-Payload-Digest: sha1:") == len(ROWS)


def test_predicates_are_pushed(spark, archive):
    frame = warc.read_warc(spark, archive)
    revisits = frame.where("record_type = 'revisit'")
    assert {r.record_id for r in revisits.collect()} == {r[0] for r in expected(ROWS) if r[3] == "revisit"}
    assert {r.record_id for r in frame.where(F.col("record_id").isin(3, 6)).collect()} == {3, 6}
    assert frame.where("refers_to is not null and payload_bytes > 100000").count() == 1
    reader = warc.WarcReader(archive, True)
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), In(("record_id",), (3, 6)), IsNotNull(("refers_to",)), GreaterThan(("payload_bytes",), 1)]))
    assert left == [GreaterThan(("payload_bytes",), 1)] and len(reader.tests) == 3


@pytest.mark.parametrize("own", [True, False])
def test_unwanted_payloads_are_not_decoded(archive, tmp_path, monkeypatch, own):
    """No more than a header's worth is inflated of members that carry their length; others are walked through without keeping."""
    kept = []
    real = warc._Gzip.block
    monkeypatch.setattr(warc._Gzip, "block", lambda self, n: kept.append(n) or real(self, n))
    path = archive
    if not own:
        for k, name in enumerate(f for f in os.listdir(archive.removeprefix("file://")) if f.endswith(".warc.gz")):
            whole = gzip.open(os.path.join(archive.removeprefix("file://"), name)).read()
            parts = [b"WARC/1.1\r\nWARC-Type" + x for x in whole.split(b"WARC/1.1\r\nWARC-Type") if x]
            (tmp_path / f"{k}.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
        path = f"file://{tmp_path}"
    for payload, tests, blocks in ((True, [("record_type", "in", ("revisit",))], 0), (False, [], 0), (True, [("record_type", "in", ("response",))], sum(r[3] == "response" for r in expected(ROWS)))):
        kept.clear()
        reader = warc.WarcReader(path, payload)
        reader.tests = tests
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert len(kept) == blocks and len(rows) == sum(reader.wanted(r) for r in rows) and rows


def test_only_committed_files_are_read_and_appends_add_up(spark, archive):
    folder = archive.removeprefix("file://")
    with open(os.path.join(folder, "stray.warc.gz"), "wb") as out:
        out.write(b"left by a lost task")
    assert warc.read_warc(spark, archive).count() == len(ROWS)
    warc.write_warc(spark.createDataFrame([(77, "http://more", "more", "x")], SCHEMA), archive)
    assert warc.read_warc(spark, archive).count() == len(ROWS) + 1


def foreign() -> bytes:
    """Records as other programs write them: an info record, a resource without an HTTP header, a response, odd header case and a folded line."""
    def record(kind: str, head: str, block: bytes, number: int) -> bytes:
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:0000-{number}>\r\nwarc-date: 2020-01-0{number}T00:00:00Z\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    return [
        record("warcinfo", "Content-Type: application/warc-fields\r\n", b"software: none\r\n\r\n", 1), record("resource", "WARC-Target-URI: http://r/\\u0041\r\nContent-Type: text/plain\r\n", b"a\r\n\r\nb", 2),
        record("response", "WARC-Target-URI:\r\n http://x/\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Type: application/http; msgtype=response\r\n", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + b"body" * 90_000, 3), record("metadata", "", b"", 4),
    ]


@pytest.mark.parametrize("kind", ["plain", "members", "one file", "one member", "two members"])
def test_archives_of_other_programs(spark, tmp_path, kind):
    if kind == "plain":
        (tmp_path / "a.warc").write_bytes(b"".join(foreign()))
    elif kind == "one member":
        (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(foreign())))
    elif kind == "two members":
        (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(foreign()[:3])) + gzip.compress(foreign()[3]))
    else:
        (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, foreign())))
    path = f"file://{tmp_path}" + ("/a.warc.gz" if kind == "one file" else "")
    rows = {r.date[9]: r for r in warc.read_warc(spark, path).collect()}
    assert [rows[k].record_type for k in "1234"] == ["warcinfo", "resource", "response", "metadata"]
    assert bytes(rows["2"].payload) == b"a\r\n\r\nb" and rows["2"].target_uri == "http://r/\\u0041" and bytes(rows["3"].payload) == b"body" * 90_000 and rows["3"].payload_digest == "ABC"
    assert rows["3"].target_uri == "http://x/" and rows["4"].payload_bytes == 0 and rows["2"].record_uri == "urn:uuid:0000-2" and rows["2"].record_id is None
    assert [r.date[9] for r in warc.read_warc(spark, path, payload=False).where("record_type = 'response'").collect()] == ["3"]


@pytest.mark.parametrize("payload", [True, False])
@pytest.mark.parametrize("name, torn", [("a.warc.gz", gzip.compress(foreign()[2])[:-200]), ("a.warc", b"".join(foreign()[:3])[:-200]), ("b.warc.gz", gzip.compress(b"".join(foreign()[:3])[:-200])), ("b.warc", foreign()[1][:-7]), ("c.warc", b"WARC/1.0\r\nContent-Le")])
def test_a_torn_file_is_an_error(spark, tmp_path, name, torn, payload):
    (tmp_path / name).write_bytes(torn)
    with pytest.raises(Exception, match="ends inside|shorter than|no header"):
        warc.read_warc(spark, f"file://{tmp_path}", payload=payload).collect()


def test_http_in_any_case(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(foreign()[2].replace(b"application/http", b"Application/HTTP"))
    assert bytes(warc.read_warc(spark, f"file://{tmp_path}").first().payload) == b"body" * 90_000
