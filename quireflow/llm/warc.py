"""WARC archives as a PySpark Python data source ("quirewarc"), writer and reader.

Writer: standard WARC/1.1, one gzip member per record, in files of about `maxFileBytes`, each under a name of its own. Every commit
adds a manifest of the files of its successful attempts, so appends add up and retried or lost tasks leave nothing that a reader
would see. A member's gzip header says in an extra field how long the member is.

Reader: a folder with manifests, a folder of .warc and .warc.gz files without any, or one such file, of any origin. Partitions are
whole files. Equality, IN and null filters on record_type and on header columns come from Spark. Of each record the headers are
read first: from a plain file up to the blank line, from a gzip member by inflating no more than that. Where the pushed
predicates reject the record, or no payload is wanted (option payload=false), the rest is left alone: by Content-Length in a
plain file, by the extra field in a member that has one, and by inflating without keeping in any other. A member may hold several records; one that
ends early, like a plain file that does, is an error. Bodies that a server sent in chunks come back as they stand, chunk marks included.

Null payloads are empty, records without an HTTP header have their block as payload, records whose header cannot be read end the
file with an error. Null page ids are written without a number and read as null. Repeated page ids are records of their own; of
equal payloads the least page id is the response (ties: each row of that id). Empty tables make an archive without files. Very
long payloads pass as one value. Columns other than page_id, url and html take no part.

Paths are any that pyarrow's file systems open (file://, hdfs://, s3://, ...).
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, WriterCommitMessage
from pyspark.sql.types import StructType

from quireflow.llm.common import cut, scratch_dir, spread_join

WRITE_SCHEMA = "record_id long, record_type string, target_uri string, refers_to long, payload_digest string, payload_bytes long, payload binary"
READ_SCHEMA = f"{WRITE_SCHEMA}, record_uri string, date string"
PUSHED = ("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "record_uri", "date")
MANIFEST = "_manifest-"
_PAGE = "<urn:page:"
_FLAG, _EXTRA = b"QL", 12  # the extra field's two-byte name and the bytes that it adds: the member's length
_PIECE = 1 << 16
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def digest32(sha1: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: 20 bits, five hex digits, are four letters."""

    def letters(hexes: Column) -> Column:
        bits = lambda k: F.conv(F.substring(hexes, 5 * k + 1, 5), 16, 10).cast("int")
        return F.concat(*(F.substring(F.lit(BASE32), F.shiftright(bits(k), 15 - 5 * j).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for k in range(8) for j in range(4)))

    # The lambda's variable keeps the optimiser from repeating the hash for each letter.
    return F.element_at(F.transform(F.array(sha1), letters), 1)


def _member(data: bytes) -> bytes:
    """One gzip member that carries its own length."""
    body = zlib.compressobj(1, zlib.DEFLATED, -15)
    packed = body.compress(data) + body.flush()
    length = 10 + _EXTRA - 2 + len(packed) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\x00\xff" + struct.pack("<H2sHI", 8, _FLAG, 4, length) + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record_bytes(row: dict) -> bytes:
    """A response (with its payload) or a revisit (with the response's HTTP header only)."""
    payload = row["payload"] or b""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode() + (payload if row["record_type"] != "revisit" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_PAGE}{'' if row['record_id'] is None else row['record_id']}>", "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {row['target_uri'].encode('unicode_escape').decode()}"] if row["target_uri"] is not None else []), f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        *([f"WARC-Refers-To: {_PAGE}{row['refers_to']}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if row["refers_to"] is not None else []),
        "Content-Type: application/http; msgtype=response", f"X-Payload-Length: {row['payload_bytes']}", f"Content-Length: {len(block)}",
    ]
    return _member(("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n")


@dataclass
class _Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, max_file_bytes: int, overwrite: bool):
        self.path, self.most, self.overwrite = path.rstrip("/"), max_file_bytes, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, base = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(base, recursive=True)
        files, out, size, name = [], None, 0, ""
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                record = record_bytes(row)
                out.write(record)
                size += len(record)
                if size >= self.most:
                    out.close()
                    files.append([name, size])
                    out = None
        if out is not None:
            out.close()
            files.append([name, size])
        return _Written(files)

    def commit(self, messages: list) -> None:
        fs, base = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(base, recursive=True)
        before = [x.path for x in fs.get_file_info(pafs.FileSelector(base))] if self.overwrite else []
        files = sorted(f for m in messages if m for f in m.files)
        with fs.open_output_stream(f"{base}/{MANIFEST}{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps(files).encode())
        names = {name for name, _ in files}
        for path in before:
            name = path.rsplit("/", 1)[-1]
            if name.startswith(MANIFEST) or (name.endswith(".warc.gz") and name not in names):
                fs.delete_file(path)

    def abort(self, messages: list) -> None:
        fs, base = pafs.FileSystem.from_uri(self.path)
        for message in messages:
            for name, _ in message.files if message else ():
                fs.delete_file(f"{base}/{name}")


@dataclass
class _File(InputPartition):
    name: str


class _Plain:
    """Records of an uncompressed file."""

    def __init__(self, src: pa.NativeFile):
        self.src, self.held = src, b""

    def head(self) -> bytes | None:
        """The bytes up to the blank line of the next record; None at the file's end."""
        while True:
            self.held = self.held.lstrip(b"\r\n")
            stop = self.held.find(b"\r\n\r\n")
            if stop >= 0:
                head, self.held = self.held[:stop], self.held[stop + 4 :]
                return head
            piece = self.src.read(_PIECE)
            if not piece:
                if self.held:
                    raise ValueError("a WARC file ends inside a header")
                return None
            self.held += piece

    def block(self, length: int) -> bytes:
        while length > len(self.held):
            piece = self.src.read(length - len(self.held))
            if not piece:
                raise ValueError("a WARC file ends inside a record")
            self.held += piece
        block, self.held = self.held[:length], self.held[length:]
        return block

    def skip(self, length: int) -> None:
        if length <= len(self.held):
            self.held = self.held[length:]
            return
        to = self.src.tell() + length - len(self.held)
        if to > self.src.size():
            raise ValueError("a WARC file ends inside a record")
        self.src.seek(to)
        self.held = b""


class _Gzip:
    """Records of a file of gzip members: one record each, or several in a member, as where a whole file was compressed."""

    def __init__(self, src: pa.NativeFile):
        self.src, self.held, self.start = src, b"", 0
        self.member, self.text, self.length = None, b"", None

    def _more(self) -> bool:
        piece = self.src.read(_PIECE)
        self.held += piece
        return bool(piece)

    def _next_member(self) -> bool:
        while len(self.held) < 10 + _EXTRA:
            if not self._more():
                break
        self.held = self.held.lstrip(b"\0")  # padding after the last member
        if not self.held:
            return False
        self.length = None
        if self.held[3:4] and self.held[3] & 4 and self.held[12:14] == _FLAG:
            self.length = struct.unpack("<I", self.held[16:20])[0]
        self.start = self.src.tell() - len(self.held)
        self.member = zlib.decompressobj(31)
        return True

    def _inflate(self, most: int) -> bytes:
        """Up to `most` further bytes of the member; empty at its end."""
        while self.member is not None and not self.member.eof:
            if not self.held and not self._more():
                raise ValueError("a WARC file ends inside a member")
            out = self.member.decompress(self.held, most)
            self.held = self.member.unconsumed_tail if not self.member.eof else self.member.unused_data
            if out:
                return out
        return b""

    def head(self) -> bytes | None:
        while True:
            self.text = self.text.lstrip(b"\r\n")
            stop = self.text.find(b"\r\n\r\n")
            if stop >= 0:
                head, self.text = self.text[:stop], self.text[stop + 4 :]
                return head
            if more := self._inflate(2048):
                self.text += more
            elif self.text:
                raise ValueError("a WARC record has no header")
            elif not self._next_member():
                return None

    def block(self, length: int) -> bytes:
        parts, held = [self.text], len(self.text)
        while held < length:
            more = self._inflate(1 << 20)
            if not more:
                raise ValueError("a WARC record is shorter than its header says")
            parts.append(more)
            held += len(more)
        text = b"".join(parts)
        self.text = text[length:]
        return text[:length]

    def skip(self, length: int) -> None:
        if self.length is not None:  # of one record alone
            self.src.seek(self.start + self.length)
            self.held, self.text, self.member = b"", b"", None
            return
        while length > len(self.text):
            length -= len(self.text)
            self.text = self._inflate(1 << 20)
            if not self.text:
                raise ValueError("a WARC record is shorter than its header says")
        self.text = self.text[length:]


def _number(x: str | None) -> int | None:
    digits = x[len(_PAGE) : -1] if x and x.startswith(_PAGE) else ""
    return int(digits) if digits.lstrip("-").isdigit() else None


def parsed(head: bytes) -> tuple[dict, dict]:
    """A record's columns and its raw headers, names in lower case."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    raw: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:  # a folded header goes on
            raw[last] = f"{raw[last]} {line.strip()}".strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            raw[last] = value.strip()
    uri, own = raw.get("warc-target-uri"), raw.get("warc-record-id")
    if uri is not None and own and own.startswith(_PAGE):
        uri = uri.encode().decode("unicode_escape")
    length = raw.get("x-payload-length")
    digest = raw.get("warc-payload-digest")
    row = {
        "record_id": _number(own), "record_type": raw.get("warc-type"), "target_uri": uri, "refers_to": _number(raw.get("warc-refers-to")), "payload_digest": digest.partition(":")[2] or digest if digest else None,
        "payload_bytes": int(length) if length else None, "record_uri": own.strip("<>") if own else None, "date": raw.get("warc-date"),
    }
    return row, raw


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.tests = path.rstrip("/"), payload, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in PUSHED and isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif column in PUSHED and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in PUSHED and isinstance(f, (IsNull, IsNotNull)):
                self.tests.append((column, "null", isinstance(f, IsNull)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, base = pafs.FileSystem.from_uri(self.path)
        if fs.get_file_info(base).type == pafs.FileType.File:
            return [_File(base)]
        found = [x.path for x in fs.get_file_info(pafs.FileSelector(base)) if x.type == pafs.FileType.File]
        manifests = [x for x in found if x.rsplit("/", 1)[-1].startswith(MANIFEST)]
        if manifests:
            found = []
            for manifest in sorted(manifests):
                with fs.open_input_stream(manifest) as src:
                    found += [f"{base}/{name}" for name, _ in json.loads(src.read())]
        return [_File(x) for x in sorted(found) if x.endswith((".warc", ".warc.gz"))] or [_File("")]

    def wanted(self, head: dict) -> bool:
        return all((head[c] in value) if how == "in" else ((head[c] is None) == value) for c, how, value in self.tests)

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        kinds = [("record_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("record_uri", pa.string()), ("date", pa.string())]
        rows: list[dict] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in kinds], names=[c for c, _ in kinds])

        if not partition.name:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(partition.name) as src:
            records = (_Gzip if partition.name.endswith(".gz") else _Plain)(src)
            while (head := records.head()) is not None:
                row, raw = parsed(head)
                length = int(raw.get("content-length", 0))
                if not self.wanted(row):
                    records.skip(length)
                    continue
                row["payload"] = None
                if self.payload and row["record_type"] != "revisit":
                    block = records.block(length)
                    begin = block.find(b"\r\n\r\n") + 4 if raw.get("content-type", "").lower().startswith("application/http") else 0
                    row["payload"] = block[begin:] if begin != 3 else block
                    row["payload_bytes"] = len(row["payload"])
                    held += len(block)
                else:
                    records.skip(length)
                rows.append(row)
                if len(rows) >= 2000 or held > 8 << 20:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quirewarc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("maxFileBytes", 64 << 20)), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """A record per page: of equal payloads of at least min_bytes the one with the smallest page_id is the response, the others revisit it.

    Which page a digest belongs to is settled among ids and digests alone; payloads then meet their verdict by page id, so one payload that
    very many pages share (the empty one, say) is no hot key.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").alias("record_id"), F.col("url").alias("target_uri"), F.encode(html, "UTF-8").alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    light = cut(rows.where(F.col("payload_bytes") >= min_bytes).select("record_id", "sha1"))
    first = cut(light.groupBy("sha1").agg(F.min("record_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null"))
    # A null id has no number to be told apart by; it revisits whatever page has its payload.
    again = spread_join(light, first, "sha1", "n").where("record_id is null or record_id != first_id").select(F.col("record_id").alias("__id"), F.col("sha1").alias("__sha1"), "first_id").distinct()
    joined = rows.join(again, F.expr("record_id <=> __id and sha1 = __sha1"), "left")
    revisit = F.col("first_id").isNotNull()
    return joined.select("record_id", F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", F.col("first_id").alias("refers_to"), digest32(F.col("sha1")).alias("payload_digest"), "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    register(pages.sparkSession)
    records(pages, min_bytes).write.format("quirewarc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("quirewarc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the archives, reads them back and reports each record; a response's figures are those of the payload as read."""
    path = scratch_dir(pages.sparkSession)
    write_warc(pages, path, min_bytes)
    back = read_warc(pages.sparkSession, path)
    read = F.col("payload").isNotNull()
    true = F.when(read, digest32(F.sha1("payload"))).otherwise(F.col("payload_digest"))
    checked = F.when(F.col("true") == F.col("payload_digest"), F.col("true")).otherwise(F.raise_error(F.concat(F.lit("the payload does not match its digest in record "), F.coalesce(F.col("record_id").cast("string"), F.lit("without id")))))
    return back.withColumn("true", true).select(F.col("record_id").alias("page_id"), F.when(read, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to")
