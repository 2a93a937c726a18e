"""Input files, pluggable extractors and the file sink.

PDF parsing and recognition are native programs' work and none is bundled: an extractor object gives pages and words, Spark
deals the files out, keeps failures as rows and does everything after the words.
"""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Iterable, Iterator
from typing import Any, Protocol
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.functions import text as X
from quireflow.scratch import cut
from quireflow.sources import dealing, sink
from quireflow.sources.deadline import Helper, OverdueError

SUPPORTED = ("pdf", "docx", "doc")
PAGE_SECONDS, FILE_SECONDS = 600.0, 1800.0  # deadlines of one page and of opening or converting one file
PAGE = "doc_id string, page_no int, width double, height double, has_fonts boolean, text string, error string, seconds double"
WORD = "doc_id string, page_no int, word_idx long, text string, x0 double, x1 double, top double, bottom double, size double, fontname string, conf double, block_num int, par_num int, line_num int, error string, fatal boolean, seconds double"


class FatalError(Exception):
    """Raised by an extractor where no page of the file can be had, such as for missing language data: the document fails."""


class Extractor(Protocol):
    """Runs in helper processes of tasks, so it must pickle. Dicts carry the fields of PAGE and WORD; a missing field is null.

    A call that takes longer than its deadline is ended with its process; the next page gets a new one. Optional: `recognises` (False where words() knows the text layer only), `to_pdf(content)` for Word files without text and
    `to_docx(content)` for old Word files; both give bytes.
    """

    def pages(self, content: bytes) -> Iterable[dict[str, Any]]:
        """The pages of a file, with what text its text layer holds."""

    def words(self, content: bytes, page_no: int, route: str, dpi: int) -> Iterable[dict[str, Any]]:
        """Words of one page in reading order, from its text layer ('text') or by recognition ('ocr') at the planned resolution."""


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), ext, content, length of every file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("doc_id"), F.lower(F.regexp_extract("path", r"\.([^./]+)\z", 1)).alias("ext"), "content", "length")


def unsupported(files: DataFrame) -> DataFrame:
    """doc_id, error of the files that no branch takes."""
    return files.where(~F.col("ext").isin(*SUPPORTED)).select("doc_id", F.concat(F.lit("Unsupported file type: ."), "ext").alias("error"))


def _rows(found: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from pa.Table.from_pylist([dict.fromkeys(schema.names) | x for x in found], schema).to_batches()


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def read_content(path: str) -> bytes:
    """The bytes of a file inside a task; path as Spark names it."""
    uri = quote(path if "://" in path else path.replace("file:", "", 1), safe="/:@")
    fs, base = pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), unquote(uri))
    with fs.open_input_stream(base) as file:
        return file.read()


def page_rows(files: DataFrame, extractor: Extractor, limit: float | None = FILE_SECONDS) -> DataFrame:
    """The pages of each file; a file that cannot be opened in time is one row with its error. The first row has the seconds it took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Helper(lambda: lambda content: list(extractor.pages(content)), limit) as pages:
            for batch in batches:
                for doc, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                    began = time.monotonic()
                    try:
                        found = [{"doc_id": doc} | x for x in pages(content.as_py())] or [{"doc_id": doc, "error": "The file has no pages."}]
                    except Exception as problem:  # one bad file must not end the job
                        found = [{"doc_id": doc, "error": f"Could not open the file: {problem}"}]
                    found[0]["seconds"] = time.monotonic() - began
                    yield from _rows(found, _arrow(PAGE))

    return files.select("doc_id", "content").mapInArrow(run, PAGE)


def _page_reader(extractor: Extractor, read: Callable[[str], bytes]) -> Callable[..., list[dict]]:
    """Words of a page by the file's path; a file stays open while its pages come one after the other."""
    content = functools.lru_cache(1)(read)
    return lambda doc, page, route, dpi: list(extractor.words(content(doc), page, route, dpi))


def word_rows(routed: DataFrame, extractor: Extractor, read: Callable[[str], bytes] = read_content, limit: float | None = PAGE_SECONDS, slots: int | None = None) -> DataFrame:
    """Words of the routed pages (doc_id, page_no, route, width, height, dpi, task_cpus); a page that fails or takes longer than
    `limit` seconds is one row with its error, one without words a row without text.

    Only page numbers are shuffled: they are dealt by cost (see dealing) and tasks open the files themselves, each once for all its pages. Pages
    whose memory plan asks for another number of CPUs a task run in a stage of their own. The first row of a page has the seconds it took.
    """
    spark = routed.sparkSession

    def page_words(reader: Helper, doc: str, page: int, route: str, dpi: int) -> list[dict]:
        try:
            return [{"doc_id": doc, "page_no": page, "word_idx": k} | x for k, x in enumerate(reader(doc, page, route, dpi))] or [{"doc_id": doc, "page_no": page}]
        except FatalError as problem:
            return [{"doc_id": doc, "page_no": page, "error": str(problem), "fatal": True}]
        except Exception as problem:  # noqa: BLE001
            late = isinstance(problem, OverdueError)
            told = f"Page {page} failed: {problem}" if route == "ocr" or late else f"Page {page}: its text layer cannot be read ({problem}), so it goes to recognition."
            return [{"doc_id": doc, "page_no": page, "error": told}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Helper(lambda: _page_reader(extractor, read), limit) as reader:
            for batch in batches:
                for doc, page, route, dpi in zip(*(c.to_pylist() for c in batch.columns)):
                    began = time.monotonic()
                    found = page_words(reader, doc, page, route, dpi)
                    found[0]["seconds"] = time.monotonic() - began
                    yield from _rows(found, _arrow(WORD))

    rows = routed.withColumn("cost", dealing.page_cost(F.col("route"), F.col("width"), F.col("height"), F.col("dpi")))
    classes = sorted(r[0] for r in routed.select("task_cpus").distinct().collect())  # powers of two
    done = [dealing.deal(rows.where(F.col("task_cpus") == cpus), slots=slots).select("doc_id", "page_no", "route", "dpi").mapInArrow(run, WORD, profile=dealing.profile_of(spark, cpus)) for cpus in classes]
    if len(done) > 1:
        done = [cut(part) for part in done]  # a stage has one profile, so classes do not share one
    return functools.reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], WORD)


def converted(files: DataFrame, convert: Callable[[bytes], bytes], limit: float | None = FILE_SECONDS) -> DataFrame:
    """doc_id, content (converted, null where that fails or takes too long), error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Helper(lambda: convert, limit) as made:
            for batch in batches:
                for doc, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                    try:
                        row = {"doc_id": doc, "content": made(content.as_py()), "error": None}
                    except Exception as problem:  # noqa: BLE001
                        row = {"doc_id": doc, "content": None, "error": f"Could not convert the file: {problem}"}
                    yield pa.RecordBatch.from_pylist([row], pa.schema([("doc_id", pa.string()), ("content", pa.binary()), ("error", pa.string())]))

    return files.select("doc_id", "content").mapInArrow(run, "doc_id string, content binary, error string")


def named_markdown(results: DataFrame) -> DataFrame:
    """name, content of every document with Markdown: its safe stem, equal stems with a hash of the path."""
    named = results.where("markdown is not null").select("doc_id", "markdown", F.regexp_replace(X.safe_name(F.col("doc_id")), r"\.[^.]*\z", "").alias("stem"))
    # Names are counted without their texts, combined before the shuffle.
    many = named.groupBy("stem").agg(F.count("*").alias("n")).where("n > 1").select("stem", F.lit(True).alias("many"))
    suffix = F.when(F.col("many"), F.concat(F.lit("-"), F.substring(F.sha2("doc_id", 256), 1, 12))).otherwise("")
    return named.join(many, "stem", "left").select(F.concat("stem", suffix, F.lit(".md")).alias("name"), F.encode("markdown", "UTF-8").alias("content"))


def write_markdown(results: DataFrame, folder: str) -> int:
    """One UTF-8 file per document with Markdown; all files appear or none. Returns their number."""
    return sink.write_files(named_markdown(results), folder)
