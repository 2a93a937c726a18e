"""A file sink that commits: rows (name, content) become files of a folder, all of them or none.

Tasks write below a hidden folder of the job, each attempt into its own. The driver's commit gathers one message per task and writes the
job's manifest; until then nothing is visible, and an abort removes the hidden folder. Publishing then moves the files of the attempts that
the manifest names, again in tasks. A move that already happened is no error, so publishing can be repeated (`recover`) after any failure.

Content is binary or text (UTF-8), null counts as empty. Names are relative paths; rows with the same name are an error before anything is
written, as is a name that leaves the folder. A file that exists is replaced. Empty tables give an empty folder.
"""

from __future__ import annotations

import contextlib
import dataclasses
import json
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

HIDDEN = ".quireflow"
MANIFEST = "manifest.json"


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    fs, base = pafs.FileSystem.from_uri(folder)
    return fs, base.rstrip("/")


@dataclasses.dataclass
class Attempt(WriterCommitMessage):
    """What one task wrote: its folder, its files and bytes."""

    folder: str
    files: int
    bytes: int


class FilesWriter(DataSourceWriter):
    def __init__(self, folder: str, job: str):
        self.folder, self.job = folder, job

    def write(self, rows: Iterator[Row]) -> Attempt:
        fs, base = _opened(self.folder)
        attempt = uuid.uuid4().hex
        done = Attempt(attempt, 0, 0)
        for row in rows:
            content = row["content"].encode() if isinstance(row["content"], str) else bytes(row["content"] or b"")
            path = f"{base}/{HIDDEN}/{self.job}/{attempt}/{row['name']}"
            fs.create_dir(posixpath.dirname(path), recursive=True)
            with fs.open_output_stream(path) as out:
                out.write(content)
            done.files, done.bytes = done.files + 1, done.bytes + len(content)
        return done

    def commit(self, messages: list[Attempt | None]) -> None:
        fs, base = _opened(self.folder)
        kept = [dataclasses.asdict(m) for m in messages if m is not None and m.files]
        fs.create_dir(f"{base}/{HIDDEN}/{self.job}", recursive=True)
        # Written under another name first: the manifest is there whole or not at all.
        with fs.open_output_stream(f"{base}/{HIDDEN}/{self.job}/{MANIFEST}.new") as out:
            out.write(json.dumps({"attempts": kept}).encode())
        fs.move(f"{base}/{HIDDEN}/{self.job}/{MANIFEST}.new", f"{base}/{HIDDEN}/{self.job}/{MANIFEST}")

    def abort(self, messages: list[Attempt | None]) -> None:
        _remove(self.folder, self.job)


class FilesSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quirefiles"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], self.options["job"])


def _remove(folder: str, job: str) -> None:
    fs, base = _opened(folder)
    with contextlib.suppress(FileNotFoundError):
        fs.delete_dir(f"{base}/{HIDDEN}/{job}")
    if not [x for x in fs.get_file_info(pafs.FileSelector(f"{base}/{HIDDEN}", allow_not_found=True))]:
        with contextlib.suppress(FileNotFoundError):
            fs.delete_dir(f"{base}/{HIDDEN}")


def stage(rows: DataFrame, folder: str) -> str:
    """Writes and commits the files where nobody sees them; gives the job's name for publish."""
    spark, job = rows.sparkSession, uuid.uuid4().hex
    name = F.col("name")
    wrong = name.isNull() | (name == "") | name.startswith("/") | name.rlike(r"(^|/)\.\.?(/|$)")
    checked = rows.select(F.when(wrong, F.raise_error(F.concat(F.lit("not a name of a file: "), F.coalesce(name, F.lit("null"))))).otherwise(name).alias("name"), "content")
    twice = checked.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").first()
    if twice:
        raise ValueError(f"{twice['n']} rows have the name {twice['name']}")
    spark.dataSource.register(FilesSink)
    checked.write.format("quirefiles").option("job", job).mode("append").save(folder)
    return job


def publish(spark: SparkSession, folder: str, job: str) -> int:
    """Moves a committed job's files to their names; returns their number. May be repeated."""
    fs, base = _opened(folder)
    with fs.open_input_stream(f"{base}/{HIDDEN}/{job}/{MANIFEST}") as src:
        attempts = json.loads(src.read())["attempts"]

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _opened(folder)
        for batch in batches:
            for attempt in batch.column(0).to_pylist():
                top = f"{base}/{HIDDEN}/{job}/{attempt}"
                for info in fs.get_file_info(pafs.FileSelector(top, recursive=True, allow_not_found=True)):
                    if info.type == pafs.FileType.File:
                        to = f"{base}/{info.path.split(f'/{HIDDEN}/{job}/{attempt}/', 1)[1]}"
                        fs.create_dir(posixpath.dirname(to), recursive=True)
                        with contextlib.suppress(FileNotFoundError):  # moved by an earlier try of this task
                            fs.move(info.path, to)
            yield batch

    if attempts:
        names = spark.createDataFrame([(a["folder"],) for a in attempts], "folder string").repartition(len(attempts))
        names.mapInArrow(move, "folder string").write.format("noop").mode("overwrite").save()
    fs.create_dir(base, recursive=True)
    _remove(folder, job)
    return sum(a["files"] for a in attempts)


def recover(spark: SparkSession, folder: str) -> dict[str, int | None]:
    """Ends what a lost driver left: committed jobs are published (their number of files), others removed (None)."""
    fs, base = _opened(folder)
    out: dict[str, int | None] = {}
    for info in fs.get_file_info(pafs.FileSelector(f"{base}/{HIDDEN}", allow_not_found=True)):
        job = info.base_name
        if fs.get_file_info(f"{info.path}/{MANIFEST}").type == pafs.FileType.File:
            out[job] = publish(spark, folder, job)
        else:
            _remove(folder, job)
            out[job] = None
    return out


def write_files(rows: DataFrame, folder: str) -> int:
    """Files of the rows (name, content) in the folder (a URI that all executors share), all of them or none; returns their number."""
    return publish(rows.sparkSession, folder, stage(rows, folder))
