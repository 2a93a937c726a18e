"""Scratch tables in the shared folder: they cut long plans in two and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_scopes: list[list[str]] = [[]]  # folders by scope, the innermost last


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name below the shared folder of spark.checkpoint.dir, removed with its scope (see scope) or at exit.

    Where the setting is absent, a single machine gets a temporary folder and a cluster, whose machines would not share one, an error.
    """
    base = spark.conf.get(SETTING, None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quireflow-")
        spark.conf.set(SETTING, base)
    path = f"{base.rstrip('/')}/quireflow-{uuid.uuid4().hex}"
    _scopes[-1].append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again: lineage ends here."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Folders made inside are removed at its end, but for those that the frames given to the yielded function read from."""
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.extend(df.inputFiles())
        return df

    _scopes.append([])
    try:
        yield keep
    finally:
        made = _scopes.pop()
        # inputFiles names files as Spark does, folders may differ in slashes: the unique last part decides.
        stay = {path for path in made if any(path.rsplit("/", 1)[1] in name for name in kept)}
        _scopes[-1].extend(stay)
        _remove([path for path in made if path not in stay])


def release(df: DataFrame) -> None:
    """Removes the scratch folders that a frame reads from; it is of no use afterwards."""
    names = df.inputFiles()
    for made in _scopes:
        gone = [path for path in made if any(path.rsplit("/", 1)[1] in name for name in names)]
        made[:] = [path for path in made if path not in gone]
        _remove(gone)


def _remove(paths: list[str]) -> None:
    for path in paths:
        with contextlib.suppress(OSError, ValueError):  # a folder that was never written, or a file system only Spark opens
            fs, base = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace(":", "://", 1))
            fs.delete_dir(base)


atexit.register(lambda: [_remove(paths) for paths in _scopes])
