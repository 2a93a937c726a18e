"""Keeps a folder of Markdown results up to date with a stream of documents: the batch plan per micro-batch, once per content key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def _results(spark: SparkSession, out: str) -> DataFrame | None:
    try:
        return spark.read.parquet(out)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def structure_stream(documents: DataFrame, build: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "content_key") -> StreamingQuery:
    """Runs build on rows of `documents` (a streaming frame with a content key) that have no result yet and appends the results.

    build keeps the key column. A replayed micro-batch finds its keys done and adds nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        results = _results(spark, out)
        if results is not None:
            # The batch is the small side: its keys (or their Bloom filter) meet the key column where it is read, and few come back.
            done = results.select(key).join(batch.select(key).distinct(), key, "left_semi").distinct()
            fresh = fresh.join(done, key, "left_anti")
        build(fresh).write.mode("append").parquet(out)

    return documents.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
