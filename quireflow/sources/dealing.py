"""Deals pages out to tasks by what they cost, pages of one file next to each other, and each class of memory plan to its own stage."""

from __future__ import annotations

import math

from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireflow.operators import resources

#: Pages of a file that are numbered together; groups of such pages in the running sum; megapixels of a task at most.
TOGETHER, BUCKETS, TASK_COST = 4096, 1024, 1000.0
TEXT_COST = 0.05  # of a text-layer page


def page_cost(route: Column, width: Column, height: Column, dpi: Column) -> Column:
    """Megapixels that recognition renders of a page, capped as rendering is; a text layer costs next to nothing. Pages without a size count as Letter."""
    pixels = F.coalesce(width, F.lit(612.0)) / 72 * dpi * F.coalesce(height, F.lit(792.0)) / 72 * dpi
    return F.when(route == "ocr", F.greatest(F.lit(TEXT_COST), F.least(pixels, F.lit(float(resources.MAX_PIXELS))) / 1e6)).otherwise(TEXT_COST)


def deal(pages: DataFrame, cost: str = "cost", task_cost: float = TASK_COST, slots: int | None = None) -> DataFrame:
    """The pages (doc_id, page_no, cost, ...) in partitions of nearly equal cost, in order of file and page.

    A running sum over all pages is cut into equal parts. It is made of the sums within BUCKETS groups and the groups' own offsets, so no
    window sees all pages. There are as many parts as slots, more where a part would cost over task_cost; their number is explicit, so
    adaptive execution leaves them alone. Only a page that is dearer than a part makes an uneven one.
    """
    spark = pages.sparkSession
    bucket = F.pmod(F.xxhash64("doc_id", F.floor(F.col("page_no") / TOGETHER)), F.lit(BUCKETS)).cast("int")
    rows = pages.withColumn("__bucket", bucket)
    sums = rows.groupBy("__bucket").agg(F.sum(cost).alias("sum"), F.count("*").alias("n")).collect()  # BUCKETS rows at most
    total, n = math.fsum(r["sum"] for r in sums), sum(r["n"] for r in sums)
    if not n:
        return pages
    parts = max(min(n, slots or spark.sparkContext.defaultParallelism), math.ceil(total / task_cost))
    offsets, at = [], 0.0
    for r in sorted(sums):
        offsets.append((r["__bucket"], at))
        at += r["sum"]
    starts = spark.createDataFrame(offsets, "__bucket int, __start double")
    along = Window.partitionBy("__bucket").orderBy("doc_id", "page_no").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("__start") + F.sum(cost).over(along) - F.col(cost) / 2
    part = F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.floor(middle * parts / F.lit(total)))).cast("int")
    dealt = rows.join(F.broadcast(starts), "__bucket").withColumn("__part", part)
    return dealt.repartitionById(parts, "__part").sortWithinPartitions("doc_id", "page_no").drop("__bucket", "__start", "__part")


def task_cpus(cpus: Column, workers: Column) -> Column:
    """CPUs that a recognition task has to hold so that no more than the planned workers run on a machine; powers of two, so few classes."""
    return F.least(cpus, F.pow(F.lit(2), F.ceil(F.log2(cpus / workers)))).cast("int")


def profile_of(spark: SparkSession, cpus: int) -> ResourceProfile | None:
    """The resource profile of tasks that hold this many CPUs; None where one is enough or the master knows no profiles (local ones)."""
    if cpus <= 1 or spark.sparkContext.master.split("[")[0] == "local":
        return None
    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(cpus)).build
