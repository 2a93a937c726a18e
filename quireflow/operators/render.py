"""Blocks to Markdown."""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireflow.functions import text as X


def block_markdown(blocks: DataFrame, dictionary: Broadcast) -> DataFrame:
    """Adds md: each block alone. Blocks are told apart by the page where they begin (first_page; page_no where absent) and block_idx."""
    if "first_page" not in blocks.columns:
        blocks = blocks.withColumn("first_page", F.col("page_no"))
    items = blocks.where("kind in ('ol', 'ul')").select("doc_id", "first_page", "block_idx", F.posexplode("items").alias("at", "item"))
    texts = items.withColumn("t", X.join_lines(F.col("item.parts"), dictionary)).groupBy("doc_id", "first_page", "block_idx").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.concat(F.coalesce(F.concat(F.col("item.n").cast("string"), F.lit(". ")), F.lit("- ")), F.col("t")).alias("line")))), lambda x: x["line"]), "\n").alias("list_md")
    )
    head = F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text"))
    return blocks.join(texts, ["doc_id", "first_page", "block_idx"], "left").withColumn("md", F.when(F.col("kind") == "h", head).when(F.col("kind") == "p", X.escape_start(F.col("text"))).otherwise(F.col("list_md"))).drop("list_md")


def render(blocks: DataFrame) -> DataFrame:
    """doc_id, markdown from blocks with md: neighbours of one list kind stay tight, blank parts go."""
    order = Window.partitionBy("doc_id").orderBy("first_page", "block_idx")
    tight = F.coalesce((F.lag("kind").over(order) == F.col("kind")) & F.col("kind").isin("ol", "ul"), F.lit(False))
    parts = blocks.withColumn("part", F.sum(F.when(tight, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lists = parts.groupBy("doc_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_page", "block_idx", "md"))), lambda x: x["md"]), "\n").alias("md")).where(F.col("md").rlike(r"(?U)\S"))
    return lists.groupBy("doc_id").agg(F.concat(X.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "md"))), lambda x: x["md"]), "\n\n")), F.lit("\n")).alias("markdown"))
