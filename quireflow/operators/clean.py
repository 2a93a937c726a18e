"""Removes running headers, page numbers, labels and noise from lines; re-attaches lone list markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireflow.functions import text as X
from quireflow.operators.layout import PAGE

MIN_PAGES, REPEAT_SHARE, MIN_KEY = 3, 0.4, 4


def with_margin(lines: DataFrame) -> DataFrame:
    return lines.withColumn("margin", X.in_margin(F.col("top"), F.col("bottom"), F.col("height")))


def running_headers(lines: DataFrame) -> DataFrame:
    """doc_id, key of margin lines that repeat (digits apart) on max(3, 0.4 * pages) pages or more; lines carry width and height."""
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page_no").alias("n_pages")).where(F.col("n_pages") >= MIN_PAGES)
    keyed = with_margin(lines).where("margin").select("doc_id", "page_no", X.header_key(F.col("text")).alias("key")).where(F.length("key") >= MIN_KEY)
    counts = keyed.groupBy("doc_id", "key").agg(F.count_distinct("page_no").alias("on_pages"))
    return counts.join(pages, "doc_id").where(F.col("on_pages") >= F.greatest(F.lit(float(MIN_PAGES)), REPEAT_SHARE * F.col("n_pages"))).select("doc_id", "key", "on_pages")


def drop_running_headers(lines: DataFrame) -> DataFrame:
    keyed = with_margin(lines).withColumn("key", F.when(F.col("margin"), X.header_key(F.col("text"))))
    return keyed.join(running_headers(lines).select("doc_id", "key"), ["doc_id", "key"], "left_anti").drop("margin", "key")


def clean_lines(lines: DataFrame) -> DataFrame:
    """Per line: page numbers go, page labels are cut off, then noise goes. A line is alone by its paragraph's lines beforehand."""
    alone = F.count("*").over(Window.partitionBy(*PAGE, "para_idx")) == 1
    marked = with_margin(lines).withColumn("alone", alone)
    kept = marked.where(~X.is_page_number(F.col("text"), F.col("margin")))
    stripped = kept.withColumn("text", X.strip_page_label(F.col("text"), F.col("page_no"), F.col("margin")))
    return stripped.where(~X.is_junk(F.col("text"), F.col("conf"), F.col("source"), F.col("alone"))).drop("margin", "alone")


def reattach_markers(lines: DataFrame) -> DataFrame:
    """A paragraph that is one lone list marker joins the next paragraph's first line.

    In a run of lone markers those at odd places attach to what follows them; the last one of the page is dropped when
    nothing follows.
    """
    para = Window.partitionBy(*PAGE, "para_idx")
    page = Window.partitionBy(*PAGE).orderBy("line_idx")
    t = X.strip(F.col("text"))
    lone = (F.count("*").over(para) == 1) & X.is_marker(t)
    marked = lines.withColumn("lone", lone)
    runs = marked.withColumn("run", F.sum(F.when(F.col("lone"), 0).otherwise(1)).over(page.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.when(F.col("lone"), F.row_number().over(Window.partitionBy(*PAGE, "run", "lone").orderBy("line_idx")))
    odd = runs.withColumn("gives", F.coalesce(place % 2 == 1, F.lit(False)))
    lag = lambda c: F.lag(c).over(page)
    takes = F.coalesce(lag("gives"), F.lit(False))
    joined = odd.withColumn("new_text", F.when(takes, F.concat(X.strip(lag("text")), F.lit(" "), F.col("text"))).otherwise(F.col("text"))).withColumn("new_left", F.when(takes, F.least("left", lag("left"))).otherwise(F.col("left")))
    return joined.where("not gives").drop("text", "left", "lone", "run", "gives").withColumnsRenamed({"new_text": "text", "new_left": "left"})


def clean_pages(lines: DataFrame) -> DataFrame:
    return reattach_markers(clean_lines(drop_running_headers(lines)))
