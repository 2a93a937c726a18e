"""PDF profiles: what a document's pages say about its text layer, and which recognition modes that asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.functions import text as X

#: Fixed limits.
MIN_PAGE_CHARS, IMAGE_FLOOR, IMAGE_PER_PAGE = 10, 20, 2


def profile(pages_raw: DataFrame) -> DataFrame:
    """pages_raw(doc_id, page_no, width, height, has_fonts, text) -> one row per document."""
    chars = X.alnum_count(F.coalesce("text", F.lit("")))
    per = pages_raw.withColumn("chars", chars).groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.bool_or("has_fonts").alias("has_fonts"), F.sum("chars").cast("long").alias("text_chars"), F.count_if(F.col("chars") < MIN_PAGE_CHARS).alias("pages_without_text"),
        F.max_by(F.struct("width", "height"), F.struct(F.col("width") * F.col("height"), -F.col("page_no"))).alias("largest"),
    )
    image_only = ~F.col("has_fonts") | (F.col("text_chars") < F.greatest(F.lit(IMAGE_FLOOR), IMAGE_PER_PAGE * F.col("pages")))
    known = per.withColumn("image_only", image_only).withColumn("hidden_text_layer", F.col("has_fonts") & F.col("image_only"))
    return known.withColumn("text_layer", text_layer_label())


def text_layer_label() -> Column:
    """Fixed wordings."""
    return (
        F.when(F.col("hidden_text_layer"), "hidden/empty (fonts, no extractable text)")
        .when(F.col("image_only"), "none (image-only)")
        .when(F.col("pages_without_text") > 0, F.format_string("partial (%d pages without)", F.col("pages_without_text")))
        .otherwise("present")
    )


def recognition_modes(force: bool | Column = False) -> Column:
    """Page-handling flags to try in order, of a profile row."""
    force = force if isinstance(force, Column) else F.lit(force)
    either = F.col("image_only") | (F.col("pages_without_text") > 0)
    return F.when(force, F.array(F.lit("--force-ocr"))).when(either, F.array(F.lit("--redo-ocr"), F.lit("--force-ocr"))).otherwise(F.array(F.lit("--skip-text")))


def pages_to_recognise(pages_raw: DataFrame, profiles: DataFrame, force: bool = False) -> DataFrame:
    """Splits pages by what they need: column route is 'ocr' or 'text'."""
    chars = X.alnum_count(F.coalesce("text", F.lit("")))
    known = pages_raw.join(profiles.select("doc_id", "image_only"), "doc_id")
    return known.withColumn("route", F.when(F.lit(force) | F.col("image_only") | (chars < MIN_PAGE_CHARS), "ocr").otherwise("text")).drop("image_only")


def pages_without_words(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """The pages (doc_id, page_no, ...) whose extracted lines hold too little text, failed ones included: they go to recognition."""
    chars = lines.groupBy("doc_id", "page_no").agg(F.sum(X.alnum_count(F.col("text"))).alias("line_chars"))
    return pages.join(chars, ["doc_id", "page_no"], "left").where(F.coalesce("line_chars", F.lit(0)) < MIN_PAGE_CHARS).drop("line_chars")


def confidence_stats(ocr_lines: DataFrame) -> DataFrame:
    """doc_id, ocr_pages, mean_conf: the mean of the page means, to one decimal."""
    pages = ocr_lines.groupBy("doc_id", "page_no").agg(F.max("page_conf").alias("conf"))
    return pages.groupBy("doc_id").agg(F.count("*").alias("ocr_pages"), F.round(F.avg("conf"), 1).alias("mean_conf"))
