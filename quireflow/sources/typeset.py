"""Sets plain documents as positioned words, so that tables without geometry can feed the layout operators.

A text line wraps at 90 characters of 5 points; 50 rows of 13 points make a page of 612 x 792. The first text line is in 24
points, others in 10; every eleventh is bold. Recognition confidence cycles through 0 to 99.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHARS, ROWS, PITCH, WIDTH, HEIGHT = 90, 50, 13, 612.0, 792.0
LINE = 1 << 31  # above the number of words in any one line


def typeset(docs: DataFrame) -> DataFrame:
    """words(doc_id, page_no, word_idx, text, x0, x1, top, bottom, size, fontname, conf, block_num, par_num, line_num)."""
    by_doc = Window.partitionBy("doc_id").orderBy("ln")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    rows = F.greatest(F.lit(1), F.ceil(F.length("line") / CHARS))
    lines = lines.repartition("doc_id").withColumn("row0", F.coalesce(F.sum(rows).over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pieces = lines.select("doc_id", "ln", "row0", F.posexplode(F.split("line", " ")).alias("wn", "text"))
    before = Window.partitionBy("doc_id", "ln").orderBy("wn").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("off", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))).where("text <> ''")
    row = F.col("row0") + F.floor(F.col("off") / CHARS)
    size = F.when(F.col("ln") == 0, 24.0).otherwise(10.0)
    placed = placed.withColumn("row", row).withColumn("x0", (72 + 5 * (F.col("off") % CHARS)).cast("double")).withColumn("top", (60 + PITCH * (F.col("row") % ROWS)).cast("double"))
    return placed.select(
        "doc_id", (F.floor(F.col("row") / ROWS) + 1).cast("int").alias("page_no"), (F.col("ln").cast("long") * LINE + F.col("wn")).alias("word_idx"), "text", "x0", (F.col("x0") + 5 * F.length("text")).alias("x1"), "top",
        (F.col("top") + size).alias("bottom"), size.alias("size"), F.when(F.col("ln") % 11 == 5, "Helvetica-Bold").otherwise("Helvetica").alias("fontname"), ((7 * F.col("wn") + F.col("ln")) % 100).cast("double").alias("conf"),
        F.lit(1).alias("block_num"), (F.col("ln") + 1).alias("par_num"), F.col("row").cast("int").alias("line_num"),
    )


def pages_of(words: DataFrame, source: str) -> DataFrame:
    """pages(doc_id, page_no, width, height, source) of typeset words."""
    return words.select("doc_id", "page_no").distinct().select("doc_id", "page_no", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.lit(source).alias("source"))
