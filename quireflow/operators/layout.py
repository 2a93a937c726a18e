"""Words to lines, paragraphs and columns: gaps-and-islands over each page's reading order.

Every function keeps the partitioning by doc_id of its input, so a chain of them shuffles once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from quireflow.functions import text as X

#: Fixed limits of the layout analysis.
OVERLAP, X_TOLERANCE = 0.5, 1.0
GAP_STEP, GAP_SIZE, SHORT_LINE, SIZE_CHANGE, DEFAULT_STEP = 1.35, 1.25, 0.7, 0.15, 1.2
MIN_GUTTER, FREE_HEIGHT, MIN_SIDE, MAX_COLUMNS, MIN_WORDS = 0.012, 0.75, 0.15, 4, 30
BLOCKED = 1 - FREE_HEIGHT
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

PAGE, SHEET = ["doc_id", "page_no"], ["width", "height"]


def clean_text_words(words: DataFrame) -> DataFrame:
    """Text-layer words with ligatures spelt out, without blank ones."""
    return words.withColumn("text", X.fold_ligatures(F.col("text"))).where("text <> ''")


def ocr_words(tokens: DataFrame, dpi: int = 300) -> DataFrame:
    """Recognised tokens (level, left, top, width, height in pixels) as words in points."""
    scale = 72.0 / dpi
    kept = tokens.withColumn("text", X.strip(F.coalesce("text", F.lit("")))).where("level = 5 and text <> '' and conf >= 0")
    at = lambda c: F.col(c) * scale
    return kept.select(*PAGE, "word_idx", "text", at("left").alias("x0"), ((F.col("left") + F.col("width")) * scale).alias("x1"), at("top").alias("top"), ((F.col("top") + F.col("height")) * scale).alias("bottom"), X.glyph_size(F.col("text"), at("height")).alias("size"), "conf", "block_num", "par_num", "line_num")


def _ordered_text(order: str = "word_idx") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ")


def ocr_lines(words: DataFrame) -> DataFrame:
    """Lines of recognised words, in first-seen order, with the engine's paragraphs as groups."""
    keys = [*PAGE, "block_num", "par_num"]
    lines = words.groupBy(*keys, "line_num").agg(
        F.min("word_idx").alias("first"), _ordered_text().alias("text"), F.coalesce(F.median("size"), F.median(F.col("bottom") - F.col("top"))).alias("size"), F.avg("conf").alias("conf"),
        F.min("x0").alias("left"), F.min("top").alias("top"), F.max("x1").alias("right"), F.max("bottom").alias("bottom"), F.count("*").alias("words"), F.sum("conf").alias("conf_sum"),
    )
    group_first = F.min("first").over(Window.partitionBy(*keys))
    lines = lines.withColumn("group_first", group_first)
    page = Window.partitionBy(*PAGE)
    return lines.select(
        *PAGE, F.dense_rank().over(page.orderBy("group_first")).alias("group_idx"), F.row_number().over(page.orderBy("group_first", "first")).alias("line_idx"), "text", "size", "conf", "left", "top", "right", "bottom", F.lit(False).alias("bold"),
        (F.sum("conf_sum").over(page) / F.sum("words").over(page)).alias("page_conf"),
    )


def words_to_lines(words: DataFrame, chunk: str | None = None, carried: Sequence[str] = ()) -> DataFrame:
    """Lines of text-layer words in reading order: a word joins the line of the word before it if both overlap
    vertically by half the lower height and it does not step back. carried: columns of the page that its lines keep."""
    keys = [*PAGE, *([chunk] if chunk else [])]
    order = Window.partitionBy(*keys).orderBy("word_idx")
    lag = lambda c: F.lag(c).over(order)
    low = F.least(lag("bottom") - lag("top"), F.col("bottom") - F.col("top"))
    shared = F.least(lag("bottom"), F.col("bottom")) - F.greatest(lag("top"), F.col("top"))
    joins = (shared >= OVERLAP * F.when(low == 0, 1.0).otherwise(low)) & (F.col("x0") >= lag("x1") - X_TOLERANCE)
    marked = words.withColumn("starts", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    placed = marked.withColumn("line_idx", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    bold = F.coalesce(F.col("fontname"), F.lit("")).rlike(X.BOLD)
    return placed.groupBy(*keys, "line_idx").agg(
        _ordered_text().alias("text"), F.median("size").alias("size"), F.lit(100.0).alias("conf"), F.min("x0").alias("left"), F.min("top").alias("top"), F.max("x1").alias("right"), F.max("bottom").alias("bottom"), F.bool_and(bold).alias("bold"),
        *(F.max(c).alias(c) for c in carried),
    )


def refine_paragraphs(lines: DataFrame, use_font_changes: bool, scope: list[str] | None = None, group: str | None = None) -> DataFrame:
    """Adds para_idx: paragraphs break at group changes, steps up, large gaps, short closing lines and, for text layers, font changes.

    scope: columns of the page or column chunk whose medians set the measure; group: column of groups given beforehand.
    """
    scope = scope or PAGE
    whole = Window.partitionBy(*scope)
    order = whole.orderBy("line_idx")
    grouped = lines.withColumn("same_group", F.coalesce(F.lag(group).over(order) == F.col(group), F.lit(False)) if group else F.lag("line_idx").over(order).isNotNull())
    lag = lambda c: F.lag(c).over(order)
    stepped = grouped.withColumn("step", F.when(F.col("same_group"), F.col("top") - lag("top")))
    measured = stepped.withColumns({"m_step": F.median(F.when(F.col("step") > 0, F.col("step"))).over(whole), "m_size": F.median("size").over(whole), "m_width": F.median(F.col("right") - F.col("left")).over(whole)})
    typical = F.coalesce("m_step", F.col("m_size") * DEFAULT_STEP)
    size = F.greatest(lag("size"), F.col("size"))
    short = lag("text").rlike(r"[.!?:]\z") & ((lag("right") - lag("left")) < SHORT_LINE * F.col("m_width"))
    new = (F.col("step") <= 0) | (F.col("step") > F.greatest(GAP_STEP * typical, GAP_SIZE * size)) | short
    if use_font_changes:
        new = new | (F.abs(F.col("size") - lag("size")) > SIZE_CHANGE * size) | (F.col("bold") != lag("bold"))
    marked = measured.withColumn("new_para", F.when(~F.col("same_group") | new, 1).otherwise(0))
    return marked.withColumn("para_idx", F.sum("new_para").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("same_group", "step", "m_step", "m_size", "m_width", "new_para")


def page_words(words: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_no, width, words: one row per page with its words as an array.

    Words that carry their page's width need no pages and stay in the tasks where they lie; others meet their page as one row.
    Pages go to Python in batches of 2 MB, unless the session says otherwise.
    """
    if words.sparkSession.conf.get(BATCH, None) is None:
        words.sparkSession.conf.set(BATCH, "2m")
    sheet = [c for c in SHEET if c in words.columns] if "width" in words.columns else []
    rows = F.collect_list(F.struct(*(c for c in words.columns if c not in (*PAGE, *sheet)))).alias("words")
    if sheet:
        return words.groupBy(*PAGE).agg(*(F.max(c).alias(c) for c in sheet), rows)
    return words.groupBy(*PAGE).agg(rows).join(pages.groupBy(*PAGE).agg(F.max("width").alias("width")), PAGE, "left")


def _strips(x0: np.ndarray, x1: np.ndarray, top: np.ndarray, bottom: np.ndarray, width: float) -> np.ndarray:
    """The widest free strips of a page, left to right, as rows (a, b).

    Words block 1-point bins in the height slices they touch. Per slice the words' bins merge to islands; the islands' ends, summed
    from left to right, give the number of blocked slices between any two ends. Work grows with words, not with their width.
    """
    none, set_out = np.empty((0, 2)), np.isfinite(x0) & np.isfinite(x1) & np.isfinite(top) & np.isfinite(bottom)
    if len(x0) < MIN_WORDS or not set_out.any():
        return none
    x0, x1, top, bottom = (x[set_out] for x in (x0, x1, top, bottom))
    left, high, size = x0.min(), top.min(), max(np.median(bottom - top) / 2, 1.0)
    bins = int(np.ceil(x1.max() - left)) + 1
    first, last = (np.floor((y - high) / size).astype(np.int64) for y in (top, bottom))
    touched = np.maximum(last - first + 1, 0)
    word = np.repeat(np.arange(len(x0)), touched)
    row = np.arange(len(word)) - np.repeat(np.cumsum(touched) - touched, touched) + first[word]
    limit = BLOCKED * len(np.unique(row))
    starts, ends = np.floor(x0 - left).astype(np.int64), np.ceil(x1 - left).astype(np.int64)
    wide = (starts < ends)[word]
    word, base = word[wide], row[wide] * (bins + 1)
    order = np.argsort(base + starts[word], kind="stable")
    a, b, base = (base + starts[word])[order], (base + ends[word])[order], base[order]
    reach = np.maximum.accumulate(b) if len(b) else b
    at = np.flatnonzero(np.append(True, a[1:] > reach[:-1])) if len(a) else np.empty(0, np.int64)
    upto = np.append(at[1:], len(a))[: len(at)] - 1
    places, nth = np.unique(np.concatenate(([0, bins], a[at] - base[at], reach[upto] - base[at])), return_inverse=True)
    steps = np.bincount(nth, np.concatenate(([0, 0], np.ones(len(at)), -np.ones(len(at)))))
    free = np.concatenate(([0], np.cumsum(steps)[:-1] <= limit, [0]))
    edge = np.flatnonzero(np.diff(free))
    a, b = places[edge[::2]], places[edge[1::2]]
    kept = (a > 0) & (b < bins) & (b - a >= MIN_GUTTER * width)
    a, b = a[kept], b[kept]
    best = np.sort(np.lexsort((a, a - b))[: MAX_COLUMNS - 1])
    return np.column_stack((left + a[best], left + b[best]))


def _columns(strips: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """Per word the number of strips whose middle is at or left of its centre."""
    return ((strips.sum(axis=1) / 2)[None, :] <= ((x0 + x1) / 2)[:, None]).sum(axis=1)


def _gutters(x0: np.ndarray, x1: np.ndarray, top: np.ndarray, bottom: np.ndarray, width: float) -> np.ndarray:
    """Of the free strips those that part columns: the gutter beside the first thinnest column goes while that holds too few of the words."""
    strips = _strips(x0, x1, top, bottom, width)
    while len(strips):
        held = np.bincount(_columns(strips, x0, x1), minlength=len(strips) + 1)
        if held.min() >= MIN_SIDE * len(x0):
            break
        strips = np.delete(strips, min(held.argmin(), len(strips) - 1), axis=0)
    return strips


def _chunks(x0: np.ndarray, x1: np.ndarray, top: np.ndarray, bottom: np.ndarray, width: float, word_idx: np.ndarray) -> np.ndarray | None:
    """Per word of a page its column piece or full-width band; None without gutters. Words that cross a gutter make the bands."""
    strips = _gutters(x0, x1, top, bottom, width)
    if not len(strips):
        return None
    crosses = np.flatnonzero(((x0[:, None] < strips[:, 1]) & (x1[:, None] > strips[:, 0])).any(axis=1) & np.isfinite(top) & np.isfinite(bottom))
    crosses = crosses[np.lexsort((word_idx[crosses], top[crosses]))]
    column, middle = _columns(strips, x0, x1), (top + bottom) / 2
    if not len(crosses):
        return column
    a, b = top[crosses], bottom[crosses]
    at = np.flatnonzero(np.append(True, a[1:] > np.maximum.accumulate(b)[:-1]))
    a, b = np.append(a[at], np.inf), np.maximum.reduceat(b, at)
    section = np.where(np.isnan(middle), 0, np.searchsorted(b, middle))
    return section * (MAX_COLUMNS + 1) + np.where(a[section] <= middle, MAX_COLUMNS, column)


@F.pandas_udf(ArrayType(StructType([StructField("a", DoubleType()), StructField("b", DoubleType())])))
def _page_gutters(width: pd.Series, x0: pd.Series, x1: pd.Series, top: pd.Series, bottom: pd.Series) -> pd.Series:
    return pd.Series([[{"a": a, "b": b} for a, b in _gutters(*page).tolist()] for page in zip(x0, x1, top, bottom, width)], dtype=object)


@F.pandas_udf(ArrayType(IntegerType()))
def _page_chunks(width: pd.Series, x0: pd.Series, x1: pd.Series, top: pd.Series, bottom: pd.Series, word_idx: pd.Series) -> pd.Series:
    return pd.Series([_chunks(*page) for page in zip(x0, x1, top, bottom, width, word_idx)], dtype=object)


def find_gutters(words: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_no, gutters: vertical strips [a, b] that separate the columns of a page, left to right."""
    geometry = page_words(words.select(*(c for c in words.columns if c in (*PAGE, "x0", "x1", "top", "bottom", "width"))), pages)
    return geometry.select(*PAGE, _page_gutters("width", "words.x0", "words.x1", "words.top", "words.bottom").alias("gutters")).where(F.size("gutters") > 0)


def column_chunks(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds chunk: reading order of column pieces and full-width bands; pages without gutters are one chunk."""
    chunks = _page_chunks("width", "words.x0", "words.x1", "words.top", "words.bottom", "words.word_idx")
    placed = page_words(words, pages).withColumn("chunks", F.coalesce(chunks, F.expr("cast(array() as array<int>)")))
    whole = [c for c in words.columns if c in placed.columns]
    rows = placed.select(*whole, F.explode(F.arrays_zip("words", "chunks")).alias("w"))
    return rows.select(*(c if c in whole else F.col(f"w.words.{c}").alias(c) for c in words.columns), F.coalesce("w.chunks", F.lit(0)).alias("chunk"))


def text_layer_lines(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines and paragraphs of text-layer words, columns first; a sentence that goes on in the next chunk keeps its paragraph.
    Lines keep the width and height of their page if words carry them."""
    needed = (*PAGE, *SHEET, "word_idx", "text", "x0", "x1", "top", "bottom", "size", "fontname")
    chunked = column_chunks(clean_text_words(words.select(*(c for c in words.columns if c in needed))), pages)
    lines = refine_paragraphs(words_to_lines(chunked, "chunk", [c for c in SHEET if c in words.columns]), True, [*PAGE, "chunk"])
    order = Window.partitionBy(*PAGE).orderBy("chunk", "line_idx")
    lag = lambda c: F.lag(c).over(order)
    first = F.coalesce(lag("chunk") != F.col("chunk"), F.lit(True))
    goes_on = first & lag("text").isNotNull() & ~X.is_terminal(lag("text")) & X.starts_lower(F.col("text"))
    breaks = F.when(goes_on, 0).when(first | (F.col("para_idx") != lag("para_idx")), 1).otherwise(0)
    whole = order.rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("breaks", breaks).withColumn("para", F.sum("breaks").over(whole).cast("int")).withColumn("line", F.row_number().over(order)).drop("para_idx", "line_idx", "breaks", "chunk").withColumnsRenamed({"para": "para_idx", "line": "line_idx"})
