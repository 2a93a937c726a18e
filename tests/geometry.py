"""Builders of lines and words for structure tests: one dict per line or word, with the usual geometry as defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.operators import clean, render
from quireflow.plans import markdown
from quireflow.sources import wordlist

LINE = "doc_id long, page_no int, para_idx int, line_idx int, text string, size double, conf double, left double, top double, right double, bottom double, bold boolean, width double, height double, source string"
WORD = "doc_id long, page_no int, word_idx long, text string, x0 double, x1 double, top double, bottom double, size double, fontname string"


def line(text: str, size: float = 11.0, conf: float = 95.0, left: float = 72.0, top: float = 100.0, right: float = 500.0, bold: bool = False) -> dict:
    return {"text": text, "size": float(size), "conf": float(conf), "left": float(left), "top": float(top), "right": float(right), "bottom": float(top + size), "bold": bold}


def lines_frame(spark: SparkSession, pages: list[list[list[dict]]], source: str = "ocr", doc_id: int = 1, first_page: int = 1) -> DataFrame:
    """pages of paragraphs of lines."""
    rows = []
    for number, paras in enumerate(pages, first_page):
        at = 0
        for para_idx, para in enumerate(paras):
            for x in para:
                at += 1
                rows.append((doc_id, number, para_idx, at, *(x[c] for c in ("text", "size", "conf", "left", "top", "right", "bottom", "bold")), 612.0, 792.0, source))
    return spark.createDataFrame(rows, LINE)


def to_markdown(spark: SparkSession, pages: list[list[list[dict]]], words: set[str] = frozenset(), source: str = "ocr", ratio: float = 1.5, first_page: int = 1) -> str:
    """Markdown of one document; the body size is the median over whitespace tokens."""
    lines = lines_frame(spark, pages, source, first_page=first_page)
    known = wordlist.dictionary(spark.createDataFrame([(w,) for w in words], "word string"), spark)
    sizes = lines.select("doc_id", "source", "size", F.explode(F.split("text", " ")).alias("w")).groupBy("doc_id", "source").agg(F.median("size").alias("body"))
    rows = render.render(render.block_markdown(markdown.blocks_of(clean.clean_pages(lines), sizes, known, ratio), known)).collect()
    return rows[0].markdown if rows else ""


def set_words(text: str, x: float, width: float, top: float = 60.0, size: float = 10.0, char_w: float = 5.0) -> list[list[dict]]:
    """Rows of words, wrapped at the column's width."""
    rows, at = [[]], x
    for w in text.split():
        if at > x and at + char_w * len(w) > x + width:
            rows.append([])
            at = x
        y = top + 1.2 * size * (len(rows) - 1)
        rows[-1].append({"text": w, "x0": at, "x1": at + char_w * len(w), "top": y, "bottom": y + size, "size": size, "fontname": "Helvetica"})
        at += char_w * len(w) + char_w
    return rows


def words_frame(spark: SparkSession, words: list[dict], doc_id: int = 1, page_no: int = 1) -> DataFrame:
    return spark.createDataFrame([(doc_id, page_no, k, w["text"], float(w["x0"]), float(w["x1"]), float(w["top"]), float(w["bottom"]), float(w["size"]), w["fontname"]) for k, w in enumerate(words)], WORD)


def page_frame(spark: SparkSession, doc_id: int = 1, page_no: int = 1) -> DataFrame:
    return spark.createDataFrame([(doc_id, page_no, 612.0, 792.0, "text")], "doc_id long, page_no int, width double, height double, source string")
