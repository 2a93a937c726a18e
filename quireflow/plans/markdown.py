"""The whole plan: positioned words and pages to Markdown per document."""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.operators import clean, layout, render, structure
from quireflow.scratch import cut


def structured_lines(words: DataFrame, pages: DataFrame, source: str, columns: bool = True) -> DataFrame:
    """Lines with paragraphs, page size and source of one kind of words."""
    if source == "ocr":
        lines = layout.refine_paragraphs(layout.ocr_lines(words), False, group="group_idx").drop("group_idx", "page_conf")
    elif columns:
        lines = layout.text_layer_lines(words, pages)
    else:
        lines = layout.refine_paragraphs(layout.words_to_lines(layout.clean_text_words(words)), True)
    if not set(layout.SHEET) <= set(lines.columns):
        lines = lines.drop(*layout.SHEET).join(pages.select("doc_id", "page_no", "width", "height"), ["doc_id", "page_no"])
    return lines.withColumn("source", F.lit(source))


def blocks_of(lines: DataFrame, sizes: DataFrame, dictionary: Broadcast, ratio: float = 1.5) -> DataFrame:
    """Cleaned lines to merged blocks; sizes: body_sizes."""
    sized = lines.join(sizes, ["doc_id", "source"], "left").withColumn("body", F.coalesce("body", F.lit(1.0)))
    groups = structure.grouped_lines(structure.size_groups(sized, ratio), dictionary)
    return structure.merge_blocks(structure.heading_levels(structure.to_blocks(groups, dictionary, ratio)), dictionary)


def build_markdown(words: DataFrame, pages: DataFrame, dictionary: Broadcast, ratio: float = 1.5, source: str = "text", columns: bool = True) -> DataFrame:
    """doc_id, markdown. Lines and body sizes are written to the shared folder once, then merged blocks: each part is a short plan.

    Words are read twice, for lines and for sizes, where they carry the width and height of their page; else a third time for pages made from them.
    """
    lines = cut(structured_lines(words, pages, source, columns))
    sizes = cut(structure.body_sizes(words.withColumn("source", F.lit(source))))
    blocks = cut(blocks_of(clean.clean_pages(lines), sizes, dictionary, ratio))
    return render.render(render.block_markdown(blocks, dictionary))
