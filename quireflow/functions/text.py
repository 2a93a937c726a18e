"""Column helpers on line and word texts.

Letters are \\p{L}, letters and digits [\\p{L}\\p{N}], white space (?U)\\s with the four separators U+001C to U+001F; these
classes follow Python's str methods, which the expected results are stated in.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns, glyph shares and limits that results depend on.
SPACE = r"[\s\u001c-\u001f]"
MARKER_ONLY = r"^(?:\d{1,3}[.)]|[•●▪◦·∙‣○■□►▶➢✓»¢©°«*+-])\z"
ORDERED = r"(?U)^(\d{1,3})[.)]\s+(\S.*)\z"
BULLET = r"(?U)^(?:[•●▪◦·∙‣○■□►▶➢✓»¢©°«]\s*|[-–—*+]\s+|[eo]\s+(?=[A-Z]))(\S.*)\z"
TERMINAL = r"[.!?:;]['\"”’)\]]?\z"
PAGE_LABEL = r"(?iU)^(?:page|pg\.?|p\.)\s*\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?\z"
PAGE_FRACTION = r"(?iU)^\d{1,4}\s*(?:of|/)\s*\d{1,4}\z"
BARE_PAGE = r"(?iU)^[-–—(\[]?\s*(?:\d{1,4}|[ivxlc]{1,6})\s*[-–—)\]]?\z"
EDGE_LABEL = r"(?iU)^page\s+(\d{1,4})(?:\s+of\s+\d{1,4})?\s+|\s+page\s+(\d{1,4})(?:\s+of\s+\d{1,4})?\z"
BOLD = r"(?iu)bold|black|heavy|semibold|demi"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", " ": " "}
MARGIN, LABEL_TOLERANCE = 0.1, 2
PREVIEW_CHARS = 20_000
#: White space of SPACE, one by one, and the ligatures: without any of them a word is as it should be.
TO_FOLD = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufb00-\ufb04]"


def rx(pattern: str) -> Column:
    return F.lit(pattern)


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """body(c) with c as one variable: however often body names it, the plan holds and computes it once."""
    return F.element_at(F.transform(F.array(c), body), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, rf"(?U){SPACE}+"), lambda x: x != "")


def n_words(c: Column) -> Column:
    return F.size(tokens(c))


def has_alnum(c: Column) -> Column:
    return c.rlike(r"[\p{L}\p{N}]")


def alnum_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def alpha_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def starts_lower(c: Column) -> Column:
    return c.rlike(r"^\p{IsLowercase}")


def is_terminal(c: Column) -> Column:
    return c.rlike(TERMINAL)


def is_marker(c: Column) -> Column:
    return c.rlike(MARKER_ONLY)


def glyph_size(text: Column, height: Column) -> Column:
    """Font size from a word box's height, by the shapes of its letters and digits; null without any."""
    tall, deep = text.rlike(r"[\p{IsUppercase}\p{Nd}bdfhijklt]"), text.rlike("[gjpqy]")
    share = F.when(tall & deep, 0.93).when(tall, 0.72).when(deep, 0.73).otherwise(0.52)
    return F.when(has_alnum(text), height / share)


def fold_ligatures(c: Column) -> Column:
    folded = c
    for glyph, letters in LIGATURES.items():
        folded = F.replace(folded, F.lit(glyph), F.lit(letters))
    return F.when(c.rlike(TO_FOLD), strip(folded)).otherwise(c)


def in_margin(top: Column, bottom: Column, height: Column) -> Column:
    return (bottom < height * MARGIN) | (top > height * (1 - MARGIN))


def header_key(c: Column) -> Column:
    return strip(F.regexp_replace(F.lower(c), r"\p{Nd}+", "#"))


def is_page_number(c: Column, margin: Column) -> Column:
    return let(strip(c), lambda t: t.rlike(PAGE_LABEL) | (margin & (t.rlike(PAGE_FRACTION) | t.rlike(BARE_PAGE))))


def strip_page_label(text: Column, page_no: Column, margin: Column) -> Column:
    """Takes out the first 'Page n' at an edge of the line, in a margin or if n is near the page's number."""

    def stripped(c: Column) -> Column:
        first, second = (F.regexp_extract(c, EDGE_LABEL, k) for k in (1, 2))
        n = F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit(""))).cast("int")
        # regexp_replace takes every match: only the found one may go.
        head = F.regexp_replace(c, r"(?iU)^page\s+(\d{1,4})(?:\s+of\s+\d{1,4})?\s+", "")
        tail = F.regexp_replace(c, r"(?iU)\s+page\s+(\d{1,4})(?:\s+of\s+\d{1,4})?\z", "")
        return F.when(n.isNotNull() & (margin | (F.abs(n - page_no) <= LABEL_TOLERANCE)), strip(F.when(first != "", head).otherwise(tail))).otherwise(c)

    return let(text, stripped)


def is_junk(text: Column, conf: Column, source: Column, alone: Column) -> Column:
    """Figure labels, axis ticks and recognition noise."""

    def judged(x: Column) -> Column:
        s, words = x["s"], x["words"]
        alnum, alpha, length = alnum_count(s), alpha_count(s), F.length(s)
        short = F.size(F.filter(words, lambda w: F.length(w) <= 2))
        noisy = (conf < 30) | ((conf < 55) & (alpha / length < 0.6)) | (alone & (alnum <= 2)) | ((F.size(words) >= 3) & (conf < 75) & (short / F.greatest(F.size(words), F.lit(1)) > 0.7))
        return F.when(length == 0, True).when(is_marker(s), False).when(alnum / length < 0.5, True).when(source != "ocr", False).otherwise(noisy)

    return let(text, lambda c: let(F.struct(F.regexp_replace(c, rf"(?U){SPACE}+", "").alias("s"), tokens(c).alias("words")), judged))


def escape_start(text: Column) -> Column:
    """Keeps paragraph text from reading as a list, heading or quote."""
    return let(
        text,
        lambda c: F.when(c.rlike(rf"(?U)^\d{{1,9}}[.)]({SPACE}|\z)"), F.regexp_replace(c, r"(?U)^(\d+)([.)])", r"$1\\$2"))
        .when(c.rlike(rf"(?U)^(#{{1,6}}|[>+*-])({SPACE}|\z)"), F.concat(F.lit("\\"), c))
        .otherwise(c),
    )


def safe_name(path: Column) -> Column:
    """A file name of word characters, dots and dashes; the extension in lower case."""
    base = F.substring_index(path, "/", -1)
    ext = F.regexp_extract(base, r"^.*[^.].*?(\.[^.]*)\z", 1)
    ext = F.when(base.rlike(r"^\.*[^.]+.*\.[^.]*\z"), F.regexp_extract(base, r"(\.[^.]*)\z", 1)).otherwise(F.lit(""))
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(ext))
    clean = F.regexp_replace(F.regexp_replace(stem, r"[^\p{L}\p{N}_.-]+", "_"), r"^[._]+|[._]+\z", "")
    return F.concat(F.when(clean == "", "document").otherwise(clean), F.lower(ext))


def preview(markdown: Column, limit: int = PREVIEW_CHARS) -> Column:
    """The text up to its last blank line before `limit` characters."""
    head = F.substring(markdown, 1, limit)
    tail = F.instr(F.reverse(head), "\n\n")
    cut_at = F.length(head) - tail - 1
    return F.when(F.length(markdown) <= limit, markdown).when((tail > 0) & (cut_at > 0), F.substring(markdown, F.lit(1), cut_at)).otherwise(head)


def content_key(content: Column, dpi: int, force_ocr: bool, lang: str, heading_ratio: float) -> Column:
    return F.concat_ws("|", F.sha2(content, 256), F.lit(str(dpi)), F.lit(str(force_ocr).lower()), F.lit(lang), F.lit(str(heading_ratio)))


def _joined(texts: list[str], known: frozenset[str]) -> str:
    """Joins lines one by one: soft hyphens vanish, a hyphen after a word is dropped only if the dictionary wants that.

    Only the token that ends the text so far can matter, so a list costs what its lines are long.
    """
    done: list[str] = []
    tail = ""  # the text so far from its last white space on, not yet in done
    for text in filter(None, map(str.strip, texts)):
        word = tail[:-1]
        if tail.endswith("­"):
            tail = word
        elif tail.endswith("-") and _ALNUM.search(word):
            left, right = (_EDGES.sub("", w).lower() for w in (word, text.split(None, 1)[0]))
            if left and right and left + right in known and f"{left}-{right}" not in known:
                tail = word
        elif done or tail:
            done.append(tail + " ")
            tail = ""
        *before, last = text.rsplit(None, 1)
        if before:
            done.append(tail + text[: len(text) - len(last)])
            tail = ""
        tail += last
    return "".join(done) + tail


_ALNUM, _EDGES = re.compile(r"[^\W_]"), re.compile(r"^\W+|\W+$")


def join_lines(texts: Column, dictionary: Broadcast) -> Column:
    """One string of an array of lines. Lists without a line-end hyphen stay in the JVM."""

    @F.pandas_udf("string")
    def repaired(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield lists.map(lambda x: None if x is None else _joined([t for t in x if t is not None], dictionary.value), na_action="ignore")

    # The UDF stays outside the variable: lambdas cannot hold one.
    ends = lambda xs: F.exists(xs, lambda x: strip(x).rlike("[-­]\\z"))
    whole = F.array_join(F.filter(F.transform(texts, strip), lambda x: x != ""), " ")
    return F.coalesce(repaired(F.when(ends(texts), texts)), whole)
