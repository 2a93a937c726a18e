"""Lines to blocks: size groups, headings and their tiers, lists, and merges across fragments and pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quireflow.functions import text as X
from quireflow.functions.text import _joined
from quireflow.operators.layout import PAGE

#: Fixed limits.
JUMP, MINOR, BOLD_REL = 1.2, 1.2, 0.95
MAX_WORDS, MAX_LINES, MINOR_WORDS, BOLD_WORDS = 25, 4, 10, 12
TIER, TIER_EPSILON, MAX_LEVEL, MERGE_GAP = 0.88, 1e-9, 3, 1.2
BLOCKS = 1 << 31  # above the number of lists in any one group

BLOCK = "doc_id long, page_no int, block_idx long, kind string, text string, level int, items array<struct<n:int,parts:array<string>>>, rel double, top double, bottom double, size double"


def body_sizes(words: DataFrame) -> DataFrame:
    """doc_id, source, body: the exact median of word sizes, before any cleaning."""
    return words.where(F.col("size").isNotNull() & X.has_alnum(F.col("text"))).groupBy("doc_id", "source").agg(F.median("size").alias("body"))


def size_groups(lines: DataFrame, ratio: float = 1.5) -> DataFrame:
    """Adds grp: inside a paragraph a new group starts where neighbouring sizes differ by a fifth and one is a heading's. Needs body."""
    order = Window.partitionBy(*PAGE, "para_idx").orderBy("line_idx")
    before = F.lag("size").over(order)
    high, low = F.greatest(before, F.col("size")), F.greatest(F.least(before, F.col("size")), F.lit(1e-6))
    jump = F.coalesce((high / F.col("body") >= min(MINOR, ratio)) & (high / low > JUMP), F.lit(False))
    return lines.withColumn("jump", F.when(jump, 1).otherwise(0)).withColumn("grp", F.sum("jump").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("jump")


def grouped_lines(lines: DataFrame, dictionary: Broadcast) -> DataFrame:
    """One row per size group: its lines in order, joined text, geometry."""
    groups = lines.groupBy(*PAGE, "source", "para_idx", "grp").agg(
        F.array_sort(F.collect_list(F.struct("line_idx", "text"))).alias("ordered"), F.median("size").alias("size"), F.first("body").alias("body"), F.min_by("top", "line_idx").alias("top"), F.max_by("bottom", "line_idx").alias("bottom"), F.bool_and("bold").alias("bold"), F.min("line_idx").alias("first_line"),
    )
    texts = groups.withColumn("lines", F.transform("ordered", lambda x: x["text"])).drop("ordered")
    return texts.withColumn("text", X.join_lines(F.col("lines"), dictionary)).withColumn("rel", F.when(F.col("body") != 0, F.col("size") / F.col("body")).otherwise(1.0))


def is_heading(ratio: float = 1.5) -> Column:
    """Of a row of grouped_lines."""
    count, rel = F.size("lines"), F.col("rel")

    def judged(t: Column) -> Column:
        n = X.n_words(t)
        large = (rel >= ratio) & (n <= MAX_WORDS) & (count <= MAX_LINES)
        minor = (rel >= MINOR) & (count == 1) & (n <= MINOR_WORDS) & ~t.rlike(r"[.,;]\z")
        bold = (F.col("source") == "text") & F.col("bold") & (count == 1) & (n <= BOLD_WORDS) & (rel >= BOLD_REL) & ~t.endswith(".")
        return (X.alpha_count(t) >= 2) & (large | minor | bold)

    return X.let(F.col("text"), judged)


def read_lines(lines: str = "lines") -> Column:
    """Array of (t, n, bullet) per line: its text, its number if it begins with one, and what follows its bullet. Each pattern is tried once."""
    return F.transform(lines, lambda x: X.let(X.strip(x), lambda t: F.struct(t.alias("t"), F.nullif(F.regexp_extract(t, X.ORDERED, 1), F.lit("")).cast("int").alias("n"), F.nullif(F.regexp_extract(t, X.BULLET, 1), F.lit("")).alias("bullet"))))


def list_states(read: str | Column = "read") -> Column:
    """Array of (kind, n, text, at) per line of read_lines: what each line is in the lists of its paragraph.

    kind: 'p' plain before any list, 'ol'/'ul' a new item, '+' a continuation of the item before; at: number of the list in
    the paragraph (0 before any). A paragraph is plain lines, then a bulleted list, then a numbered list, each of which may be
    missing: bullets end at the first line numbered 1, and nothing ends a numbered list. So two places and the places of the
    accepted numbers decide every line alone. Numbers have three digits, so that the only array that grows has 1,000 entries at
    most, and the work is linear in the lines.
    """
    place = lambda xs, test: F.array_position(F.transform(xs, test), True).cast("int")  # noqa: E731  0: none
    marked = lambda x, i: x["bullet"].isNotNull() | (x["n"].isNotNull() & ((i == 0) | (x["n"] == 1)))

    def numbered(xs: Column, start: Column, bullets: Column) -> Column:
        """Place (from 1) of the line that opens the numbered list, 0 without one."""
        return F.when(start == 0, 0).when(~bullets, start).otherwise(place(xs, lambda x, i: F.coalesce((i >= start) & (x["n"] == 1), F.lit(False))))

    def accepted(xs: Column, opens: Column) -> Column:
        """Places (from 1) of the numbered items in order: each is one more than the one before."""
        zero = F.from_json(F.lit('{"i":0,"want":0,"at":[]}'), "struct<i:int,want:int,at:array<int>>")

        def step(s: Column, x: Column) -> Column:
            here = s["i"] + 1
            takes = F.coalesce((opens > 0) & ((here == opens) | ((here > opens) & (x["n"] == s["want"]))), F.lit(False))
            return F.struct(here.alias("i"), F.when(takes, x["n"] + 1).otherwise(s["want"]).alias("want"), F.when(takes, F.concat(s["at"], F.array(here))).otherwise(s["at"]).alias("at"))

        return F.aggregate(xs, zero, step, lambda s: s["at"])

    def labelled(xs: Column, start: Column, opens: Column, items: Column, first: Column) -> Column:
        def line(x: Column, i: Column) -> Column:
            here = i + 1
            bulleted = (opens == 0) | (here < opens)
            number = F.coalesce(F.get(items, x["n"] - first) == here, F.lit(False))
            kind = F.when((start == 0) | (here < start), "p").when(bulleted, F.when(x["bullet"].isNotNull(), "ul").otherwise("+")).otherwise(F.when(number, "ol").otherwise("+"))
            at = F.when((start == 0) | (here < start), 0).when(bulleted | (opens == start), 1).otherwise(2)
            text = lambda k: F.when(k == "ol", F.regexp_extract(x["t"], X.ORDERED, 2)).when(k == "ul", x["bullet"]).otherwise(x["t"])
            return X.let(kind, lambda k: F.struct(k.alias("kind"), F.when(k == "ol", x["n"]).alias("n"), text(k).alias("text"), at.alias("at")))

        return F.transform(xs, line)

    def states(xs: Column) -> Column:
        # Each step's results are one variable of the next: an expression named inside a lambda would be computed per line.
        starts = X.let(place(xs, marked), lambda start: F.struct(start.alias("start"), numbered(xs, start, F.get(xs, start - 1)["bullet"].isNotNull()).alias("opens")))
        chain = X.let(starts, lambda s: F.struct(s["start"].alias("start"), s["opens"].alias("opens"), accepted(xs, s["opens"]).alias("items"), F.get(xs, s["opens"] - 1)["n"].alias("first")))
        return X.let(chain, lambda c: labelled(xs, c["start"], c["opens"], c["items"], c["first"]))

    return X.let(F.col(read) if isinstance(read, str) else read, states)


def split_merged_items(n: int | None, text: str) -> list[tuple[int | None, str]]:
    """'1. Apples 2. Pears' on one line is two items."""
    out = []
    while n is not None and (found := re.search(rf"\s{n + 1}[.)]\s+(?=[A-Z0-9\"'“‘(])", text)):
        out.append((n, text[: found.start()].strip()))
        n, text = n + 1, text[found.end() :]
    return [*out, (n, text)]


_ITEMS = "array<struct<n:int,parts:array<string>>>"
_MADE = f"array<struct<pos:long,kind:string,text:string,items:{_ITEMS}>>"


def to_blocks(groups: DataFrame, dictionary: Broadcast, ratio: float = 1.5) -> DataFrame:
    """Headings, paragraphs and lists of each size group, in order (block_idx)."""

    @F.pandas_udf(_MADE)
    def lists(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for states in batches:
            yield states.map(lambda rows: _lists(rows, dictionary.value), na_action="ignore")

    # Groups without a marker, most of them, are their joined text; only those with a list leave the JVM.
    marked = groups.withColumn("read", read_lines()).withColumn("states", F.when(F.exists("read", lambda x: x["n"].isNotNull() | x["bullet"].isNotNull()), list_states()))
    listed = marked.withColumn("listed", lists(F.when(F.exists("states", lambda x: x["at"] > 0), F.col("states"))))
    block = lambda kind, text: F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit(kind).alias("kind"), text.alias("text"), F.expr(f"cast(null as {_ITEMS})").alias("items")))
    made = F.when(is_heading(ratio), block("h", X.strip(F.regexp_replace("text", r"#+\z", "")))).when(F.col("listed").isNotNull(), F.col("listed")).otherwise(block("p", F.col("text")))
    rows = listed.select("doc_id", "page_no", "rel", "top", "bottom", "size", "first_line", F.explode(made).alias("b"))
    return rows.select("doc_id", "page_no", "rel", "top", "bottom", "size", (F.col("first_line").cast("long") * BLOCKS + F.col("b.pos")).alias("block_idx"), F.col("b.kind").alias("kind"), F.col("b.text").alias("text"), F.col("b.items").alias("items"), F.lit(0).alias("level"))


def _lists(rows: list, known: frozenset[str]) -> list[dict]:
    """The blocks of one group's line states: the text before any list, then each list."""
    plain, found = [row["text"] for row in rows if row["kind"] == "p"], {}
    for row in rows:
        if row["kind"] in ("ol", "ul"):
            made = found.setdefault(row["at"], {"pos": row["at"], "kind": row["kind"], "text": "", "items": []})
            made["items"].append({"n": None if row["kind"] == "ul" else int(row["n"]), "parts": [row["text"]]})
        elif row["kind"] == "+":
            found[row["at"]]["items"][-1]["parts"].append(row["text"])
    for made in found.values():
        if made["kind"] == "ol":
            made["items"] = [{"n": n, "parts": [t]} for x in made["items"] for n, t in split_merged_items(x["n"], _joined(x["parts"], known))]
    before = [{"pos": 0, "kind": "p", "text": _joined(plain, known), "items": None}] if plain else []
    return before + list(found.values())


@F.pandas_udf(DoubleType())
def _round3(values: pd.Series) -> pd.Series:
    """Rounds the exact binary value, ties to even, as no built-in does; null for all but headings."""
    return values.map(lambda x: round(float(x), 3), na_action="ignore")


def heading_tiers(sizes: Column) -> Column:
    """Greedy descending tiers of an array of distinct heading sizes."""
    none = F.expr("cast(array() as array<double>)")
    return F.aggregate(F.sort_array(sizes, asc=False), none, lambda t, x: F.when((F.size(t) == 0) | (x < F.element_at(t, -1) * TIER), F.concat(t, F.array(x))).otherwise(t))


def heading_levels(blocks: DataFrame) -> DataFrame:
    """Blocks with the level of each heading: its tier, 3 at most; body-size headings below all larger tiers."""
    rounded = blocks.withColumn("r", _round3(F.when(F.col("kind") == "h", F.col("rel"))))
    known = rounded.withColumn("sizes", F.collect_set("r").over(Window.partitionBy("doc_id"))).withColumn("tiers", F.when(F.col("kind") == "h", heading_tiers(F.col("sizes"))))
    fits = F.array_position(F.transform("tiers", lambda t: F.col("rel") >= t * TIER - TIER_EPSILON), True)
    tier = F.least(F.when(fits > 0, fits).otherwise(F.size("tiers")), F.lit(MAX_LEVEL))
    larger = F.size(F.filter("tiers", lambda t: t >= MINOR))
    small = F.least(F.greatest(larger + 1, F.lit(2)), F.lit(MAX_LEVEL))
    return known.withColumn("level", F.when(F.col("kind") == "h", F.when(F.col("rel") < MINOR, small).otherwise(tier)).otherwise(0).cast("int")).drop("r", "sizes", "tiers")


def ending(done: Column, text: Column) -> Column:
    """The last three characters of a text (its own last three: done) after one more line, enough to tell whether a sentence ends there."""
    return X.let(X.strip(text), lambda t: F.when(t == "", done).otherwise(F.right(F.when(done == "", t).when(F.endswith(done, F.lit("\u00ad")), F.concat(F.left(done, F.length(done) - 1), t)).otherwise(F.concat(done, F.lit(" "), t)), F.lit(3))))


def _homes(run: Column) -> Column:
    """Per row of an array of heading fragments of a page (block_idx, top, bottom, size, text): the block_idx of the row that it joins, itself otherwise."""
    zero = F.from_json(F.lit('{"home":null,"size":0,"bottom":0,"ends":"","out":[]}'), "struct<home:long,size:double,bottom:double,ends:string,out:array<long>>")

    def step(s: Column, x: Column) -> Column:
        near = F.coalesce(x["top"] - s["bottom"] < MERGE_GAP * F.greatest(s["size"], x["size"]), F.lit(False))
        joins = s["home"].isNotNull() & near & ~X.is_terminal(s["ends"])
        return X.let(F.struct(joins.alias("joins"), F.when(joins, s["home"]).otherwise(x["block_idx"]).alias("home")), lambda m: F.struct(
            m["home"].alias("home"), F.when(m["joins"], s["size"]).otherwise(x["size"]).alias("size"), x["bottom"].alias("bottom"),
            ending(F.when(m["joins"], s["ends"]).otherwise(F.lit("")), x["text"]).alias("ends"), F.concat(s["out"], F.array(m["home"])).alias("out"),
        ))

    return F.aggregate(run, zero, step, lambda s: s["out"])


def _page_links(rows: DataFrame) -> DataFrame:
    """doc_id, page_no, block_idx, to_page, to_idx: each page's first block that goes on with the block before it, and the block where that text begins.

    One small row per page stands for it: how its first block begins and its last one ends. A page of one block that goes on
    hands the text's beginning to the next page, so a running last value over the pages finds it; no text takes part.
    """
    parts = F.when(F.col("kind").isin("ol", "ul"), F.element_at("items", -1)["parts"]).otherwise(F.array("text"))
    ends = F.aggregate(parts, F.lit(""), lambda s, x: ending(s, F.coalesce(x, F.lit(""))))
    told = rows.select("doc_id", "page_no", "block_idx", "home", "kind", ((F.col("kind") == "p") & X.starts_lower(F.col("text"))).alias("goes_on"), ((F.col("kind") != "h") & ~X.is_terminal(ends)).alias("open"))
    sums = told.groupBy("doc_id", "page_no").agg(F.count("*").alias("n"), F.min_by(F.struct("block_idx", "goes_on"), "block_idx").alias("head"), F.max_by(F.struct("home", "open"), "block_idx").alias("tail"))
    pages = Window.partitionBy("doc_id").orderBy("page_no")
    follows = F.coalesce((F.lag("page_no").over(pages) == F.col("page_no") - 1) & F.lag("tail.open").over(pages) & F.col("head.goes_on"), F.lit(False))
    linked = sums.withColumn("follows", follows)
    begins = F.last(F.when(~F.col("follows") | (F.col("n") > 1), F.struct("page_no", F.col("tail.home").alias("home"))), ignorenulls=True)
    return linked.withColumn("to", begins.over(pages.rowsBetween(Window.unboundedPreceding, -1))).where("follows").select("doc_id", "page_no", F.col("head.block_idx").alias("block_idx"), F.col("to.page_no").alias("to_page"), F.col("to.home").alias("to_idx"))


def merge_blocks(blocks: DataFrame, dictionary: Broadcast) -> DataFrame:
    """Heading fragments of a page, and paragraphs and items that go on on the next page, join the block where they begin.

    page_no becomes the page where a block ends; first_page is where it begins and, with block_idx, gives the order. Whether a
    block joins depends on its neighbours, on heading fragments of the same page, and on how the page before ends: pages are
    worked on apart, and only a row of a few numbers per page meets the other pages of its document. A document's blocks may so
    lie in any number of tasks. Null text is empty text, null geometry joins no heading, null doc_ids join nothing. Blocks of one page need different block_idx.
    """
    columns = ["kind", "text", "level", "items", "rel", "top", "bottom", "size"]
    page = Window.partitionBy("doc_id", "page_no").orderBy("block_idx")
    before = lambda c: F.lag(c).over(page)
    beside = F.coalesce((F.col("kind") == "h") & (before("kind") == "h") & (before("level") == F.col("level")) & (F.col("top") >= before("bottom")), F.lit(False))
    numbered = blocks.select("doc_id", "page_no", "block_idx", *columns).withColumn("run", F.sum(F.when(beside, 0).otherwise(1)).over(page.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("doc_id", "page_no", "run").agg(F.sort_array(F.collect_list(F.struct("block_idx", *columns))).alias("rows"))
    homes = F.when(F.size("rows") > 1, _homes(F.col("rows"))).otherwise(F.transform("rows", lambda x: x["block_idx"]))
    rows = runs.select("doc_id", "page_no", F.explode(F.arrays_zip(F.col("rows").alias("row"), homes.alias("home"))).alias("x")).select("doc_id", "page_no", "x.row.*", "x.home")
    links = _page_links(rows)
    # Joined by page, as rows already lie: their texts do not travel for it.
    met = rows.join(links.withColumnRenamed("block_idx", "linked"), ["doc_id", "page_no"], "left")
    linked = lambda there, own: F.when(F.col("block_idx") == F.col("linked"), F.col(there)).otherwise(F.col(own))
    placed = met.select("doc_id", linked("to_page", "page_no").alias("first_page"), linked("to_idx", "home").alias("first_idx"), F.struct("page_no", "block_idx", *columns).alias("row"))
    groups = placed.groupBy("doc_id", "first_page", "first_idx").agg(F.collect_list("row").alias("rows"))
    ordered = groups.withColumn("rows", F.sort_array("rows"))
    texts = F.transform("rows", lambda x: x["text"])
    head, tail, many, listed = F.get("rows", F.lit(0)), F.element_at("rows", -1), F.size("rows") > 1, F.get("rows", F.lit(0))["kind"].isin("ol", "ul")
    joined = ordered.withColumn("joined", X.join_lines(F.when(many & ~listed, texts), dictionary))
    items = head["items"]
    longer = F.concat(F.slice(items, F.lit(1), F.size(items) - 1), F.array(F.struct(F.element_at(items, -1)["n"].alias("n"), F.concat(F.element_at(items, -1)["parts"], F.slice(texts, F.lit(2), F.size("rows"))).alias("parts"))))
    return joined.select(
        "doc_id", tail["page_no"].alias("page_no"), F.col("first_idx").alias("block_idx"), head["kind"].alias("kind"), F.coalesce("joined", head["text"]).alias("text"), head["level"].alias("level"),
        F.when(many & listed, longer).otherwise(items).alias("items"), head["rel"].alias("rel"), head["top"].alias("top"), F.when(head["kind"] == "h", tail["bottom"]).otherwise(head["bottom"]).alias("bottom"), head["size"].alias("size"), F.col("first_page"),
    )
