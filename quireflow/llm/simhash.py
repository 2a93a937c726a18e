"""SimHash near-duplicate groups by pigeonring filtering.

Fingerprints: words are runs without the six ASCII spaces, A-Z lower-cased; shingles are word triples with repeats
(fewer words: the whole sequence); a bit is 1 if it is set in more than half of the shingles' XXH64 values (seed 42).

Search: 64 bits are three segments in a ring. Two fingerprints within 2 bits have, by the pigeonring principle, a start
segment whose chain of cumulative differences stays within l * 2/3 for every length l: 0 in one segment, at most 1 over
two, at most 2 over all three. So each fingerprint is stored under its three (segment, next segment) pairs and looked up
under the exact pair and those with one bit of the second segment turned; the full Hamming check follows. Keys have 42
or 43 bits, so chance partners stay few at any corpus size. Copies share a fingerprint and are joined once.

The pipeline's stage asks for a Jaccard similarity of word runs (see similar_texts). It searches fingerprints of those runs
in the same way in a ring of six segments, for pairs within 5 bits, and checks the texts of each pair exactly. At similarity
0.8 about 10 of 64 bits differ, and a radius that wide leaves segments too short to select by: what lies beyond 5 bits comes
from bands of least shingle hashes, all of which are compared unless the fingerprints have connected them.

Null and empty texts have fingerprint 0 and link like any other. Null ids take no part in the choice of the smallest id
unless the whole group has none; ties go by text hash. Every repeated row gets its row. Very long texts are scanned whole. Empty tables
give none. Input columns named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireflow.llm.common import NUL_WORD, SPACES, append_columns, blocks, connected_components, cut, key_filter, mixed, possible, prefix_sums, scope, slice_hash, spread_join, word_spans, word_table

SHINGLE, SEED, RADIUS = 3, 42, 2
SEGMENTS = ((0, 21), (21, 21), (42, 22))  # first bit and width
WIDE = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))  # the stage's ring
_WORDS = word_table(True, SPACES)
_XXH = xxhash.xxh64_intdigest
#: Bands and least hashes in each (a pair of Jaccard similarity s shares a band with chance 1 - (1 - s**ROWS)**BANDS: 0.9993 at 0.8); the odd factors permute the hashes.
BANDS, ROWS = 24, 6
STAR, TILE = 512, 128  # nodes that one task compares with a group's head, and in one block of a tile
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text, the 64-bit majority of its hashes (0 for none)."""
    out = np.zeros(len(first) - 1, np.uint64)
    for k in range(len(out)):
        n = int(first[k + 1] - first[k])
        if n:
            ones = np.zeros(64, np.int64)
            for at in range(int(first[k]), int(first[k + 1]), 1 << 14):
                part = hashes[at : min(at + (1 << 14), int(first[k + 1]))]
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[k] = np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]
    return out


def shingles(data: np.ndarray, starts: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of a block end to end, begin and end of each shingle there, shingles before each text and in all, where each text's words begin)."""
    kept = _WORDS[data]
    begin, end, first = word_spans(kept, starts)
    # Words end to end, one space after each: a shingle is one slice.
    length = end - begin + 1
    at = np.concatenate([[0], np.cumsum(length)])
    joined = np.full(int(at[-1]), 32, np.uint8)
    mask = np.ones(int(at[-1]), bool)
    mask[at[1:] - 1] = False
    joined[mask] = kept[kept != 0]
    joined[joined == NUL_WORD] = 0
    words = np.diff(first)
    count = np.where(words > 0, np.maximum(1, words - shingle + 1), 0)
    owner_first = np.concatenate([[0], np.cumsum(count)])
    heads = np.arange(owner_first[-1]) - np.repeat(owner_first[:-1], count) + np.repeat(first[:-1], count)
    tails = np.minimum(heads + shingle, np.repeat(first[1:], count))
    return joined, at[heads], at[tails] - 1, owner_first, at[first]


def simhash(data: np.ndarray, starts: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints of the texts of a block."""
    joined, begin, end, first, _ = shingles(data, starts, shingle)
    text = joined.tobytes()
    hashes = np.fromiter((_XXH(text[a:b], SEED) for a, b in zip(begin.tolist(), end.tolist())), np.uint64, len(begin))
    return _majority(hashes, first)


def with_simhash(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The documents with their fingerprint as a long column simhash."""
    docs = docs.drop("simhash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, starts in blocks(batches, "text"):
            yield append_columns(rows, simhash=pa.array(simhash(data, starts, shingle).view(np.int64)))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("simhash", T.LongType())]))


def linked_fingerprints(prints: DataFrame, segments: tuple[tuple[int, int], ...] = SEGMENTS) -> DataFrame:
    """a < b of each pair of the distinct fingerprints (column simhash) that differ in fewer bits than the ring has segments, each pair once or more.

    A radius one below the number of segments allows l - 1 differences (rounded down) over l segments of the chain: none in the first, one over two.
    """
    ring = len(segments)
    ends = lambda k: f"{k} as start, {segments[k][0]} as s, {(1 << segments[k][1]) - 1}L as m, {segments[(k + 1) % ring][0]} as t, {(1 << segments[(k + 1) % ring][1]) - 1}L as n"
    # chain key: start segment, both segments' bits; the list of starts and flips is one constant
    chain = "shiftleft(shiftrightunsigned(simhash, s) & m, 22) | ((shiftrightunsigned(simhash, t) & n) ^ flip)"
    keyed = lambda name, flips: prints.selectExpr("simhash", "inline(array({}))".format(", ".join(f"struct({ends(k)}, {flip}L as flip)" for k in range(ring) for flip in flips(k)))).selectExpr(f"simhash as {name}", "start", f"{chain} as chain")
    index = keyed("b", lambda k: [0])
    probes = keyed("a", lambda k: [0, *(1 << j for j in range(segments[(k + 1) % ring][1]))])
    far = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    # Differences are symmetric: the lesser fingerprint's own look-ups find every pair.
    return probes.join(index, ["start", "chain"]).where((F.col("a") < F.col("b")) & (far < ring)).select("a", "b")


def simhash_groups(prints: DataFrame) -> DataFrame:
    """id, simhash -> id, simhash, component_id: the smallest id of the group that links of 2 bits or fewer connect."""
    ids = cut(prints.groupBy("simhash").agg(F.min("doc_id").alias("least")))
    parts = connected_components(linked_fingerprints(ids.select("simhash")).distinct())
    grouped = ids.join(parts, F.col("simhash") == F.col("node"), "left").select("simhash", "least", F.coalesce("component", "simhash").alias("component"))
    smallest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(grouped.join(smallest, "component").select("simhash", "component_id"), "simhash")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    prints = cut(with_simhash(docs.select("doc_id", "text")).select("doc_id", "simhash"))
    return simhash_groups(prints).select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def sketches(data: np.ndarray, starts: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: a hash of its words, its fingerprint, and one key for each of BANDS bands of ROWS least shingle hashes (one row per text)."""
    joined, begin, end, first, at = shingles(data, starts, shingle)
    text = joined.tobytes()
    node = np.fromiter((_XXH(text[a:b], SEED) for a, b in zip(at[:-1].tolist(), at[1:].tolist())), np.uint64, len(starts) - 1)
    keys, prints = np.zeros((len(node), BANDS), np.uint64), np.zeros(len(node), np.uint64)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        hashes = slice_hash(prefix_sums(joined), begin, end)
        prints = _majority(hashes, first)
        for band in range(BANDS):
            key = np.full(len(full), band, np.uint64)
            for a in _FACTORS[band]:
                key = mixed(key ^ np.minimum.reduceat(hashes * a, first[full]))
            keys[full, band] = key
    return node, prints, keys


def similar_texts(docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """a, b of links that connect nodes whose sets of `shingle`-word runs have a Jaccard similarity of at least `similarity`.

    Candidates are all pairs whose fingerprints lie within the ring's radius (see fingerprint_links), then those that agree in a
    band of least hashes and that no link connects yet; none is left out, however large a band's group is:

    1. Each group compares its nodes with one of them, the one with the most neighbours in all bands (mostly the text that the
       others were made from). That makes most groups one component already.
    2. In groups of more than two nodes that still hold several components, all pairs of nodes of different components are compared,
       inside tasks, in tiles of two blocks. Pairs inside a component cannot change the groups and are passed over.

    Every link is checked exactly.
    """
    bands = nodes.select(F.col("__node").alias("x"), F.explode("__keys").alias("key"))
    shared = cut(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = cut(spread_join(bands, shared, "key", "n"))
    prints = nodes.select(F.col("__node").alias("x"), F.col("__simhash").alias("simhash"))
    close = cut(spread_join(prints, cut(least_partners(prints)), "simhash", "n"))
    items = cut(text_sets(docs, nodes.join(members.select("x").unionByName(close.select("x")).distinct(), F.col("__node") == F.col("x"), "left_semi"), shingle))

    linked, found = fingerprint_links(close, items, similarity)
    weights = members.groupBy("x").agg(F.sum("n").alias("weight"))
    heads = members.join(weights, "x").groupBy("key").agg(F.max(F.struct("weight", "x")).alias("top")).select("key", F.col("top.x").alias("head"))
    stars = members.join(heads, "key").where("x != head").select("head", "x").distinct()
    part = linked.select(F.col("node").alias("x"), F.col("component").alias("c"))
    stars = stars.join(part, "x", "left").join(part.toDF("head", "d"), "head", "left").where("coalesce(c, x) != coalesce(d, head)")
    first = star_links(cut(stars.select("head", "x")), items, similarity)

    ends = ["node as a", "component as b"]
    parts = cut(connected_components(linked.where("node != component").selectExpr(*ends).unionByName(found).unionByName(first)))
    placed = members.join(parts, F.col("x") == F.col("node"), "left").select("key", "x", "n", F.coalesce("component", "x").alias("c"))
    several = placed.where("n > 2").groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    rest = placed.join(several, "key").withColumn("blocks", F.ceil(F.col("n") / TILE).cast("int")).withColumn("mine", F.expr("cast(pmod(xxhash64(x), blocks) as int)"))
    tiles = F.expr("transform(sequence(0, blocks - 1), k -> struct(cast(least(mine, k) as long) * blocks + greatest(mine, k) as tile, if(mine <= k, 0, 1) as side, mine != k as cross))")
    spread = rest.select(F.col("key").alias("g"), "x", "c", F.explode(tiles).alias("t")).select("g", "t.tile", "x", "c", "t.side", F.col("t.cross").alias("cross"))
    second = near_links(spread, items, similarity)
    return parts.where("node != component").selectExpr(*ends).unionByName(second)


def least_partners(prints: DataFrame) -> DataFrame:
    """simhash, n, partner, head of the fingerprints that several nodes x share or that have others within the ring's radius.

    n: nodes; head: the least node; partner: the least other fingerprint within the radius, null for none.
    """
    same = cut(prints.groupBy("simhash").agg(F.min("x").alias("head"), F.count("*").alias("n")))
    pairs = linked_fingerprints(same.select("simhash"), WIDE)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("simhash"), F.col("b").alias("other")), F.struct(F.col("b").alias("simhash"), F.col("a").alias("other")))).alias("p")).select("p.*")
    found = both.groupBy("simhash").agg(F.min("other").alias("partner"))
    return same.join(found, "simhash", "left").where("n > 1 or partner is not null").select("simhash", "n", "partner", "head")


def fingerprint_links(close: DataFrame, items: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """What connects all similar nodes whose fingerprints lie within the ring's radius; close(x, simhash, partner, head): see least_partners.

    1. Nodes are compared with the head of their own fingerprint, heads with the head of their fingerprint's least partner: node, component.
    2. All other pairs within the radius are compared, but for those that the first links connect: a, b of further links.
    """
    own = close.where("x != head").select("head", "x")
    heads = close.where("x = head").select("simhash", "head", "partner")
    across = heads.where("partner is not null").select(F.col("partner").alias("simhash"), F.col("head").alias("x")).join(heads.select("simhash", "head"), "simhash")
    tried = cut(own.unionByName(across.select(F.least("head", "x").alias("head"), F.greatest("head", "x").alias("x"))).distinct())
    first = star_links(tried, items, similarity)
    parts = cut(connected_components(first))
    placed = cut(close.join(parts, F.col("x") == F.col("node"), "left").select("x", "simhash", F.coalesce("component", "x").alias("c")))
    several = placed.groupBy("simhash").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    pairs = linked_fingerprints(several.select("simhash"), WIDE).distinct().unionByName(several.where("low < high").select(F.col("simhash").alias("a"), F.col("simhash").alias("b")))
    span = lambda k: several.select(F.col("simhash").alias(k), F.col("low").alias(f"low_{k}"), F.col("high").alias(f"high_{k}"))
    pairs = pairs.join(span("a"), "a").join(span("b"), "b").where("least(low_a, low_b) < greatest(high_a, high_b)").select("a", "b")
    left, right = placed.select(F.col("simhash").alias("a"), F.col("x").alias("head"), F.col("c").alias("d")), placed.select(F.col("simhash").alias("b"), "x", "c")
    rest = pairs.join(left, "a").join(right, "b").where("c != d and (a < b or head < x)").select(F.least("head", "x").alias("head"), F.greatest("head", "x").alias("x"))
    return parts, star_links(cut(rest.distinct().join(tried, ["head", "x"], "left_anti")), items, similarity)


def star_links(stars: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """a, b of links between each head and the nodes x beside it in `stars` that are similar to it; STAR nodes a task, their sets met once each."""
    dealt = stars.groupBy("head").agg(F.ceil(F.count("*") / STAR).alias("parts"))
    asked = stars.join(dealt, "head").select("head", F.expr("pmod(xxhash64(x), parts)").alias("part"), "x", F.lit(0).alias("side"))
    own = dealt.select("head", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("head").alias("x"), F.lit(1).alias("side"))
    return cut(near_links(asked.unionByName(own).select(F.col("head").alias("g"), F.col("part").alias("tile"), "x", F.col("x").alias("c"), "side", F.lit(True).alias("cross")), items, similarity))


def text_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """x, items: the sorted different shingle hashes of each node's text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, starts in blocks(batches, "text"):
            joined, begin, end, first, _ = shingles(data, starts, shingle)
            hashes = slice_hash(prefix_sums(joined), begin, end).view(np.int64) if len(begin) else np.zeros(0, np.int64)
            own = [np.unique(hashes[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            at = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(own)))], names=["x", "items"])

    wanted = cut(nodes.select(F.col("__node").alias("x"), F.col("__row.doc_id").alias("doc_id"), F.col("__row.__tag").alias("__want")))
    row = F.xxhash64("doc_id", "__want")  # of copies only the node's own row is shuffled
    rows = possible(docs.select("doc_id", "text", F.xxhash64("text").alias("__want")), key_filter(wanted, row), row)
    texts = rows.where("__may").select("text", "__want").join(wanted.select("x", "__want"), "__want").dropDuplicates(["__want"]).select("x", "text")  # on the join's key: no shuffle of its own
    return texts.mapInArrow(sets, "x long, items array<long>")


def near_links(groups: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """a, b: links that span what the checked pairs of each group (g, tile) connect; groups(g, tile, x, c, side, cross).

    Compared are nodes of different c, only across sides where `cross` holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ("g", "tile")):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in linked_rows(rows, similarity)], names=["a", "b"])

    full = groups.join(items, "x").select("g", "tile", "x", "c", "side", "cross", "items")
    return full.repartition("g", "tile").sortWithinPartitions("g", "tile").mapInArrow(run, "a long, b long")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each group, which stand together, as one table."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys], axis=1)
        edges = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1).tolist(), len(values)]
        for a, b in zip(edges, edges[1:]):
            if held and tuple(values[a]) != now:
                yield pa.Table.from_batches(held)
                held = []
            now = tuple(values[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def linked_rows(rows: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """For each node of a group, the least node that similar pairs connect it with, where that is another."""
    rows = rows.combine_chunks()
    x, c, side = (rows.column(k).to_numpy() for k in ("x", "c", "side"))
    lists = rows.column("items").chunk(0)
    n = np.diff(np.asarray(lists.offsets)).astype(np.int64)
    tokens, owner = np.asarray(lists.flatten()), np.repeat(np.arange(len(x)), n)
    cross = bool(rows.column("cross")[0].as_py())
    if cross and (side == 1).sum() == 1:
        head = int(np.flatnonzero(side == 1)[0])
        both = np.bincount(owner[np.isin(tokens, tokens[owner == head])], minlength=len(x))
        i = np.flatnonzero((side == 0) & (both >= similarity * (n + n[head] - both)) & (c != c[head]))
        j = np.full(len(i), head)
    else:
        different, at, times = np.unique(tokens, return_inverse=True, return_counts=True)
        common = np.flatnonzero(times > 1)
        both = np.zeros((len(x), len(x)), np.float32)
        for k in range(0, len(common), 4096):  # bounded by the tile and this width, however long the texts are
            place = np.full(len(different), -1, np.int64)
            place[common[k : k + 4096]] = np.arange(len(common[k : k + 4096]))
            some = place[at] >= 0
            grid = np.zeros((len(x), len(common[k : k + 4096])), np.float32)
            grid[owner[some], place[at][some]] = 1
            both += grid @ grid.T
        total = n[:, None] + n[None, :] - both
        near = (both >= similarity * total) & (c[:, None] != c[None, :]) & (total > 0)
        i, j = np.nonzero(near & (side[:, None] != side[None, :]) if cross else np.triu(near, 1))
    hub = x.copy()
    while len(i):
        before = hub.copy()
        np.minimum.at(hub, i, hub[j])
        np.minimum.at(hub, j, hub[i])
        if (before == hub).all():
            break
    moved = hub != x
    return x[moved], hub[moved]


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """The documents without all but one row of each near-duplicate group: the smallest id, then the least text hash.

    Groups link fingerprints of at most RADIUS differing bits or, where `similarity` is given, texts whose sets of
    `shingle`-word runs have at least that Jaccard similarity (texts alike up to spaces and A-Z case always link), looked for
    by fingerprints first.
    The row is chosen per group and not per id, so groups without ids and different texts under one id keep a row each.
    """
    with scope() as keep:
        if similarity is None:
            prints = cut(with_simhash(docs.select("doc_id", "text"), shingle).select("doc_id", F.xxhash64("text").alias("__tag"), F.col("simhash").alias("__node")))
            nodes = cut(first_rows(prints, "__node"))
            return keep(one_of_each(docs, prints, nodes, connected_components(linked_fingerprints(nodes.select(F.col("__node").alias("simhash"))).distinct())))
        kind = docs.schema["doc_id"].dataType.simpleString()

        def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, data, starts in blocks(batches, "text"):
                node, simhashes, keys = sketches(data, starts, shingle)
                at = pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(node.view(np.int64)), pa.array(simhashes.view(np.int64)), pa.ListArray.from_arrays(at, pa.array(keys.view(np.int64).ravel()))], names=["doc_id", "__tag", "__node", "__simhash", "__keys"])

        prints = cut(docs.select("doc_id", "text", F.xxhash64("text").alias("__tag")).mapInArrow(sketch, f"doc_id {kind}, __tag long, __node long, __simhash long, __keys array<long>"))
        nodes = cut(first_rows(prints, "__node", "__simhash", "__keys"))
        return keep(one_of_each(docs, prints, nodes, connected_components(similar_texts(docs, nodes, shingle, similarity))))


def first_rows(prints: DataFrame, by: str, *more: str) -> DataFrame:
    """The least (id, text hash) of every `by`, ids before none, as the column __row; `more`: columns that `by` determines."""
    return prints.groupBy(by).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__tag")).alias("__row"), *(F.first(c).alias(c) for c in more))


def one_of_each(docs: DataFrame, prints: DataFrame, nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """One row of `docs` for each component: __node, __row -> the least __row; nodes that `parts` lacks are alone; prints: doc_id and __tag of each row.

    Rows to drop and repeated ones are known by id and text hash. Texts are shuffled only for these and for rows that their filter cannot tell from them.
    """
    grouped = nodes.join(parts, F.col("__node") == F.col("node"), "left").select("__row", F.coalesce("component", "__node").alias("component"))
    kept = cut(grouped.groupBy("component").agg(F.min("__row").alias("row")).select(F.col("row.doc_id").alias("__kept"), F.col("row.__tag").alias("__kept_tag")))
    same = F.col("doc_id").eqNullSafe(F.col("__kept")) & (F.col("__tag") == F.col("__kept_tag"))
    unsure = prints.groupBy("doc_id", "__tag").agg(F.count("*").alias("__n")).join(kept, same, "left").where("__n > 1 or __kept_tag is null")
    row = F.xxhash64("doc_id", "__tag")
    rows = possible(docs.withColumn("__tag", F.xxhash64("text")), key_filter(unsure, row), row)
    met = rows.where("__may").join(kept, same, "left_semi")
    # Rows alike in id and text are one group: all but one go before the shuffle already (WindowGroupLimit).
    once = Window.partitionBy("doc_id", "__tag").orderBy(F.xxhash64(*(f.name for f in docs.schema if isinstance(f.dataType, T.AtomicType))))
    first = met.withColumn("__nth", F.row_number().over(once)).where("__nth = 1")
    return rows.where("not __may").select(*docs.columns).unionByName(first.select(*docs.columns))
