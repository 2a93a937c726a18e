"""SimHash groups against all pairs, and the stage that keeps one of each group."""

from __future__ import annotations

import random
import re

import corpus_pipeline
import numpy as np
import xxhash
from pyspark.sql import functions as F
from tests.llm.fixtures import documents, frame, smallest_reachable

from quireflow import scratch
from quireflow.llm import common, simhash
from quireflow.llm.common import prefix_sums, slice_hash, table


def fingerprint(text: str | None) -> int:
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", low)
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows: list[tuple]) -> list[tuple]:
    prints = [fingerprint(r[1]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    part = smallest_reachable(len(rows), links)
    least: dict = {}
    for r, p in zip(rows, part):
        if r[0] is not None:
            least[p] = min(least.get(p, r[0]), r[0])
    return sorted(((r[0], f"{x:016x}", least.get(p)) for r, x, p in zip(rows, prints, part)), key=str)


def got(df) -> list[tuple]:
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_brute_force(spark):
    rows = documents(7, 80)
    assert got(simhash.near_duplicates(frame(spark, rows))) == brute(rows)


def test_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert got(simhash.near_duplicates(docs)) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_every_pair_within_two_bits_is_found(spark):
    """Flips of every kind, the sign bit and segment borders among them; and none beyond two bits."""
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = set(base)
    for x in base:
        values |= {x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(120)} | {x ^ (1 << b) for b in (0, 20, 21, 41, 42, 63)} | {x ^ (1 << 63) ^ (1 << b) for b in (0, 21, 42)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.linked_fingerprints(spark.createDataFrame([(v,) for v in signed], "simhash long")).distinct().collect()
    bits = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    assert {(r.a, r.b) for r in links} == {(a, b) for a in signed for b in signed if a < b and bits(a, b) <= 2}


def test_one_of_each_group_stays(spark):
    rows = documents(8, 60)
    docs = frame(spark, rows)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    want = {r[2] for r in brute(rows)}
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and set(ids) == want


def test_stage_on_repeats_and_empty(spark):
    twice = frame(spark, documents(9, 10)).unionAll(frame(spark, documents(9, 10)))
    assert simhash.deduplicate(twice).groupBy("doc_id").count().where(F.col("count") > 1).count() == 0
    assert simhash.near_duplicates(frame(spark, [])).collect() == [] and simhash.deduplicate(frame(spark, [])).collect() == []


def test_majority_of_many_shingles():
    hashes = np.random.default_rng(1).integers(0, 1 << 64, 40_000, dtype=np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))
    assert int(simhash._majority(hashes, np.array([0, len(hashes)]))[0]) == want


def test_every_group_keeps_one_row_whatever_its_ids(spark):
    """Groups without ids, different texts under one id, and a copy without id of a text that has one."""
    texts = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (None, texts[2]), (8, texts[4]), (None, texts[4]), (9, texts[5]), (9, texts[5])]
    kept = simhash.deduplicate(frame(spark, [(i, t, "en", "s", 1) for i, t in rows])).collect()
    assert sorted(((r.doc_id, texts.index(r.text)) for r in kept), key=str) == sorted([(None, 0), (None, 1), (7, 2), (7, 3), (8, 4), (9, 5)], key=str)


def runs_of_five(text: str) -> set[tuple]:
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def jaccard(a: str, b: str) -> float:
    x, y = runs_of_five(a), runs_of_five(b)
    return len(x & y) / len(x | y)


def test_the_stage_links_texts_by_jaccard_similarity(spark, sf_dir):
    """Pairs on both sides of 0.8, one large group made from one text, and copies; against all pairs."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for n, changes in [(100, 2), (300, 3), (300, 8), (1000, 17), (1000, 24), (1000, 30)] * 8:
        base = [word() for _ in range(n)]
        near = list(base)
        for k in rng.sample(range(n), changes):
            near[k] = word()
        texts += [" ".join(base), " ".join(near)]
    base = [word() for _ in range(200)]
    for _ in range(60):
        near = list(base)
        near[rng.randrange(10, 190)] = word()
        texts += [" ".join(near), " ".join(near).upper()]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    part = smallest_reachable(len(texts), links)
    assert 60 < len(set(part)) < len(texts) - 60
    kept = {r.doc_id for r in corpus_pipeline.without_copies(spark, frame(spark, rows), sf_dir).collect()}
    assert kept == set(part)


def test_a_group_without_a_centre_is_linked_whole(spark, sf_dir):
    """Texts that share most words, in several clusters far from each other's centre: no cap, head or tile may lose a link."""
    rng = random.Random(6)
    base = [f"b{rng.randrange(10**6)}" for _ in range(400)]
    texts = []
    for cluster in range(5):
        own = list(base)
        for k in rng.sample(range(400), 26):
            own[k] = f"c{cluster}x{k}"
        for _ in range(70):
            near = list(own)
            for k in rng.sample(range(400), rng.randrange(1, 4)):
                near[k] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(near))
    rng.shuffle(texts)
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)]
    sets = [runs_of_five(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = smallest_reachable(len(texts), links)
    kept = {r.doc_id for r in corpus_pipeline.without_copies(spark, frame(spark, rows), sf_dir).collect()}
    assert kept == set(want)


def test_tiles_find_every_link(spark):
    """near_links on one large group, dealt in tiles, against all pairs."""
    rng = random.Random(8)
    sets = [sorted({rng.randrange(40) for _ in range(9)}) for _ in range(300)]
    items = spark.createDataFrame(list(enumerate(sets)), "x long, items array<long>")
    blocks = 3
    rows = [(1, min(k % blocks, b) * blocks + max(k % blocks, b), k, k, 0 if k % blocks <= b else 1, k % blocks != b) for k in range(300) for b in range(blocks)]
    got = simhash.near_links(spark.createDataFrame(rows, "g long, tile long, x long, c long, side int, cross boolean"), items, 0.4).collect()
    links = [(i, j) for i in range(300) for j in range(i) if len(set(sets[i]) & set(sets[j])) >= 0.4 * len(set(sets[i]) | set(sets[j]))]
    want = smallest_reachable(300, links)
    assert smallest_reachable(300, [(r.a, r.b) for r in got]) == want and 1 < len(set(want)) < 300


def test_the_wide_ring_finds_every_pair_within_five_bits(spark):
    """Flips of one to seven bits, in neighbouring segments and over the ring's end too."""
    rng = random.Random(12)
    base = [rng.getrandbits(64) for _ in range(4)]
    values = set(base)
    for x in base:
        for k in range(240):
            y = x
            for b in rng.sample(range(64), 1 + k % 7) if k % 2 else rng.sample([*range(52, 64), *range(12)], 1 + k % 7):
                y ^= 1 << b
            values.add(y)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.linked_fingerprints(spark.createDataFrame([(v,) for v in signed], "simhash long"), simhash.WIDE).distinct().collect()
    bits = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    want = {(a, b) for a in signed for b in signed if a < b and bits(a, b) <= 5}
    assert {(r.a, r.b) for r in links} == want and any(bits(a, b) == 5 for a, b in want)


def test_the_stage_links_by_fingerprints(spark):
    """Fingerprints alone, without bands, connect exactly the pairs that lie within five bits and are similar; fingerprints alone prove nothing."""
    rng = random.Random(14)
    sets, prints = [], []
    for k in range(60):
        own, p = [rng.getrandbits(62) for _ in range(40)], rng.getrandbits(64)
        for n in range(6):
            swap = rng.randrange(0, 9)  # Jaccard similarity on both sides of 0.8
            sets.append(sorted([*own[swap:], *(rng.getrandbits(62) for _ in range(swap))]))
            q = p
            for b in rng.sample(range(64), rng.randrange(0, 7) if n % 3 else 0):
                q ^= 1 << b
            prints.append(q)
    signed = [v - (1 << 64) if v >> 63 else v for v in prints]
    frame_ = spark.createDataFrame(list(enumerate(signed)), "x long, simhash long")
    items = spark.createDataFrame(list(enumerate(sets)), "x long, items array<long>")
    close = frame_.join(simhash.least_partners(frame_), "simhash")
    parts, more = simhash.fingerprint_links(close, items, 0.8)
    got = [*parts.toDF("a", "b").collect(), *more.collect()]
    assert len(more.collect()) > 0
    alike = lambda i, j: len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 5 and alike(i, j)]
    want = smallest_reachable(len(sets), links)
    assert smallest_reachable(len(sets), [(r.a, r.b) for r in got]) == want and 60 < len(set(want)) < len(sets) - 60


def test_sketches_hold_the_fingerprint_of_word_runs():
    """Majority bits of the runs' hashes, copies up to case and spaces alike, few words in few bits."""
    words = [f"w{k}" for k in range(1000)]
    near = [*words[:500], "other", *words[501:]]
    texts = [" ".join(words), "  ".join(words).upper(), " ".join(near), "one two", ""]
    data, starts = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    node, prints, keys = simhash.sketches(data, starts, 5)
    joined, begin, end, first, _ = simhash.shingles(data, starts, 5)
    hashes = slice_hash(prefix_sums(joined), begin, end)
    for k in range(len(texts)):
        own = hashes[first[k] : first[k + 1]].tolist()
        assert int(prints[k]) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))
    assert node[0] == node[1] and prints[0] == prints[1] and int(prints[0] ^ prints[2]).bit_count() <= 5 and prints[4] == 0 and keys.shape == (5, simhash.BANDS)


def test_the_stage_shuffles_few_texts(spark):
    """Texts without near copies are not shuffled, and only what the result reads stays in the shared folder."""
    rng = random.Random(15)
    rows = [(k, " ".join(f"{rng.getrandbits(40):x}" for _ in range(400)), None, "s", 0) for k in range(1000)]
    rows += [(k + 1000, *rows[k][1:]) for k in range(20)] + [(k + 2000, rows[k][1] + " end", *rows[k][2:]) for k in range(20, 40)] + [rows[50], rows[50]]
    docs = common.cut(frame(spark, rows))
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before, folders = written(), sum(map(len, scratch._scopes))
    out = simhash.deduplicate(docs, shingle=5, similarity=0.8)
    assert sorted(r.doc_id for r in out.collect()) == list(range(1000))
    assert written() - before < 0.7 * sum(len(r[1]) for r in rows)
    assert sum(map(len, scratch._scopes)) - folders <= 3


def test_filter_loses_no_key(spark):
    keys, rows = spark.range(0, 3000).select(F.xxhash64("id").alias("h")), spark.range(0, 100_000).withColumn("h", F.xxhash64("id"))
    got = common.possible(rows, common.key_filter(keys, F.col("h")), F.col("h")).where("__may").select("id").collect()
    assert {r.id for r in got} >= set(range(3000)) and len(got) < 3200
    none = common.possible(rows, common.key_filter(keys.where("false"), F.col("h")), F.col("h"))
    assert none.columns == ["id", "h", "__may"] and none.where("__may").count() == 0


def test_components_of_stars_take_no_round(spark, monkeypatch):
    """Edges that are stars are not stepped over again; chains, cycles and nodes of two hubs are."""
    cuts, plain = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df: cuts.append(1) or plain(df))
    got = common.connected_components(spark.createDataFrame([(1, 5), (7, 1), (2, 9), (9, 2), (3, 3)], "a long, b long"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 2), (5, 1), (7, 1), (9, 2)] and len(cuts) == 1
    rng = random.Random(16)
    edges = [(k, k + 1) for k in range(40)] + [(60, 50), (60, 51), (61, 51), (61, 52)] + [(70 + k, 70 + (k + 1) % 9) for k in range(9)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)]
    want = smallest_reachable(200, edges)
    least = {p: min(k for k in range(200) if want[k] == p) for p in set(want)}
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert sorted(map(tuple, got)) == sorted((k, least[want[k]]) for k in nodes)
