"""WAND against scoring every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pyarrow as pa
from tests.llm.fixtures import documents, frame, prose

from quireflow.llm import ranking
from quireflow.llm.common import table
from quireflow.llm.queries import op11_wand


def terms(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows: list[tuple], items: list[tuple], k: int = 50) -> list[tuple]:
    docs = [(r[0], terms(r[1])) for r in rows]
    docs = [(i, Counter(w), len(w)) for i, w in docs if w]
    n, total = len(docs), sum(size for _, _, size in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, size in docs:
            m = 100 - 50 + (50 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) & set(c))
            if score:
                scored.append((-score, i is None, i or 0, i, score))
        out += [(item, place, i, score) for place, (*_, i, score) in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=str)


def got(df) -> list[tuple]:
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def case(n: int = 300) -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(8)
    rows = documents(21, n) + [(5000 + k, "same copy " * (1 + k % 3), "en", "s", 1) for k in range(150)] + [(None, prose(rng, 30), "en", "s", 1)] * 3
    rows += [(6000, "x" * 70_000 + " alder1 alder1", "en", "s", 1), (6001, "日本語 ÄÖ é alder1-birch2_Cedar3", "en", "s", 1), (4, "repeated id alder1", None, None, None)]
    items = [(k, prose(rng, rng.choice([1, 3, 20, 60]))) for k in range(20)]
    items += [(20, "same"), (20, "same"), (21, "copy SAME, same!"), (22, None), (23, " .,;"), (24, "unheardof"), (None, "alder1 birch2"), (25, "日本語 ÄÖ"), (26, rows[3][1])] + [(27, "oak1 elm2")] * 30
    return rows, items


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as rank", "'y' as score", "'z' as query", "1 as n")


def test_brute_force(spark):
    rows, items = case()
    for k in (1, 7, 50):
        assert got(ranking.rank(frame(spark, rows), bench(spark, items), k)) == brute(rows, items, k)


def test_blocks_of_queries_and_small_shards(spark, monkeypatch):
    """Several passes over the documents, several shards a task: the same rows."""
    rows, items = case()
    assert got(ranking.rank(frame(spark, rows), bench(spark, items), 50, block_bytes=600)) == brute(rows, items)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([5, None, 3, 3, 9]), "n": pa.array([2, 1, 4, 4, 1]), "terms": pa.array([[0, 1], [], [0, 2], [0, 2], [1]], pa.list_(pa.int32())), "counts": pa.array([[1, 1], [], [3, 1], [3, 1], [1]], pa.list_(pa.int64()))})
    import numpy as np

    for name, limit in (("SHARD_TEXTS", 2), ("SHARD_POSTINGS", 2)):
        monkeypatch.setattr(ranking, name, limit)
        made = list(ranking.shards(iter([batch, batch]), 5, 12, np.array([10, 20, 30])))
        assert len(made) > 3 and sorted(i for s in made for i in s.ids.to_pylist() if i is not None) == sorted([5, 3, 3, 9] * 2) and max(len(s.ids) for s in made) <= 3


def test_skips_and_keeps_ties(spark):
    """Over 50 documents at the same score: the smallest ids win, in any order of shards."""
    rows = [(k, "tie tie word", "en", "s", 1) for k in range(400)] + [(1000 + k, "filler text", "en", "s", 1) for k in range(600)]
    random.Random(1).shuffle(rows)
    assert got(ranking.rank(frame(spark, rows), bench(spark, [(1, "tie"), (2, "word filler")]))) == brute(rows, [(1, "tie"), (2, "word filler")])


def test_thresholds_of_other_shards():
    """A shard whose bounds cannot reach the heaps so far gives nothing; equal scores are left to the merge."""
    import numpy as np

    n = 20_000
    rare = [[1, 0] if k < 60 else [0] for k in range(n)]
    rows = pa.table({"doc_id": range(n), "n": [2] * n, "terms": pa.array([sorted(r) for r in rare], pa.list_(pa.int32())), "counts": pa.array([[1] * len(r) for r in rare], pa.list_(pa.int64()))})
    shard = ranking.Shard(rows, n, 2 * n, np.array([3, 9000]))
    at, best = shard.search([0, 1], 50, np.zeros(0, np.int64))
    assert at.tolist() == list(range(50)) and len(set(best.tolist())) == 1
    at, best = shard.search([0, 1], 50, np.full(50, int(best[0]) + 1))
    assert not len(at)  # nothing can beat the heaps of other shards


def test_empty_tables(spark):
    rows, items = case(5)
    assert got(ranking.rank(frame(spark, []), bench(spark, items))) == []
    assert got(ranking.rank(frame(spark, rows), bench(spark, []))) == []
    assert got(ranking.rank(frame(spark, [(1, None, None, None, None), (2, " ", "en", "s", 1)]), bench(spark, items))) == []


def test_whole_tables(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    assert got(op11_wand(spark, sf_dir)) == brute(rows, items)
