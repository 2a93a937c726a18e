"""Karmarkar-Karp sharding: differencing against the plain algorithm; the plan's promises."""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tests.llm.fixtures import documents, frame

from quireflow.llm import sharding
from quireflow.llm.common import table


def plain_differencing(values: list[int], k: int) -> list[int]:
    """Part sums of textbook multi-way differencing, with sets carried along."""
    heap = []
    for i, v in enumerate(values):
        parts = [0] * (k - 1) + [v]
        heap.append((-(parts[-1] - parts[0]), i, parts))
    heapq.heapify(heap)
    n = len(values)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        c = sorted(x + y for x, y in zip(a, b[::-1]))
        heapq.heappush(heap, (-(c[-1] - c[0]), n, c))
        n += 1
    return heap[0][2]


@pytest.mark.parametrize("k", [2, 5, 40])
def test_differencing(k):
    rng = np.random.default_rng(k)
    for n in (1, 2, 17, 300):
        values = rng.integers(1, 10_000, n)
        tuples = np.zeros((n, k), np.int64)
        tuples[:, 0] = values
        part = sharding.difference(tuples)
        assert (np.sort(part, axis=1) == np.arange(k)).all()
        assert sorted(np.bincount(part[:, 0], values, k).astype(int)) == plain_differencing(values.tolist(), k)


def check_plan(rows: list[tuple], got: list, shards: int) -> np.ndarray:
    assert len(got) == len(rows)
    raw = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len(raw(r[1])) + 16, zlib.crc32(raw(r[1]))) for r in rows)
    slots, where = defaultdict(list), defaultdict(set)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        where[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values()), "equal texts stay together"
    return np.bincount([r.shard for r in got], [r.size for r in got], shards)


def test_plan(spark):
    rows = documents(3, 200)
    loads = check_plan(rows, sharding.shard_plan(frame(spark, rows), 5).collect(), 5)
    largest = 2 * (len(rows[-6][1]) + 16)
    assert loads.max() - loads.min() <= largest


def test_many_buckets_and_lanes(spark, monkeypatch):
    """Several levels of merging and several lanes of slots."""
    for name, value in (("BUCKET_GROUPS", 8), ("FAN_IN", 3), ("SLOT_ROWS", 5)):
        monkeypatch.setattr(sharding, name, value)
    rng = np.random.default_rng(1)
    rows = [(k, "x" * int(rng.integers(0, 400)) + str(k // 2), None, None, None) for k in range(400)]
    loads = check_plan(rows, sharding.shard_plan(frame(spark, rows), 4).collect(), 4)
    assert loads.max() - loads.min() < 0.02 * loads.mean()


def test_hot_rows_and_texts(spark, monkeypatch):
    """A third of the rows are one row without id, another third one text under many ids; the plan is the same each time."""
    for name, value in (("BUCKET_GROUPS", 16), ("SLOT_ROWS", 5), ("COPY_BLOCK", 7)):
        monkeypatch.setattr(sharding, name, value)
    rows = [(None, "same", None, None, None)] * 100 + [(k, "", None, None, None) for k in range(100)] + [(k, f"text {k}" * (k % 9), None, None, None) for k in range(100, 200)]
    got = sharding.shard_plan(frame(spark, rows), 4).collect()
    check_plan(rows, got, 4)
    again = sharding.shard_plan(frame(spark, rows).repartition(7), 4).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_table_and_empty(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check_plan(rows, sharding.shard_plan(docs).collect(), 40)
    assert sharding.shard_plan(frame(spark, [])).collect() == []


def test_written_shards(spark, tmp_path):
    docs = frame(spark, documents(3, 30)).drop("shard")
    sharding.write_shards(docs, f"file://{tmp_path}/out", 4)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == docs.count() and {r[0] for r in back.select("shard").distinct().collect()} <= set(range(4))
