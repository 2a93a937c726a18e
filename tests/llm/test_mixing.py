"""Capped water-filling against its rounds; the sampler's promises."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from tests.llm.fixtures import documents, frame

from quireflow.llm import mixing


def size(text: str | None) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def water(sizes: dict, epochs: int = 3) -> dict:
    """Targets by rounds: share by weight, clamp what is above, share the excess again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, clamped = sum(sizes.values()), {}
    while True:
        rest = total - sum(clamped.values())
        free = [s for s in order if s not in clamped]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: float(epochs * sizes[s]) for s in free if share[s] > epochs * sizes[s]}
        if not over:
            return clamped | share
        clamped |= over


def tables() -> list[list[tuple]]:
    skewed = [(k, "w " * (k % 9), None, f"s{min(k % 40, 7)}" if k % 40 else None, 0) for k in range(600)]
    tiny = [(1, "a b c", None, "a", 0), (2, "a", None, "b", 0), (3, "", None, "c", 0)]
    alike = [(None, "w w w w", None, "a", 0)] * 500 + [(k, "w " * 5, None, "b", 0) for k in range(80)] + [(7, "x " * 9, None, "b", 0)] * 30
    return [documents(1), documents(2), skewed, tiny, alike, [(1, None, None, None, None)], []]


@pytest.mark.parametrize("k", range(7))
def test_targets_and_sampling(spark, k):
    rows = tables()[k]
    got = mixing.mix_plan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    want, source = water(dict(sizes)) if rows else {}, defaultdict(list)
    for r in rows:
        source[r[0], size(r[1]), sizes[r[3]]].append(r[3])
    taken, most = Counter(), Counter()
    for r in got:
        s = source[r.doc_id, r.size, r.source_size].pop()
        assert r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
        most[s] = max(most[s], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_plan(frame(spark, rows[::-1])).collect()))


@pytest.mark.parametrize("k", [0, 2, 4])
def test_stage_repeats_whole_documents(spark, k):
    docs = frame(spark, tables()[k])
    plan = Counter()
    for r in mixing.mix_plan(docs).collect():
        plan[r.doc_id, r.size] += (r.taken // r.size) if r.size else 1
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = mixed.select("doc_id", "text").collect()
    assert Counter((r.doc_id, size(r.text)) for r in got) == +plan
    again = mixing.mix(frame(spark, tables()[k][::-1])).select("doc_id", "text").collect()
    assert Counter(map(str, got)) == Counter(map(str, again)), "part of rows alike in id, source and size, but not in text, is the same part"


def test_part_of_equal_rows_is_taken(spark):
    """500 rows alike: as many as the target has room for, in blocks."""
    rows = [(None, "w w w w", None, "a", 0)] * 9000 + [(1, "w " * 12_000, None, "b", 0)]
    taken = Counter((r.size, r.taken) for r in mixing.mix_plan(frame(spark, rows)).collect())
    assert taken[4, 0] + taken[4, 4] == 9000 and abs(taken[4, 4] * 4 - 48_000 / 3) <= 2 and taken[12_000, 24_000] + taken[12_000, 36_000] == 1
    assert mixing.mix(frame(spark, rows)).where("source = 'a'").count() == taken[4, 4]


def test_no_python_in_the_plan(spark):
    plan = mixing.mix_plan(frame(spark, documents(1)))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
