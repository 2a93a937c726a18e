"""Repeated strings against a dictionary of all strings; the external sorter against plain sorting."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tests.llm.fixtures import documents, frame, prose

from quireflow.llm import induced, suffix_dedup
from quireflow.llm.common import table


def brute(rows: list[tuple], length: int) -> list[tuple]:
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for doc, t in texts:
        gone = np.zeros(len(t) + 1, int)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0 if len(t) else np.zeros(0, bool)
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(t) else 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((doc, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df) -> list[tuple]:
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize(("length", "gram"), [(200, 32), (24, 6)])
def test_brute_force(spark, length, gram):
    rows = documents(5)
    assert got(suffix_dedup.remove_repeats(frame(spark, rows), length, gram)) == brute(rows, length)


def test_runs_of_one_letter_and_periods(spark):
    rows = [(1, "a" * 700, None, None, None), (2, "ab" * 300, None, None, None), (3, "a" * 199, None, None, None), (4, "x" + "a" * 250 + "y", None, None, None), (5, "ü" * 120, None, None, None), (6, "abc" * 100, None, None, None)]
    assert got(suffix_dedup.remove_repeats(frame(spark, rows), 200, 32)) == brute(rows, 200)


def test_hot_anchor_is_dealt_by_string(spark, monkeypatch):
    """A passage inside many different surroundings: one anchor with very many different snippets."""
    monkeypatch.setattr(suffix_dedup, "HOT_SNIPPETS", 8)
    rng = random.Random(2)
    passage = prose(rng, 30)
    rows = [(k, prose(rng, 20) + chr(65 + k % 26) + passage[k % 3 :] + chr(70 + k % 20) + prose(rng, 20), None, None, None) for k in range(60)]
    assert got(suffix_dedup.remove_repeats(frame(spark, rows), 60, 12)) == brute(rows, 60)


def test_text_that_is_left(spark):
    rows = documents(6, 20)
    out = suffix_dedup.remove_repeats(frame(spark, rows), keep_text=True).collect()
    for r in out:
        assert hashlib.sha256(bytes(r.kept_bytes)).hexdigest() == r.kept_sha256 and len(r.kept_bytes) == r.n_bytes - r.n_removed


def test_empty(spark):
    assert suffix_dedup.remove_repeats(frame(spark, [])).collect() == []


def test_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(suffix_dedup.remove_repeats(docs)) == brute(rows, 200)


@pytest.mark.parametrize("memory", [1 << 26, 1 << 10])
def test_induced_sorting(memory):
    """With little memory the queues and arrays go to disk; the marks stay the same."""
    rng = np.random.default_rng(1)
    for size, letters, cap in ((0, 2, 5), (1, 2, 5), (300, 2, 8), (3000, 3, 12), (3000, 60, 3), (2000, 1, 40)):
        text = rng.integers(97, 97 + letters, size).astype(np.uint8)
        raw = text.tobytes()
        seen = Counter(raw[k : k + cap] for k in range(len(raw) - cap + 1))
        want = [len(raw) - k >= cap and seen[raw[k : k + cap]] > 1 for k in range(len(raw))]
        have = induced.repeated_positions(text, cap, memory)
        assert [bool(x) for x in have[: max(0, size - cap + 1)]] == want[: max(0, size - cap + 1)]
