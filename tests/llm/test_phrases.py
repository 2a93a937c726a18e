"""Repeated passages against comparing every window of every document."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from tests.llm.fixtures import documents, frame, prose

from quireflow.llm import phrases
from quireflow.llm.common import table
from quireflow.llm.queries import op12_phrase_automata


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows: list[tuple], window: int = 50) -> list[tuple]:
    first: dict = {}
    for r in rows:
        w = words(r[1])
        for k in range(len(w) - window + 1 if r[0] is not None else 0):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, r[0]), r[0])
    out = []
    for r in rows:
        w = words(r[1])
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - window + 1 if r[0] is not None else 0):
            if first[tuple(w[k : k + window])] < r[0]:
                gone[k : k + window] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((r[0], len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df) -> list[tuple]:
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def case() -> list[tuple]:
    """Passages that overlap in every way: whole, cut at either end, inside each other, next to each other, repeated in one text."""
    rng = random.Random(5)
    rows = documents(31, 60)
    passages = [prose(rng, n).split() for n in (49, 50, 51, 60, 120, 400)]
    for k in range(80):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            p = passages[rng.randrange(6)]
            a = rng.randrange(len(p) // 2) if rng.random() < 0.5 else 0
            parts += prose(rng, rng.randrange(20)).split() + p[a : a + rng.randrange(30, 200)]
        rows.append((1000 + rng.randrange(60), rng.choice([" ", "\n", "\t "]).join(parts), "en", "s", 1))
    rows += [(900, "same " * 120, None, None, None), (901, "same " * 70, None, None, None), (None, " ".join(passages[4]), None, None, None), (-5, " ".join(passages[5][100:200]), None, None, None)]
    rows += [(2000 + k, " ".join(passages[3]), "en", "s", 1) for k in range(60)] + [(2000, " ".join(passages[3]), "en", "s", 1)] * 40
    rows += [(3000, "Word " + " ".join(passages[2]).upper(), None, None, None), (3001, " ".join(passages[4]), None, None, None), (3002, "\x00 " * 60, None, None, None), (3003, "\x00 " * 60 + "\x01", None, None, None)]
    return rows


@pytest.mark.parametrize("hot", [phrases.HOT_PIECES, 1, 0])
def test_brute_force(spark, hot):
    """All ways of an anchor: in shards, some of the anchors hot, all of them hot."""
    rows = case()
    assert got(phrases.remove_passages(frame(spark, rows), hot_pieces=hot)) == brute(rows)


def test_small_windows_and_kept_text(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(60))), "en", "s", 1) for k in range(60)]
    out = phrases.remove_passages(frame(spark, rows), window=6, gram=3, keep_text=True)
    assert got(out) == brute(rows, 6)
    for r in out.collect():
        w = words(dict((a, b) for a, b, *_ in rows)[r.doc_id])
        gone = {p for s in r.spans for p in range(s.begin, s.stop)}
        assert r.kept == " ".join(x for p, x in enumerate(w) if p not in gone) and len(gone) == r.n_removed


def test_a_common_passage_with_different_neighbours(spark):
    """A third of all documents share a line; every one of them has a copy, so the line's anchors are in very many different pieces."""
    rng = random.Random(9)
    line = prose(rng, 20)
    texts = [f"{prose(rng, 40)} {line} {prose(rng, 40)}" for _ in range(60)]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts + texts)] + [(500 + k, prose(rng, 80), "en", "s", 1) for k in range(120)]
    expected = brute(rows)
    assert sum(r[2] for r in expected) == 60 * 100
    assert got(phrases.remove_passages(frame(spark, rows), hot_pieces=20)) == expected


def test_phrases_are_maximal_and_few():
    """A passage that two pieces share whole is one phrase; where a third shares a part, the passage falls into three."""
    a = np.arange(100, dtype=np.int32)
    alone = np.concatenate([a[20:80], [500]]).astype(np.int32)
    assert sorted(n for n, _, _ in phrases.confirmed([a, np.append(a, 7).astype(np.int32)], [1, 2], [1, 2], 50).values()) == [51]
    assert sorted(n for n, _, _ in phrases.confirmed([a, np.append(a, 7).astype(np.int32), alone], [1, 2, 3], [1, 2, 3], 50).values()) == [11, 20, 20]
    assert phrases.confirmed([a], [1], [1], 50) == {} and len(phrases.confirmed([a], [1], [2], 50)) == 1


def test_empty_tables(spark):
    assert got(phrases.remove_passages(frame(spark, []))) == []
    rows = [(1, None, None, None, None), (None, "a b", None, None, None), (None, None, None, None, None)]
    assert got(phrases.remove_passages(frame(spark, rows))) == brute(rows)


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    assert got(op12_phrase_automata(spark, sf_dir)) == brute(rows)
