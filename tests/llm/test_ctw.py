"""Context-tree weighting against its definition; the base model against plain counting."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from tests.llm.fixtures import documents, frame

from quireflow.llm import ctw

HELD = "crc32(encode(cast(doc_id as string), 'UTF-8')) % 7 = 2"


def held(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def lowered(text: str | None) -> bytes:
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


def events(text: bytes) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """(context, nearest byte first; (prefix, bit) of the eight decisions) of each byte and of the end."""
    out = []
    for k, byte in enumerate([*text, 0]):
        context = bytes(text[k - j] if k - j >= 0 else 0 for j in range(1, ctw.DEPTH + 1))
        bits = [(1 << j | byte >> (8 - j), byte >> (7 - j) & 1) for j in range(8)]
        out.append((context, bits))
    return out


class Tree:
    def __init__(self):
        self.counts: dict = defaultdict(lambda: [0, 0])
        self.children: dict = defaultdict(set)

    def add(self, node, bit):
        for depth in range(ctw.DEPTH + 1):
            self.counts[node[0], node[1][:depth]][bit] += 1
            if depth:
                self.children[node[0], node[1][: depth - 1]].add(node[1][:depth])

    def log_w(self, prefix, context, extra=None, cache=None):
        """log P_w of a node, with one more decision (context, bit) if it lies below."""
        a, b = self.counts.get((prefix, context), (0, 0))
        if extra and extra[0][: len(context)] == context:
            a, b = a + (extra[1] == 0), b + (extra[1] == 1)
        elif cache is not None and (prefix, context) in cache:
            return cache[prefix, context]
        kt = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        if len(context) == ctw.DEPTH:
            return kt
        below = set(self.children.get((prefix, context), ()))
        if extra and extra[0][: len(context)] == context:
            below.add(extra[0][: len(context) + 1])
        deeper = sum(self.log_w(prefix, c, extra, cache) for c in below)
        out = np.logaddexp(kt, deeper) - math.log(2)
        if cache is not None and not (extra and extra[0][: len(context)] == context):
            cache[prefix, context] = out
        return out


def test_definition(spark):
    rows = [(k, t, None, None, None) for k, t in enumerate(["abab abc", "Abba cab", "", None, "abc abd", "b a b a", "ÄÖ ab", "abab", "cab cab", "zz"])]
    tree = Tree()
    for r in rows:
        if not held(r[0]):
            for context, bits in events(lowered(r[1])):
                for prefix, bit in bits:
                    tree.add((prefix, context), bit)
    cache: dict = {}
    got = {r.doc_id: r for r in ctw.score_texts(frame(spark, rows), HELD).collect()}
    assert {k for k in got if got[k].held_out} == {r[0] for r in rows if held(r[0])}
    for r in rows:
        total = sum(tree.log_w(prefix, b"", (context, bit), cache) - tree.log_w(prefix, b"", None, cache) for context, bits in events(lowered(r[1])) for prefix, bit in bits)
        assert got[r[0]].score == np.float64(got[r[0]].score) and abs(got[r[0]].score - total / math.log(10)) < 1e-4


def test_base_model(spark):
    rows = documents(3, 30)
    split = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", lowered(t)), None]
    counts = Counter(w for r in rows if not held(r[0]) for w in split(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(r[0]), held(r[0]), len(split(r[1])), sum(counts[w] > 0 for w in split(r[1])), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in split(r[1])), 6)) for r in rows)
    for size in (16 << 20, 4096):  # one batch and many
        got = ctw.score_texts(frame(spark, rows), HELD, size).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def test_batches_do_not_change_scores(spark):
    rows = documents(4, 20)
    one, many = (sorted((str(r.doc_id), round(r.score, 2)) for r in ctw.score_texts(frame(spark, rows), HELD, size).collect()) for size in (16 << 20, 2048))
    assert one == many


def test_empty(spark):
    assert ctw.score_texts(frame(spark, []), HELD).collect() == []
    only = [(k, "held out", None, None, None) for k in range(60) if held(k)]
    assert all(r.train_tokens == 0 and abs(r.base_score) < 1e-12 for r in ctw.score_texts(frame(spark, only), HELD).collect())
