"""Winnowed decontamination against sliding every window over every document."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from tests.llm.fixtures import documents, frame, prose

from quireflow.llm import decontaminate
from quireflow.llm.common import table


def words(text: str | None) -> list[str]:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    wanted: dict = {}
    for n, (_, text) in enumerate(items):
        w = words(text)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            wanted.setdefault(tuple(w[k : k + size]), set()).add(n)
    sizes = sorted({len(k) for k in wanted})
    out = []
    for r in rows:
        w = words(r[1])
        hit, found = np.zeros(len(w), bool), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in wanted:
                    hit[k : k + size] = True
                    found |= wanted[tuple(w[k : k + size])]
        ids = {items[n][0] for n in found}
        out.append((r[0], len(w), int(hit.sum()), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit.any())))
    return sorted(out, key=str)


def got(df) -> list[tuple]:
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=str)


def case() -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(4)
    items = [(k, prose(rng, rng.choice([1, 4, 9, 10, 11, 30, 60]))) for k in range(30)]
    items += [(30, items[3][1]), (31, None), (32, ""), (33, " .,;"), (34, "Same same SAME same same same same same same same same same"), (35, "日本語 の テスト ÄÖ é " * 4), (2, items[2][1].upper())]
    rows = documents(11, 60)
    for k in range(40):
        item = words(items[rng.randrange(36)][1])
        at = rng.randrange(max(1, len(item)))
        piece = item[at : at + rng.randrange(1, 25)]
        text = prose(rng, rng.randrange(30)) + "\n" + rng.choice([" ", ", ", "--"]).join(piece) + rng.choice(["", "! "]) + prose(rng, rng.randrange(30))
        rows.append((200 + k, text if k % 3 else text.upper(), "en", "s", 1))
    rows += [(300, "same " * 40, None, None, None), (300, "same " * 40, None, None, None), (301, "x " + items[0][1] + " y", None, None, None)]
    return rows, items


def test_brute_force(spark):
    rows, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as fp", "'y' as length")
    for carry in (False, True):
        assert got(decontaminate.decontaminate(frame(spark, rows), bench, carry_text=carry)) == brute(rows, items)


def test_every_window_length_is_found(spark):
    """A shared span of exactly ten words at every offset, and of nine, which is none."""
    item = " ".join(f"w{k}" for k in range(40))
    rows = [(k, f"aa bb {' '.join(f'w{j}' for j in range(k, k + 10))} cc", None, None, None) for k in range(31)] + [(100 + k, f"aa bb {' '.join(f'w{j}' for j in range(k, k + 9))} cc", None, None, None) for k in range(31)]
    assert got(decontaminate.decontaminate(frame(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string"))) == brute(rows, [(1, item)])


def test_table(spark):
    docs, items = (table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "benchmark"))
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    assert any(w[5] for w in want)
    assert got(decontaminate.decontaminate(docs, items, carry_text=False)) == want


def test_empty(spark):
    rows, items = case()
    none = spark.createDataFrame([], "item_id long, text string")
    assert got(decontaminate.decontaminate(frame(spark, rows), none)) == brute(rows, [])
    assert decontaminate.decontaminate(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).collect() == []


def test_stage_columns(spark):
    rows, items = case()
    docs = frame(spark, rows)
    out = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {"text", "source", "lang", "doc_id"} <= set(out.columns) and out.count() == len(rows)
    assert sorted(str(r.text) for r in out.collect()) == sorted(str(r[1]) for r in rows)
