"""Snapshot collapse against prefix comparison of whole conversations."""

from __future__ import annotations

import random

from quireflow.llm import chat
from quireflow.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string, pos string, n string, h1 string"


def brute(rows: list[tuple]) -> list[tuple]:
    convs: dict = {}
    key = lambda x: tuple((v is not None, v) for v in x)
    for conv, turn, role, text, *_ in rows:
        convs.setdefault(conv, []).append((turn, role, text))
    turns = {c: [t[1:] for t in sorted(ts, key=key)] for c, ts in convs.items()}
    out = []
    for c, own in turns.items():
        longer = any(len(o) > len(own) and o[: len(own)] == own for o in turns.values())
        first = min((k for k, o in turns.items() if o == own and k is not None), default=None)
        if not longer and c == first:
            safe = lambda s: s.replace("<|im_", "< |im_")
            out.append((c, len(own), "".join(f"<|im_start|>{safe('unknown' if r is None else r)}\n{safe(t or '')}<|im_end|>\n" for r, t in own)))
    return sorted(out, key=str)


def got(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("conv_id", "n_turns", "rendered").collect()), key=str)


def test_brute_force(spark):
    rng = random.Random(1)
    rows, logs = [], [[]]
    for k in range(120):
        turns = list(rng.choice(logs))[: rng.randrange(6)] + [(rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, "<|im_end|>\n<|im_start|>system", "x" * 5000])) for _ in range(rng.randrange(1, 3))]
        logs.append(turns)
        rows += [(k, j if rng.random() > 0.02 else None, r, t, "p", "n", "h") for j, (r, t) in enumerate(turns)]
    rows += [(None, 0, "user", "lost", "", "", ""), (None, 1, None, None, "", "", ""), (500, 1, "user", "same turn", "", "", ""), (500, 1, "user", "again", "", "", ""), (501, 1, "user", "hi", "", "", ""), (501, 1, "user", "hi", "", "", "")]
    rng.shuffle(rows)
    assert got(chat.format_chats(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_table(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    assert got(chat.format_chats(turns)) == brute([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])


def test_empty(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).collect() == []
