"""Near-duplicate vectors against all pairs."""

from __future__ import annotations

import numpy as np
from tests.llm.fixtures import smallest_reachable

from quireflow.llm import embedding
from quireflow.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int, key string, kept string"


def brute(rows: list[tuple], least: float = 0.93) -> list[tuple]:
    ok = [i for i, (v, e, lab, *_) in enumerate(rows) if v is not None and lab is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links = []
    for a, i in enumerate(ok):
        for j in ok[a + 1 :]:
            x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                links.append((i, j))
    part = smallest_reachable(len(rows), links)
    ids = {}
    for i, p in enumerate(part):
        if rows[i][0] is not None:
            ids[p] = min(ids.get(p, rows[i][0]), rows[i][0])
    n = np.bincount(np.array(links, int).ravel(), minlength=len(rows)) if links else np.zeros(len(rows), int)
    return sorted(((rows[i][0], int(n[i]), ids.get(part[i])) for i in range(len(rows))), key=str)


def got(df) -> list[tuple]:
    rows = df.collect()
    assert all((r.kept == (r.vec_id == r.component_id)) if r.vec_id is not None else r.kept is None or not r.kept for r in rows)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in rows), key=str)


def awkward() -> list[tuple]:
    rng = np.random.default_rng(3)
    rows = []
    for k in range(150):
        base = rng.normal(size=16) if k % 3 == 0 else np.array(rows[rng.integers(len(rows))][1]) + rng.normal(0, 0.08 * (k % 4), 16)
        rows.append((k, [float(x) for x in base.astype(np.float32)], int(rng.integers(2)) if k % 20 else None))
    one = rows[0][1]
    odd = [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [*one[:-1], None], 1), (204, [float("inf"), *one[1:]], 1), (205, [], 1), (206, one[:8], 1), (207, [x * 1e30 for x in one], 1), (208, [x * 1e-30 for x in one], 1), (None, one, 1), (209, one, 1), (209, one, 1)]
    return [(*r, "k", "x") for r in rows + odd]


def test_all_pairs(spark):
    rows = awkward()
    assert got(embedding.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_hot_group_is_tiled(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=12)
    rows = [(k, [float(x) for x in (base + rng.normal(0, 0.12, 12)).astype(np.float32)], 1, "", "") for k in range(260)]
    assert got(embedding.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=16)) == brute(rows)


def test_empty(spark):
    assert embedding.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_recall_on_the_table(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    rows = [tuple(r) for r in vectors.select("vec_id", "embedding", "label").collect()]
    want, have = (dict((v, n) for v, n, _ in x) for x in (brute(rows), got(embedding.near_duplicates(vectors))))
    assert all(have[v] <= want[v] for v in want)
    assert sum(have.values()) >= 0.9 * sum(want.values())


def test_recall_at_the_threshold(spark):
    """Pairs planted right at cosine 0.93 to 0.94, where the filters see them least."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(400):
        x = rng.normal(size=64)
        x /= np.linalg.norm(x)
        y = rng.normal(size=64)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        c = 0.931 + 0.009 * rng.random()
        rows += [(2 * k, x.tolist(), k % 5, "", ""), (2 * k + 1, (c * x + np.sqrt(1 - c * c) * y).tolist(), k % 5, "", "")]
    have = {v: n for v, n, _ in got(embedding.near_duplicates(spark.createDataFrame(rows, SCHEMA)))}
    assert sum(have.values()) >= 0.97 * 800
