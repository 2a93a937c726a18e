"""Whitening against exact fractions and a plain two-pass covariance."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quireflow.llm import whitening
from quireflow.llm.common import table
from quireflow.llm.queries import op13_whitening

SCHEMA = "vec_id long, embedding array<double>, label string, n string, component string, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "l", "n", "c", "x") for i, v in rows], SCHEMA).repartition(3)


def numbers(v) -> list[int] | None:
    if not v or any(c is None or not math.isfinite(c) for c in v):
        return None
    return [math.floor(64 * float(c)) + 1_000_000 for c in v]


def hold(rows: list[tuple], got: list, components: int = 16) -> None:
    """Everything the results promise, from plain loops: exact sums, the eigen-equation of a two-pass covariance, unit variance."""
    usable = [(i, numbers(v)) for i, v in rows if numbers(v)]
    fit = sorted({tuple(x) for _, x in usable})
    n, d = len(fit), len(fit[0])
    sums = [sum(c) for c in zip(*fit)]
    dev = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    cov = dev.T @ dev / n
    by_vector = defaultdict(list)
    assert Counter((r.vec_id, r.component) for r in got) == Counter((i, k) for i, _ in usable for k in range(1, min(components, d) + 1))
    for r in got:
        assert r.n == n
        by_vector[r.vec_id].append(r)
    place = {tuple(x): k for k, x in enumerate(fit)}
    out = np.full((n, min(components, d)), np.nan)
    for i, x in usable:
        for r in by_vector[i]:
            assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            out[place[tuple(x)], r.component - 1] = np.nan if r.whitened is None else r.whitened
    one = sorted(by_vector[usable[0][0]], key=lambda r: r.component)[: min(components, d)]
    e = np.array([r.eigenvalue for r in one])
    assert (np.diff(e) <= 1e-9 * e[0]).all() and np.allclose(e, np.sort(np.linalg.eigvalsh(cov))[::-1][: len(e)], rtol=1e-9, atol=1e-9 * e[0])
    sound = np.array([r.whitened is not None for r in one])
    for k in np.flatnonzero(sound):
        axis = np.linalg.lstsq(dev, out[:, k] * np.sqrt(e[k]), rcond=None)[0]  # the direction that the results project on
        assert np.allclose(cov @ axis, e[k] * axis, atol=1e-7 * e[0])
        assert math.isclose(one[k].explained, e[k] / np.trace(cov), rel_tol=1e-6)
    w = out[:, sound]
    w = w - w.mean(0)
    worst = np.abs(w.T @ w / n - np.eye(int(sound.sum()))).max()
    assert worst < 1e-6 and {r.identity_error for r in got} == {one[0].identity_error} and one[0].identity_error < 1e-6


def vectors(n: int, d: int, seed: int = 3) -> list[tuple]:
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) @ np.diag(1.5 ** -np.arange(d)) @ np.linalg.qr(rng.normal(size=(d, d)))[0]
    return [(k, [float(c) for c in v]) for k, v in enumerate(base)]


def test_definition_with_awkward_rows(spark):
    """A third of the rows alike, repeated ids, null and non-finite entries, ties; n > 16 dimensions."""
    rows = vectors(120, 20)
    rows += [(1000 + k, rows[0][1]) for k in range(60)] + [(7, rows[7][1])]
    rows += [(2000, None), (2001, rows[1][1][:5] + [None] + rows[1][1][6:]), (2002, [math.nan] * 20), (2003, [math.inf] + [0.0] * 19), (2004, []), (2005, [-0.0] * 20), (2006, [0.001] * 20)]
    hold(rows, whitening.whiten(frame(spark, rows)).collect())


def test_fewer_dimensions_than_components_and_large_entries(spark):
    rows = vectors(40, 3) + [(500, [3e3, -2e3, 1e3])]
    got = whitening.whiten(frame(spark, rows)).collect()
    hold(rows, got)
    huge = vectors(5, 3) + [(6, [1e15, 0.0, 0.0]), (7, [1e30, 0.0, 0.0]), (8, [-1e300, 0.0, 0.0])]
    got = whitening.whiten(frame(spark, huge)).collect()
    assert {r.vec_id for r in got} == {0, 1, 2, 3, 4, 6} and {r.deviation is None for r in got if r.vec_id == 6} == {True}


def test_directions_without_variance(spark):
    got = whitening.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (None, [0.5, 0.25])])).collect()
    assert Counter((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got) == Counter((i, k, 1, 0, None, None, None) for i in (1, 2, None) for k in (1, 2))
    rows = [(k, [float(k), 2.0 * k, 7.0]) for k in range(10)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {(r.component, r.whitened is None) for r in got} == {(1, False), (2, True), (3, True)} and max(r.identity_error for r in got) < 1e-9


def test_each_length_is_a_list_of_its_own(spark):
    short, long = vectors(20, 2), [(100 + i, v) for i, v in vectors(30, 4)]
    got = whitening.whiten(frame(spark, short + long)).collect()
    hold(short, [r for r in got if r.vec_id < 100])
    hold(long, [r for r in got if r.vec_id >= 100])


def test_empty_tables(spark):
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitening.whiten(frame(spark, rows)).count() == 0


def test_whole_table(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    hold(rows, op13_whitening(spark, sf_dir).collect())
    assert op13_whitening(spark, sf_dir).where(F.col("whitened").isNull()).count() == 0
