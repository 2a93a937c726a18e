"""Embedding whitening: principal components of the different vectors, every vector projected on them and scaled to unit variance.

1. Each entry c becomes the whole number floor(64 * c) + 1,000,000. The fit list is every different vector of such numbers, once.
2. Its size n and the sums S per dimension are whole numbers too (partial sums in tasks, added in decimals), so centring is exact:
   with S = q * n + r an entry's deviation is (x - q) - r / n, whatever n.
3. MLlib's RowMatrix over the centred rows gives the Gramian; divided by n it is the covariance. Its eigenvectors (dimensions squared
   numbers, all that the driver holds) are broadcast and every row is projected in mapInPandas.
4. The covariance of the fit list's own results, centred again, is held against the identity.

Rows whose vector is null, empty or holds null or non-finite entries, or entries that no whole number below 2**62 can stand for, are dropped.
Repeated rows each get their results and count once in the fit list. Vectors of different lengths are lists of their own. Directions
without variance (one vector, equal entries, fewer vectors than dimensions) have no scale: their rows have a null `whitened`; `explained` is
null where nothing varies at all. A deviation that a long cannot hold is null. Ties between eigenvalues are in the order of the solver; each
component's largest entry is positive. Columns other than vec_id and embedding take no part. Empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import cut

SCALE, SHIFT, COMPONENTS, LIMIT = 64, 1_000_000, 16, float(1 << 62)
_LONG = (1 << 63) - 1


def codes(vectors: DataFrame) -> DataFrame:
    """vec_id and x, the whole numbers of each usable vector."""
    each = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT))
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double") * SCALE) < LIMIT))
    return vectors.where(F.coalesce(usable, F.lit(False))).select("vec_id", each.alias("x"))


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(-1, size)


def exact_sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of rows and sum of each dimension, exact; a task hands on one row per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(size, object)
        for batch in batches:
            x = matrix(batch.column(0), size)
            if len(x):
                # Halves of 31 bits: no batch can overflow their sums.
                total += (x >> 31).sum(0).astype(object) * (1 << 31) + (x & ((1 << 31) - 1)).sum(0).astype(object)
                n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(size), pa.int32()), "n": pa.array([n] * size, pa.int64()), "total": pa.array([str(t) for t in total], pa.string())})

    sums = fit.mapInArrow(run, "at int, n long, total string").groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total"))
    rows = sorted(sums.collect())
    return rows[0]["n"], [int(r["total"]) for r in rows]


def covariance(rows: DataFrame, n: int) -> np.ndarray:
    """Of already centred rows, in a column of vectors."""
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows)).computeGramianMatrix().toArray() / n


class Fit:
    """What tasks need: dimensions' whole and broken means, directions and their scales."""

    def __init__(self, n: int, sums: list[int], cov: np.ndarray, components: int):
        self.n, self.base = n, np.array([s // n for s in sums], np.int64)
        self.rest = [s % n for s in sums]
        self.offset = np.array([r / n for r in self.rest])
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(-values, kind="stable")[:components]
        self.values, self.axes = values[order], vectors[:, order]
        top = np.abs(self.axes).argmax(0)
        self.axes = self.axes * np.where(self.axes[top, range(len(order))] < 0, -1.0, 1.0)
        self.flat = self.values <= len(sums) * np.finfo(float).eps * max(values.max(), 0.0)
        trace = float(np.trace(cov))
        self.explained = self.values / trace if trace > 0 else np.full(len(order), np.nan)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """NaN in directions without variance."""
        return ((x - self.base) - self.offset) @ self.axes / np.sqrt(np.where(self.flat, np.nan, self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)**2 = n**2 * sum u**2 - 2 * n * sum u * r + sum r**2, for u = x - q; None beyond a long."""
        u = x - self.base
        if int(np.abs(u).max(initial=0)) ** 2 * u.shape[1] > _LONG or int(np.abs(u).max(initial=0)) * max(self.rest) * u.shape[1] > _LONG:
            u = u.astype(object)
        rest = np.array(self.rest, u.dtype)
        last = sum(r * r for r in self.rest)
        out = (self.n * self.n * a - 2 * self.n * b + last for a, b in zip((u * u).sum(1).tolist(), (u * rest).sum(1).tolist()))
        return [d if d <= _LONG else None for d in out]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue: a row for each usable vector and component."""
    spark, kind = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    coded = codes(vectors.select("vec_id", "embedding"))
    fit = cut(coded.select("x").distinct())
    out = spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double")
    for size in sorted(r[0] for r in fit.select(F.size("x")).distinct().collect()):
        out = out.unionByName(_whiten(coded.where(F.size("x") == size), fit.where(F.size("x") == size), size, components, kind))
    return out


def _whiten(coded: DataFrame, fit: DataFrame, size: int, components: int, kind: str) -> DataFrame:
    spark = coded.sparkSession
    n, sums = exact_sums(fit, size)
    base, offset = F.lit([s // n for s in sums]), F.lit([s % n / n for s in sums])
    deviation = F.zip_with(F.zip_with("x", base, lambda x, q: (x - q).cast("double")), offset, lambda u, r: u - r)
    model = Fit(n, sums, covariance(fit.select(array_to_vector(deviation).alias("row")), n), components)
    sent = spark.sparkContext.broadcast(model)
    sound = ~model.flat

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"w": pa.array(list(sent.value.whitened(matrix(batch.column(0), size))[:, sound]), pa.list_(pa.float64()))})

    error = None
    if sound.any():
        own = cut(fit.select("x").mapInArrow(project, "w array<double>"))
        centre = [r[1] / n for r in sorted(own.select(F.posexplode("w")).groupBy("pos").agg(F.sum("col")).collect())]
        again = covariance(own.select(array_to_vector(F.zip_with("w", F.lit(centre), lambda w, m: w - m)).alias("row")), n)
        error = float(np.abs(again - np.eye(int(sound.sum()))).max())

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        k = len(model.values)
        for frame in frames:
            if len(frame):
                x = np.stack(frame["x"].to_numpy())
                yield pd.DataFrame(
                    {
                        "vec_id": frame["vec_id"].repeat(k).array, "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), "n": n, "deviation": pd.array(model.deviations(x), "Int64").repeat(k),
                        "whitened": pd.array(model.whitened(x).ravel()), "explained": np.tile(model.explained, len(x)), "identity_error": error, "eigenvalue": np.tile(model.values, len(x)),
                    }
                )

    named = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"
    blank = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return coded.mapInPandas(rows, named).select("vec_id", "component", "n", "deviation", blank("whitened"), blank("explained"), "identity_error", "eigenvalue")
