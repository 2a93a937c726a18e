"""Helpers that the training-data operators share: byte-level text blocks, rolling hashes, graph components."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.scratch import cut, release, scope, scratch_dir

__all__ = ["cut", "release", "scope", "scratch_dir"]

#: Bytes of text that one numpy block holds (a longer text gets a block of its own).
BLOCK_BYTES = 1 << 18
#: Texts in one block at most, so that a text's number in its block fits 16 bits.
BLOCK_TEXTS = 1 << 16
#: Bits of a key filter: 2 MB, however many keys it takes.
FILTER_BITS = 1 << 24
#: Bytes of an Arrow batch inside small_batches (a longer row gets a batch of its own).
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Work that runs inside sends rows to Python and back in batches of BATCH_BYTES, unless the session sets a limit of its own.

    Spark's 64 MB make a task's whole input one batch, which the JVM builds outside its heap and the worker holds with its results; neither gives that memory back.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(name)


def append_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their texts' UTF-8 bytes end to end, where each text starts and the end); null counts as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")
        _, offsets, data = texts.buffers()
        wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
        at = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        first = 0
        while first < len(texts):
            last = min(max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1), first + BLOCK_TEXTS)
            yield batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]
            first = last


#: Stands for the byte 0 in words, since 0 marks separators; UTF-8 never has it.
NUL_WORD = 0xFF


def word_table(lower: bool, separators: bytes) -> np.ndarray:
    """Per byte: 0 for a separator, else the byte, A-Z lower-cased if asked; a NUL inside a word is NUL_WORD."""
    out = np.arange(256, dtype=np.uint8)
    out[0] = NUL_WORD
    if lower:
        out[ord("A") : ord("Z") + 1] += 32
    out[list(separators)] = 0
    return out


#: Separators of words [^\x20\x09-\x0D]+ and of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (upper-case letters are lower-cased before).
SPACES = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def word_spans(kept: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end of each word, number of words before each text and in all); kept: bytes with 0 for separators."""
    if not len(kept):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    inside = kept != 0
    new_text = np.zeros(len(kept) + 1, bool)
    new_text[starts] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | new_text[1:-1]
    ends[:-1] &= ~inside[1:] | new_text[1:-1]
    at = np.flatnonzero(begins)
    return at, np.flatnonzero(ends) + 1, np.searchsorted(at, starts)


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << int(n).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums that give the polynomial hash of any slice: see slice_hash."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def slice_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes begin..end of each slice; equal slices agree wherever they stand."""
    _, down = powers(len(sums))
    return mixed((sums[end] - sums[begin]) * down[begin])


def spread_join(left: DataFrame, right: DataFrame, key: str, weight: str, parts: int = 16, share: int = 200) -> DataFrame:
    """left inner join right on `key`, which is unique in right; `weight` counts the key's rows in left.

    Keys with more than 1/share of all rows, of which there are fewer than `share` (so their list may go to every task), are dealt
    to `parts` tasks by a hash of the whole left row; right rows of these keys go to each.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = right.where(F.col(weight) * share > total).select(F.col(key), F.lit(True).alias("__hot"))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*left.columns), F.lit(parts))).otherwise(0).cast("int")
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("__salt", salt).drop("__hot")
    copies = F.when(F.col(weight) * share > total, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(right.withColumn("__salt", F.explode(copies)), [key, "__salt"]).drop("__salt")


def key_filter(keys: DataFrame, key: Column) -> DataFrame:
    """A bitmap of the hashes `key` modulo FILTER_BITS, in slices of 512 bits, those without a bit left out: see possible."""
    spot = F.pmod(key, F.lit(FILTER_BITS)) + 1
    whole = keys.groupBy(F.bitmap_bucket_number(spot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits"))
    slices = whole.selectExpr("inline(transform(sequence(0, 63), k -> struct((bucket - 1) * 64 + k as __slice, substring(bits, k * 64 + 1, 64) as __bits)))")
    return cut(slices.where(F.col("__bits") != F.unhex(F.lit("00" * 64))))


def possible(rows: DataFrame, bitmap: DataFrame, key: Column) -> DataFrame:
    """`rows` with __may: false for hashes `key` that the filter surely has not taken. So a join need not shuffle long rows that find no partner.

    A full filter lets more rows through to the join, which decides.
    """
    spot = F.pmod(key, F.lit(FILTER_BITS))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(spot % 512 / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.pow(F.lit(2), spot % 8).cast("int")) != 0
    met = rows.withColumn("__slice", F.floor(spot / 512).cast("long")).join(F.broadcast(bitmap), "__slice", "left")
    return met.select(*rows.columns, F.coalesce(bit, F.lit(False)).alias("__may"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest reachable node) for every node of the undirected edges.

    Alternates large-star and small-star steps, so that the number of rounds grows with the logarithm of the largest
    component and no group of neighbours is ever gathered in one task: each step is a minimum per node (combined before
    the shuffle) and an equi-join. Every step's edges are written to the shared folder, so that each plan is short; they go with the last round.
    """
    with scope() as keep:
        now = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
        while not _stars(now):
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
            low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
            now = cut(large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        return keep(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


def _stars(edges: DataFrame) -> bool:
    """Whether each node u has one edge and is no other's v: then every v < u is the smallest of its component."""
    ends = edges.selectExpr("u as node", "1L as own", "0 as hub").unionByName(edges.selectExpr("v as node", "0L as own", "1 as hub"))
    return not ends.groupBy("node").agg(F.sum("own").alias("own"), F.max("hub").alias("hub")).where("own + hub > 1 and own > 0").agg(F.count("*")).first()[0]
