"""Benchmark decontamination by winnowing.

Texts are cut to words; a window is ten consecutive words of a benchmark item (an item of fewer words is one window).
Winnowing keeps, of each six consecutive five-word hashes of a text, the least (the leftmost of equals): any ten words
that two texts share therefore share a kept hash at the same place. Items shorter than ten words are found by the hash of
the whole item.

Plan: one scan of the documents finds the windows whose kept hash and whole hash may both occur in the benchmark (two bitmaps of
fixed size, BITMAP_BITS, go to every task; they only prune). Each such seed, extended to its window's words, is a row that
joins the benchmark's different windows by fingerprint and words; a window that very many documents hold is spread by a salt.
Two aggregates per text, covered words and items, give the result. Nothing gathers more than one text's windows.

Nulls and empty texts have no words: 0 hits. Very long texts are scanned whole. Repeated documents each get their row (their text
is judged once). Equal items each count, items of equal id once. Empty tables give no hits or no rows. Ties between hashes go to the
leftmost. Columns of the documents that bear the name of a result column are replaced by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireflow.llm.common import NOT_ALNUM, append_columns, blocks, cut, mixed, prefix_sums, slice_hash, word_spans, word_table

WINDOW, GRAM = 10, 5
BITMAP_BITS, SALTS = 1 << 25, 8
_WORDS = word_table(True, NOT_ALNUM)
_TRANSLATE = bytes(32 if x == 0 else int(x) for x in _WORDS)
RESULT = {"n_words": T.LongType(), "n_hit": T.LongType(), "n_items": T.LongType(), "items_sha256": T.StringType(), "contaminated": T.BooleanType()}
_FOUND = T.ArrayType(T.StructType([T.StructField("length", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("words", T.BinaryType())]))
_FOUND_ARROW = pa.struct([("length", pa.int32()), ("place", pa.int32()), ("fp", pa.int64()), ("words", pa.binary())])


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive word hashes; the length takes part."""
    n = max(0, len(words) - k + 1)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n])
    return out


def kept_hashes(grams: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The least of the `width` consecutive hashes from each start."""
    best = grams[starts]
    for j in range(1, width):
        best = np.minimum(best, grams[starts + j])
    return best


class Block:
    """Words of a block of texts: their bytes, hashes, and how many follow up to their text's end."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        kept = _WORDS[data]
        self.begin, self.end, self.first = word_spans(kept, starts)
        self.hashes = slice_hash(prefix_sums(kept), self.begin, self.end)
        self.counts = np.diff(self.first)
        self.room = np.repeat(self.first[1:], self.counts) - np.arange(len(self.hashes))
        self.raw = data

    def windows(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and kept hash of every window of `window` words; windows do not cross texts."""
        starts = np.flatnonzero(self.room >= window)
        return starts, kept_hashes(gram_hashes(self.hashes, gram), starts, window - gram + 1) if len(starts) else np.zeros(0, np.uint64)

    def whole(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Hash of all `length` words from each start."""
        return gram_hashes(self.hashes, length)[starts] if len(starts) else np.zeros(0, np.uint64)

    def words(self, start: int, length: int) -> bytes:
        return b" ".join(self.raw[self.begin[start] : self.end[start + length - 1]].tobytes().translate(_TRANSLATE).split())


def item_windows(items: DataFrame, window: int, gram: int) -> DataFrame:
    """item_id, length, fp, whole, words of every window of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in blocks(batches, "text"):
            block = Block(data, at)
            starts, fp = block.windows(window, gram)
            found = [(starts, np.full(len(starts), window), fp, block.whole(starts, window))]
            for k in np.unique(block.counts[(block.counts > 0) & (block.counts < window)]).tolist():
                short = block.first[:-1][block.counts == k]
                found.append((short, np.full(len(short), k), block.whole(short, k), block.whole(short, k)))
            starts, length, fp, whole = (np.concatenate(x) for x in zip(*found))
            owner = np.searchsorted(block.first, starts, "right") - 1
            words = [block.words(s, n) for s, n in zip(starts.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(owner)), pa.array(length, pa.int32()), pa.array(fp.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(words, pa.binary())], names=["item_id", "length", "fp", "whole", "words"])

    kind = items.schema["item_id"].dataType
    return items.select("item_id", "text").mapInArrow(run, T.StructType([T.StructField("item_id", kind), *(T.StructField(n, t) for n, t in (("length", T.IntegerType()), ("fp", T.LongType()), ("whole", T.LongType()), ("words", T.BinaryType())))]))


def bitmap(values: DataFrame, column: str) -> bytes:
    """Which of BITMAP_BITS slots the column's values fall in; at most that many numbers reach the driver."""
    slots = values.select(F.expr(f"pmod({column}, {BITMAP_BITS})").cast("int").alias("slot")).distinct().toPandas()["slot"].to_numpy()
    bits = np.zeros(BITMAP_BITS, bool)
    bits[slots] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = (hashes % np.uint64(BITMAP_BITS)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, carry_text: bool = True) -> DataFrame:
    """The documents with n_words, n_hit, n_items, items_sha256 and contaminated (see the module's text); carry_text=False leaves out the text column."""
    docs = docs.drop(*RESULT)
    items = cut(item_windows(benchmark, window, gram))
    short = tuple(sorted(r[0] for r in items.where(F.col("length") < window).select("length").distinct().collect()))  # at most window - 1 values
    sent = docs.sparkSession.sparkContext.broadcast((bitmap(items, "fp"), bitmap(items, "whole")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, whole = (np.frombuffer(b, np.uint8) for b in sent.value)
        for rows, data, at in blocks(batches, "text"):
            block = Block(data, at)
            starts, fp = block.windows(window, gram)
            some = may_hold(kept, fp)
            starts, fp = starts[some], fp[some]
            some = may_hold(whole, block.whole(starts, window))
            found = [(starts[some], np.full(int(some.sum()), window), fp[some])]
            for k in short:
                starts = np.flatnonzero(block.room >= k)
                fp = block.whole(starts, k)
                some = may_hold(whole, fp)
                found.append((starts[some], np.full(int(some.sum()), k), fp[some]))
            starts, length, fp = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(starts, kind="stable")
            starts, length, fp = starts[order], length[order], fp[order]
            owner = np.searchsorted(block.first, starts, "right") - 1
            many = np.bincount(owner, minlength=rows.num_rows)
            words = [block.words(s, n) for s, n in zip(starts.tolist(), length.tolist())]
            seeds = pa.StructArray.from_arrays([pa.array(length, pa.int32()), pa.array(starts - block.first[owner], pa.int32()), pa.array(fp.view(np.int64)), pa.array(words, pa.binary())], fields=list(_FOUND_ARROW))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), seeds)
            key = [hashlib.sha256(data[at[k] : at[k + 1]]).hexdigest() if many[k] else None for k in range(rows.num_rows)]
            columns = append_columns(rows, n_words=pa.array(block.counts, pa.int64()), __seeds=lists, __key=pa.array(key, pa.string()))
            yield columns if carry_text else columns.drop_columns(["text"])

    carried = [f for f in docs.schema.fields if carry_text or f.name != "text"]
    # Written once: the texts are scanned a single time whatever reads the result.
    scanned = cut(docs.mapInArrow(scan, T.StructType([*carried, T.StructField("n_words", T.LongType()), T.StructField("__seeds", _FOUND), T.StructField("__key", T.StringType())])))
    suspects = scanned.where(F.col("__key").isNotNull())
    # One row per different text from here on: copies cost nothing.
    seeds = suspects.groupBy("__key").agg(F.first("__seeds").alias("s")).select("__key", F.explode("s").alias("s")).select("__key", "s.*").withColumn("salt", F.expr(f"cast(pmod(xxhash64(__key, place), {SALTS}) as int)"))
    same = ["length", "fp", "words", "salt"]
    salted = lambda df: df.withColumn("salt", F.explode(F.array(*(F.lit(k) for k in range(SALTS)))))
    hits = cut(seeds.join(salted(items.select("length", "fp", "words").distinct()), same))

    along = Window.partitionBy("__key").orderBy("place", "length").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.col("place") + F.col("length")
    fresh = F.greatest(F.lit(0), stop - F.greatest(F.col("place"), F.coalesce(F.max(stop).over(along), F.lit(0))))
    covered = hits.withColumn("fresh", fresh).groupBy("__key").agg(F.sum("fresh").alias("n_hit"))
    named = items.select("length", "fp", "words", F.coalesce(F.col("item_id").cast("string"), F.lit("None")).alias("item")).distinct()
    held = hits.select("__key", *same).dropDuplicates(["__key", "length", "fp", "words"]).join(salted(named), same).groupBy("__key").agg(F.sort_array(F.collect_set("item")).alias("ids"))
    verdicts = covered.join(held, "__key").select("__key", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    judged = suspects.drop("__seeds").join(verdicts, "__key", "left").unionByName(scanned.where(F.col("__key").isNull()).drop("__seeds"), allowMissingColumns=True)
    nothing, zero = hashlib.sha256(b"").hexdigest(), F.lit(0).cast("long")
    return judged.select(*(f.name for f in carried), "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.lit(nothing)).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"))
