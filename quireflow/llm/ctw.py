"""Language-model scoring by context-tree weighting over bytes.

Each byte is eight binary decisions; the decision at a node (the bits of the byte so far) has a context tree over the
preceding DEPTH bytes. Every tree node holds a Krichevsky-Trofimov estimate, and the weighting mixes all depths from 0 to
DEPTH: P_w = (P_kt + product of the children's P_w) / 2. The score of a text is the log10 probability of its bytes
(A-Z lower-cased) and one end byte under the mixture learnt from the training texts. A word model with add-one smoothing
is reported beside it as the base.

Plan: texts are dealt by a hash into batches of about BATCH_BYTES and at most about BATCH_ROWS texts. Every batch sends its different (context, byte) grams and
words with their training counts; sums per gram and per word are the model, which grows with the corpus and stays
distributed. Trees are evaluated in tasks that each hold whole subtrees (all grams whose two nearest context bytes agree meet in one
task); only the two top levels, at most 65,536 nodes, pass through the driver. Each batch then receives the values of its own grams and
words and scores its texts. No task holds more than one batch or one part of the model.

Null texts are empty (only the end is scored). Null ids count as training texts. Each repeated row is counted and scored.
With no training text every estimate is one half per bit and the base is log10(1) per token. Empty tables give none. Very long texts
are a batch of their own. Values of grams travel in single precision (relative error 6e-8). Columns other than doc_id and text take no
part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import SPACES, blocks, cut, prefix_sums, slice_hash, word_spans, word_table

DEPTH = 5  # context bytes; gram keys are 48 bits: nearest byte first, the coded byte last
BATCH_BYTES, BATCH_ROWS = 16 << 20, 1 << 13
PIECE = 1 << 17  # grams whose subtrees are evaluated together
WORD_KEY = 1 << 62
END_KEY = WORD_KEY  # the end token's
_LOWER = word_table(True, b"")
_WORDS = word_table(True, SPACES)
Z = np.uint64


def gram_keys(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key and text number of every byte of every text and of each text's end; contexts before a text's start are zeros."""
    n, texts = np.diff(starts), len(starts) - 1
    laid = np.zeros(len(data) + texts * (DEPTH + 1), np.uint8)
    text_of = np.repeat(np.arange(texts), n)
    laid[np.arange(len(data)) + text_of * (DEPTH + 1) + DEPTH] = _LOWER[data]
    key = laid[DEPTH:].astype(Z)
    for k in range(1, DEPTH + 1):
        key |= laid[DEPTH - k : len(laid) - k].astype(Z) << Z(8 * (DEPTH + 1 - k))
    owner = np.repeat(np.arange(texts), n + 1 + DEPTH)[: len(key)]
    place = np.arange(len(key)) - (starts[:-1] + np.arange(texts) * (DEPTH + 1))[owner]
    real = place <= n[owner]
    return key[real], owner[real]


def word_keys(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of every word, and the words before each text and in all."""
    kept = _WORDS[data]
    begin, end, first = word_spans(kept, starts)
    keys = slice_hash(prefix_sums(kept), begin, end) >> Z(2)
    return np.where(keys == 0, Z(1), keys) | Z(WORD_KEY), first


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batch, key, n of the different grams and words of each batch (rows in order of batch); n: how often in training texts."""
    now, parts = None, []

    def merged() -> None:
        parts[:] = [summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]

    def out() -> Iterator[pa.RecordBatch]:
        if parts:
            merged()
            keys, counts = parts[0]
            for k in range(0, len(keys), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), now, np.int32)), pa.array(keys[part].view(np.int64)), pa.array(counts[part].astype(np.int64))], names=["batch", "key", "n"])
        parts.clear()

    for batch in batches:
        number = batch.column(batch.schema.get_field_index("batch")).to_numpy()
        edges = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
        for a, b in zip(edges, edges[1:]):
            if b > a and number[a] != now:
                yield from out()
                now = int(number[a])
            for rows, data, starts in blocks([batch.slice(a, b - a)], "text"):
                held = rows.column(rows.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False).astype(bool)
                grams, owner = gram_keys(data, starts)
                words, first = word_keys(data, starts)
                word_owner = np.repeat(np.arange(len(held)), np.diff(first))
                for keys, whose in ((grams, owner), (words, word_owner), (np.full(len(held), END_KEY, Z), np.arange(len(held)))):
                    learnt, unseen = keys[~held[whose]], keys[held[whose]]
                    parts.append(_counted(learnt))
                    unseen = _counted(unseen)[0]
                    parts.append((unseen, np.zeros(len(unseen), np.int64)))
                if sum(len(p[0]) for p in parts) > 2_500_000:
                    merged()
    yield from out()


_SHIFT = 8


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift, within 1e-12 for x >= 1/2."""
    low = np.zeros_like(x)
    for k in range(_SHIFT):
        low += np.log(x + k)
    y = x + _SHIFT
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - low


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def _bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node of the byte's prefix, bit) of the eight decisions of each key's byte."""
    symbol = (keys & Z(255)).astype(np.int64)[:, None]
    j = np.arange(8)
    return (1 << j) | (symbol >> (8 - j)), (symbol >> (7 - j)) & 1


class Level:
    """The tree nodes of one depth: different (context, prefix) with their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, prefix: np.ndarray, bit: np.ndarray):
        context = keys >> Z(8 * (DEPTH - depth) + 8) if depth else np.zeros(len(keys), Z)
        name = (context[:, None] << Z(8)) | prefix.astype(Z)
        self.names, self.at = np.unique(name.ravel(), return_inverse=True)
        n = np.repeat(counts, 8).astype(np.float64)
        one = bit.ravel() == 1
        self.ones = np.bincount(self.at, n * one, len(self.names))
        self.zeros = np.bincount(self.at, n * ~one, len(self.names))
        self.kt = log_kt(self.zeros, self.ones)

    def parents(self) -> np.ndarray:
        return ((self.names >> Z(16)) << Z(8)) | (self.names & Z(255))

    def weigh(self, child: Level | None) -> None:
        below = np.zeros(len(self.names)) if child is None else np.bincount(np.searchsorted(self.names, child.parents()), child.weighted, len(self.names))
        self.weighted = self.kt if child is None else np.logaddexp(self.kt, below) - np.log(2)
        self.beta = np.exp(np.clip(self.kt - below, -600, 600))

    def estimate(self, bit: np.ndarray) -> np.ndarray:
        own = np.where(bit.ravel() == 1, self.ones[self.at], self.zeros[self.at])
        return (own + 0.5) / (self.zeros + self.ones + 1)[self.at]


def subtrees(keys: np.ndarray, counts: np.ndarray, least: int = 2) -> tuple[list[Level], np.ndarray]:
    """Levels DEPTH..least over whole subtrees, weighed from below; the bits coded."""
    prefix, bit = _bits(keys)
    levels: list[Level] = []
    for depth in range(DEPTH, least - 1, -1):
        level = Level(keys, counts, depth, prefix, bit)
        level.weigh(levels[-1] if levels else None)
        levels.append(level)
    return levels, bit


def top_levels(names: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables [context byte, prefix] and [prefix] of (zeros, ones, beta) for depths 1 and 0; below: sums of the children's log P_w."""
    one = np.zeros((256, 256, 3))
    one[..., 2] = 1
    at = (names >> 8, names & 255)
    kt = log_kt(zeros, ones)
    one[at] = np.stack([zeros, ones, np.exp(np.clip(kt - below, -600, 600))], 1)
    weighted = np.zeros((256, 256))
    weighted[at] = np.logaddexp(kt, below) - np.log(2)
    zero = np.stack([one[..., 0].sum(0), one[..., 1].sum(0), np.zeros(256)], 1)
    zero[:, 2] = np.exp(np.clip(log_kt(zero[:, 0], zero[:, 1]) - weighted.sum(0), -600, 600))
    return one, zero


def log_probabilities(keys: np.ndarray, counts: np.ndarray, one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """log10 probability of each key's byte in its context."""
    levels, bit = subtrees(keys, counts)
    p = levels[0].estimate(bit)
    for level in levels[1:]:
        beta = level.beta[level.at]
        p = (beta * level.estimate(bit) + p) / (beta + 1)
    prefix, _ = _bits(keys)
    near = (keys >> Z(8 * DEPTH)).astype(np.int64)
    for rows in (one[near[:, None], prefix].reshape(-1, 3), zero[prefix].reshape(-1, 3)):
        own = np.where(bit.ravel() == 1, rows[:, 1], rows[:, 0])
        p = (rows[:, 2] * (own + 0.5) / (rows[:, 0] + rows[:, 1] + 1) + p) / (rows[:, 2] + 1)
    return np.log10(p).reshape(-1, 8).sum(1)


def _pieces(keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The grams in order, a number of whole subtrees at a time: memory is that of PIECE grams or of one subtree."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    tree = keys >> Z(8 * (DEPTH - 1))
    edges = np.append(np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]])) if len(keys) else np.zeros(0, np.int64), len(keys))
    begin = 0
    for stop, after in zip(edges[1:].tolist(), [*edges[2:].tolist(), None]):
        if after is None or after - begin > PIECE:
            yield keys[begin:stop], counts[begin:stop]
            begin = stop


def _whole(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    table = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    return tuple(np.concatenate([t[k] for t in table]) if table else np.zeros(0, np.int64) for k in (0, 1))


def upper_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """name (nearest byte, prefix), counts and the sum of log P_w of the depth-2 nodes below, as far as this task's subtrees go."""
    keys, counts = _whole(batches)
    for keys, counts in _pieces(keys.view(Z), counts):  # noqa: B020
        level = subtrees(keys, counts)[0][-1]
        names, at = np.unique(level.parents(), return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), *(pa.array(np.bincount(at, x)) for x in (level.zeros, level.ones, level.weighted))], names=["name", "zeros", "ones", "below"])


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batch, blob: the answers (batch, key, value) of this task per batch, keys as differences, compressed for the way."""
    held: list[tuple[np.ndarray, ...]] = []

    def out() -> pa.RecordBatch:
        batch, keys, values = (np.concatenate([h[k] for h in held]) for k in range(3))
        order = np.lexsort((keys, batch))
        batch, keys, values = batch[order], keys[order], values[order]
        edges = [0, *(np.flatnonzero(np.diff(batch)) + 1).tolist(), len(batch)]
        blobs = [pa.compress(np.diff(keys[a:b], prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes() + values[a:b].view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True) for a, b in zip(edges, edges[1:])]
        rows = np.diff(edges)
        return pa.RecordBatch.from_arrays([pa.array(batch[edges[:-1]], pa.int32()), pa.array(rows, pa.int32()), pa.array(blobs, pa.binary())], names=["batch", "rows", "blob"])

    for b in batches:
        if b.num_rows:
            held.append(tuple(b.column(k).to_numpy() for k in range(3)))
        if sum(len(h[0]) for h in held) >= 1 << 21:
            yield out()
            held.clear()
    if held:
        yield out()


def unpacked(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a batch in order, and their values."""
    keys, values = [np.zeros(0, np.int64)], [np.zeros(0)]
    for n, blob in zip(answers.column("rows").to_pylist(), answers.column("blob").to_pylist()):
        raw = np.frombuffer(pa.decompress(blob, 16 * n, "zstd", asbytes=True), np.uint8)
        keys.append(np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.int64).ravel()))
        values.append(np.ascontiguousarray(raw[8 * n :].reshape(8, n).T).view(np.float64).ravel())
    keys, values = np.concatenate(keys).view(Z), np.concatenate(values)
    order = np.argsort(keys)
    return keys[order], values[order]


def score_batch(docs: pa.Table, answers: pa.Table, n_train: int, n_words: int) -> pa.Table:
    keys, value = unpacked(answers)
    split = int(np.searchsorted(keys, Z(WORD_KEY)))
    out = []
    for rows, data, starts in blocks(docs.to_batches(), "text"):
        texts = rows.num_rows
        grams, owner = gram_keys(data, starts)
        packed = np.sort((grams << Z(16)) | owner.astype(Z))
        first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
        each = packed[first]
        logs = value[:split][np.searchsorted(keys[:split], each >> Z(16))]
        score = np.bincount((each & Z(0xFFFF)).astype(np.int64), logs * np.diff(np.append(first, len(packed))), texts)
        words, ends = word_keys(data, starts)
        count = value[split:][np.searchsorted(keys[split:], np.append(words, Z(END_KEY)))]
        whose = np.repeat(np.arange(texts), np.diff(ends))
        logs = np.log10((count + 1) / (n_train + n_words + 1))
        base = np.bincount(whose, logs[:-1], texts) + logs[-1]
        known = np.bincount(whose, count[:-1] > 0, texts).astype(np.int64) + int(count[-1] > 0)
        get = lambda c: rows.column(rows.schema.get_field_index(c))
        per_byte = -score / np.log10(2) / np.bincount(owner, minlength=texts)
        out.append(pa.RecordBatch.from_arrays([get("doc_id"), get("held_out"), pa.array(np.diff(ends) + 1), pa.array(known), pa.array(np.full(texts, n_train)), pa.array(base), pa.array(score), pa.array(per_byte)], names=NAMES))
    return pa.Table.from_batches(out)


NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]


def score_texts(docs: DataFrame, held_out: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte (code length, the end counted as a byte); held_out: SQL condition of the rows not learnt from."""
    rows = docs.select("doc_id", "text", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"))
    size, count = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    n = max(1, -(-size // batch_bytes), -(-count // BATCH_ROWS))
    dealt = rows.withColumn("batch", F.expr(f"cast(pmod(xxhash64(doc_id, text), {n}) as int)"))
    # As many partitions as the session sets; each holds whole batches one after the other.
    found = cut(dealt.repartition("batch").sortWithinPartitions("batch").mapInArrow(gathered, "batch int, key long, n long"))
    counts = cut(found.groupBy("key").agg(F.sum("n").alias("n")))
    words, grams = counts.where(F.col("key") >= WORD_KEY), counts.where(F.col("key") < WORD_KEY)
    n_train, n_words = (int(x or 0) for x in words.where("n > 0").agg(F.sum("n"), F.count("*")).first())

    trees = grams.repartition(F.shiftright("key", 8 * (DEPTH - 1)))
    upper = trees.mapInArrow(upper_nodes, "name long, zeros double, ones double, below double").groupBy("name").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toPandas()  # at most 65,536 rows
    tops = docs.sparkSession.sparkContext.broadcast(top_levels(upper["name"].to_numpy(np.int64), *(upper[c].to_numpy(np.float64) for c in ("zeros", "ones", "below"))))

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = _whole(batches)
        for keys, n in _pieces(keys.view(Z), n):  # noqa: B020
            # Single precision is plenty for a logarithm and halves what travels.
            logs = log_probabilities(keys, n, *tops.value).astype(np.float32).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(logs)], names=["key", "value"])

    values = trees.mapInArrow(valued, "key long, value double").unionByName(words.select("key", F.col("n").cast("double").alias("value")))
    answers = found.select("batch", "key").join(values, "key").select("batch", "key", "value").mapInArrow(packed, "batch int, rows int, blob binary")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(lambda d, v: score_batch(d, v, n_train, n_words), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
