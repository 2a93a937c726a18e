"""Suffix-array dedup: removes every byte covered by a `length`-byte string (200) that also starts anywhere else.

1. Anchors. Of the GRAM-byte hashes inside each `length`-byte string the least one (leftmost of equals) is its anchor, so equal
   strings have equal anchors at equal offsets. Consecutive strings with one anchor are a run; its snippet is all their bytes.
2. A run whose anchor occurs once cannot repeat. Where all runs of an anchor have the same snippet they all repeat. Both are settled by
   one aggregation (combined before the shuffle) and a join; only anchors with different snippets remain, mostly the
   edges of repeated passages.
3. The remaining different snippets are dealt by anchor into shards; each shard is sorted by external induced sorting
   (see induced.py: disk-backed queues, common prefixes carried along), and neighbours that share `length` bytes are marked.
   Of an anchor with very many different snippets, which no one task may gather, the strings themselves are counted by two
   64-bit hashes, combined before the shuffle: as many rows as different strings, however often each occurs.
4. The marked strings become byte spans per document, which are cut from the text.

Matches never cross documents. Null texts are empty. Texts shorter than `length` never change. Repeated rows are copies of each
other: they lose all their bytes if long enough. Texts are judged as given, not as left after a removal. Rows are told apart by
doc_id and text hash. Ties between anchors go to the leftmost. Very long texts are scanned whole. Empty tables give none. Input columns
named like a result column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import blocks, cut, mixed, powers, prefix_sums, slice_hash, spread_join
from quireflow.llm.induced import repeated_positions

LENGTH, GRAM, SHARD_BYTES, HOT_SNIPPETS = 200, 96, 1 << 20, 4096
PLACE_BITS = 31  # of a block's length
_END = 0xFF  # never a byte of UTF-8 text


def rolling_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every `width` consecutive ones, by prefix and suffix minima of blocks."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs_of(data: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, anchor, snippet hash, first string, number of strings, anchor's place in the snippet) of every run of a block."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, empty, empty
    sums = prefix_sums(data)
    _, down = powers(len(sums))
    at = len(data) - gram + 1
    hashes = mixed((sums[gram:] - sums[:-gram]) * down[:at])
    # The place breaks ties, so the choice depends on the string alone and not on the block around it.
    low = np.uint64((1 << PLACE_BITS) - 1)
    winner = (rolling_min((hashes & ~low) | np.arange(at, dtype=np.uint64), length - gram + 1) & low).astype(np.int64)
    texts = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(winner)]
    whole = np.flatnonzero(np.arange(len(winner)) + length <= starts[1:][texts])
    if not len(whole):
        return empty, empty, empty, empty, empty, empty
    new = np.concatenate([[True], (winner[whole][1:] != winner[whole][:-1]) | (texts[whole][1:] != texts[whole][:-1])])
    first = whole[new]
    count = np.diff(np.append(np.flatnonzero(new), len(whole)))
    owner, anchor = texts[first], winner[first]
    snippet = slice_hash(sums, first, first + count + length - 1)
    snippet = mixed(snippet + (anchor - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + count.astype(np.uint64))
    return owner, hashes[anchor].view(np.int64), snippet.view(np.int64), first - starts[owner], count, anchor - first


def marked_strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """doc_id, tag, start, last of the repeated strings of each shard (rows in order of shard: doc_id, tag, first, times, shard, snippet)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shard = batch.column(batch.schema.get_field_index("shard")).to_numpy()
        edges = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if held and held[-1].column(held[-1].schema.get_field_index("shard"))[0].as_py() != shard[a]:
                yield from _marked_shard(pa.Table.from_batches(held), length)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield from _marked_shard(pa.Table.from_batches(held), length)


def _marked_shard(rows: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    texts = rows.column("snippet").to_pylist()
    at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
    marks = repeated_positions(np.frombuffer(bytes([_END]).join(texts) + bytes([_END]), np.uint8), length)
    first, times = (rows.column(c).to_numpy() for c in ("first", "times"))
    out = []
    for k in np.flatnonzero(times == 1):
        own = np.concatenate([[0], marks[at[k] : at[k + 1] - length].astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(own))
        out += [(k, first[k] + a, first[k] + b - 1) for a, b in zip(edges[::2], edges[1::2])]
    if out:
        k, start, last = (np.array(x, np.int64) for x in zip(*out))
        yield pa.RecordBatch.from_arrays([*(rows.column(c).take(pa.array(k)).combine_chunks() for c in ("doc_id", "tag")), pa.array(start), pa.array(last)], names=["doc_id", "tag", "start", "last"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; with keep_text also spans and the text that is left."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    tagged = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, starts in blocks(batches, "text"):
            owner, anchor, snippet, first, count, _ = runs_of(data, starts, length, gram)
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(2).take(at), *(pa.array(x) for x in (anchor, snippet)), *(pa.array(x.astype(np.int32)) for x in (first, count))], names=["doc_id", "tag", "anchor", "snippet", "first", "count"])

    runs = cut(tagged.mapInArrow(scan, f"doc_id {kind}, tag long, anchor long, snippet long, first int, count int"))
    anchors = runs.groupBy("anchor").agg(F.count("*").alias("n"), F.min("snippet").alias("low"), F.max("snippet").alias("high")).where("n > 1")
    anchors = cut(anchors.select("anchor", "n", (F.col("low") == F.col("high")).alias("alike")))
    shared = cut(spread_join(runs, anchors, "anchor", "n").drop("n"))
    alike = shared.where("alike").select("doc_id", "tag", F.col("first").cast("long").alias("start"), (F.col("first") + F.col("count") - 1).cast("long").alias("last"))

    mixed_ = shared.where("not alike")
    snippets = cut(mixed_.groupBy("anchor", "snippet").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "tag", "first", "count")).alias("one")))
    copied = snippets.where("times > 1").select(F.xxhash64("anchor", "snippet").alias("pair"), F.col("anchor").alias("__anchor"), F.col("snippet").alias("__snippet"), "times")
    again = spread_join(mixed_.withColumn("pair", F.xxhash64("anchor", "snippet")), copied, "pair", "times").where("anchor = __anchor and snippet = __snippet").select("doc_id", "tag", F.col("first").cast("long").alias("start"), (F.col("first") + F.col("count") - 1).cast("long").alias("last"))

    asked = snippets.select("one.doc_id", "one.tag", F.struct("anchor", "times", "one.first", "one.count").alias("run")).groupBy("doc_id", "tag").agg(F.collect_list("run").alias("runs"))
    hot = cut(snippets.groupBy("anchor").agg(F.count("*").alias("different")).where(F.col("different") > HOT_SNIPPETS))
    texts = tagged.join(asked, F.expr("true") & tagged["doc_id"].eqNullSafe(asked["doc_id"]) & (tagged["tag"] == asked["tag"])).select(tagged["doc_id"], tagged["tag"], "text", "runs")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw = batch.column(2)[row].as_py().encode()
                found = batch.column(3)[row].values
                anchor, times, first, count = (np.asarray(found.field(k)) for k in range(4))
                pieces = [raw[a : a + n + length - 1] for a, n in zip(first.tolist(), count.tolist())]
                n = len(pieces)
                same = pa.array(np.full(n, row))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(same), batch.column(1).take(same), pa.array(anchor), pa.array(times), pa.array(first.astype(np.int32)), pa.array(pieces, pa.binary())], names=["doc_id", "tag", "anchor", "times", "first", "snippet"])

    pieces = texts.dropDuplicates(["doc_id", "tag"]).mapInArrow(cut_out, f"doc_id {kind}, tag long, anchor long, times long, first int, snippet binary")
    pieces = pieces.join(hot.select("anchor", F.lit(True).alias("hot")), "anchor", "left")
    pieces = cut(pieces)
    volume = snippets.agg(F.sum(F.col("one.count") + length)).first()[0] or 0
    shards = max(1, -(-volume // SHARD_BYTES))
    # As many partitions as the session sets; each holds whole shards one after the other.
    dealt = pieces.where("hot is null").withColumn("shard", F.expr(f"pmod(xxhash64(anchor), {shards})")).select("doc_id", "tag", "first", "times", "shard", "snippet")
    edges = dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(lambda batches: marked_strings(batches, length), f"doc_id {kind}, tag long, start long, last long")

    # Hot anchors: their strings of `length` bytes are counted, combined before the shuffle, so one very common string is one row.
    string = lambda k: F.substring(F.col("snippet"), k + 1, F.lit(length))
    strings = F.transform(F.sequence(F.lit(0), F.octet_length("snippet") - length), lambda k: F.struct((F.col("first") + k).cast("long").alias("start"), F.xxhash64(string(k)).alias("h"), F.xxhash64(F.lit(1), string(k)).alias("h2")))
    each = cut(pieces.where("hot").select("doc_id", "tag", "times", F.explode(strings).alias("s")).select("doc_id", "tag", "times", "s.*"))
    common = cut(each.groupBy("h", "h2").agg(F.sum("times").alias("all_times"), F.count("*").alias("n")).where("all_times > 1").select("h", F.col("h2").alias("__h2"), "n"))
    hot_edges = spread_join(each.where("times = 1"), common, "h", "n").where("h2 = __h2").select("doc_id", "tag", "start", F.col("start").alias("last"))

    spans = alike.unionByName(again).unionByName(edges).unionByName(hot_edges).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "last")).alias("strings"))
    judged = tagged.join(spans, tagged["doc_id"].eqNullSafe(spans["doc_id"]) & (tagged["tag"] == spans["tag"]), "left").select(tagged["doc_id"], "text", "strings")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, strings in zip(batch.column(1), batch.column(2)):
                raw = text.as_py().encode()
                begin, stop = merged_spans(strings.values, length) if strings.is_valid else (np.zeros(0, np.int64),) * 2
                left, at = [], 0
                for a, b in zip(begin.tolist(), stop.tolist()):
                    left.append(raw[at:a])
                    at = b
                kept = b"".join([*left, raw[at:]])
                row = [len(raw), int((stop - begin).sum()), len(begin), hashlib.sha256(kept).hexdigest()]
                out.append(row + [[{"begin": int(a), "stop": int(b)} for a, b in zip(begin, stop)], kept] if keep_text else row)
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())])), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=["doc_id", *NAMES[: len(out[0])]])

    more = ", spans array<struct<begin: long, stop: long>>, kept_bytes binary" if keep_text else ""
    return judged.mapInArrow(remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")


NAMES = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_bytes"]


def merged_spans(strings: pa.StructArray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that ranges of string starts (first, last) cover."""
    start, last = np.asarray(strings.field(0)), np.asarray(strings.field(1))
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(last[order] + length)
    new = np.concatenate([[True], start[1:] > stop[:-1]])
    return start[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)]
