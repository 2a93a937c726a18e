"""Substring dedup with repeated-phrase automata: removes every word that lies in `window` consecutive words (50) which also start in a document of smaller id.

1. Anchors. Of the GRAM-word hashes inside each window the least one (leftmost of equals) is its anchor, so equal windows have equal anchors at
   equal places. Consecutive windows with one anchor are a run; its words are its piece. One scan of all texts gives the runs, without words.
2. Only anchors that documents of different ids share can matter. Equal pieces are one from here on, with the smallest and the
   largest id and the number of their documents; their words are cut from one document each and dealt by anchor to shards of bounded size.
3. A shard task confirms the recurring windows word by word: those that documents of different ids hold. Windows that stand in the same
   pieces always stand together and are one phrase. The phrases are compiled into an Aho-Corasick automaton over the shard's word
   numbers and all pieces are streamed through it, which locates every occurrence.
4. Occurrences go back to every document that holds the piece, those of a larger id than the phrase's first document lose the words.

An anchor with more than HOT_PIECES different pieces, which no one task may gather, has its windows counted by their words (combined before the
shuffle) instead of in a task; the windows that recur are dealt by their own words and go through automata like the others.

Words are runs of anything but ASCII blanks, unchanged; windows never cross documents and are judged on the input. Null texts have no words.
Texts below `window` words never change. Rows without doc_id are neither smaller nor larger than others: they lose nothing and make nobody lose.
Rows of equal id do not count against each other. Ties between anchors go to the leftmost. Very long texts are scanned whole. Empty tables
give none. Input columns other than doc_id and text take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import SPACES, blocks, cut, prefix_sums, slice_hash, spread_join, word_spans, word_table
from quireflow.llm.suffix_dedup import merged_spans, runs_of

WINDOW, GRAM, SHARD_WORDS, HOT_PIECES = 50, 12, 1 << 18, 4096
_WORDS = word_table(False, SPACES)


def word_runs(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, tag, anchor, piece (a hash), first, count: the runs of windows of all documents."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, starts in blocks(batches, "text"):
            kept = _WORDS[data]
            begin, end, first = word_spans(kept, starts)
            owner, anchor, piece, start, count, _ = runs_of(slice_hash(prefix_sums(kept), begin, end), first, window, gram)
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(2).take(at), pa.array(anchor), pa.array(piece), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))], names=["doc_id", "tag", "anchor", "piece", "first", "count"])

    return docs.where("doc_id is not null").mapInArrow(scan, f"doc_id {kind}, tag long, anchor long, piece long, first int, count int")


def piece_words(docs: DataFrame, pieces: DataFrame, window: int) -> DataFrame:
    """anchor, piece, n, lo, hi, at, words: of each piece, cut from its document; of each single window of a hot one."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = pieces.select("one.doc_id", "one.tag", F.struct("anchor", "piece", "n", "lo", "hi", "hot", "one.first", "one.count").alias("run")).groupBy("doc_id", "tag").agg(F.collect_list("run").alias("runs"))  # of one document
    texts = docs.join(asked, ["doc_id", "tag"]).select("text", "runs", "doc_id", "tag").dropDuplicates(["doc_id", "tag"])

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words, runs = batch.column(0)[row].as_py().encode().split(), batch.column(1)[row].values
                hot, first, count = (np.asarray(runs.field(k)) for k in (5, 6, 7))
                take, at, out = [], [], []
                for k in range(len(first)):
                    ends = [(j, j + window) for j in range(count[k])] if hot[k] else [(0, count[k] + window - 1)]
                    take += [k] * len(ends)
                    at += [a for a, _ in ends]
                    out += [b" ".join(words[first[k] + a : first[k] + b]) for a, b in ends]
                yield pa.RecordBatch.from_arrays([*(runs.field(k).take(pa.array(take)) for k in range(6)), pa.array(at, pa.int32()), pa.array(out, pa.binary())], names=["anchor", "piece", "n", "lo", "hi", "hot", "at", "words"])

    return texts.select("text", "runs").mapInArrow(cut_out, f"anchor long, piece long, n long, lo {kind}, hi {kind}, hot boolean, at int, words binary")


def confirmed(pieces: list[np.ndarray], lo: list, hi: list, window: int) -> dict[bytes, tuple[int, int, object]]:
    """(windows in it, number, smallest id) of every phrase that recurs, by the bytes of its word numbers."""
    owners: dict[bytes, list[int]] = {}
    spelled = [p.tobytes() for p in pieces]
    width = window * 4
    for k, text in enumerate(spelled):
        for a in range(0, len(text) - width + 1, 4):
            owners.setdefault(text[a : a + width], []).append(k)
    groups: dict[tuple[int, ...], int] = {}
    group_of: dict[bytes, int] = {}
    least: list = []
    for text, held in owners.items():
        first = min(lo[k] for k in held)
        if first < max(hi[k] for k in held):
            group_of[text] = groups.setdefault(tuple(held), len(groups))
            if len(groups) > len(least):
                least.append(first)
    out: dict[bytes, tuple[int, int, object]] = {}
    for text in spelled:
        at, stop = 0, len(text) - width + 1
        while at < stop:
            group = group_of.get(text[at : at + width])
            end = at + 4
            while group is not None and end < stop and group_of.get(text[end : end + width]) == group:
                end += 4
            if group is not None:
                out.setdefault(text[at : end - 4 + width], ((end - at) // 4, len(out), least[group]))
            at = end
    return out


def located(texts: list[bytes], lo: list, hi: list, window: int) -> Iterator[tuple[int, list[tuple[int, int, object]]]]:
    """(piece, its occurrences of phrases: first window, windows, smallest id) of every piece that holds any."""
    numbers: dict[bytes, int] = {}
    pieces = [np.array([numbers.setdefault(w, len(numbers)) for w in t.split(b" ")], np.int32) for t in texts]
    phrases = confirmed(pieces, lo, hi, window)
    if not phrases:
        return
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for text, (count, _, first) in phrases.items():
        automaton.add_word(tuple(np.frombuffer(text, np.int32).tolist()), (count, first))
    automaton.make_automaton()
    for k, piece in enumerate(pieces):
        found = [(end - count - window + 2, count, first) for end, (count, first) in automaton.iter(tuple(piece.tolist()))]
        if found:
            yield k, found


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one shard after the other, from batches in order of their column `shard`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shard = np.asarray(batch.column(batch.schema.get_field_index("shard")))
        edges = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)] if len(shard) else []
        for a, b in zip(edges, edges[1:]):
            if held and held[-1].column("shard")[0].as_py() != shard[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def occurrences(pieces: DataFrame, shards: int, window: int) -> DataFrame:
    """anchor, piece, n, found (array of at, count, lo) of every piece that holds a recurring phrase."""
    kind = pieces.schema["lo"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_shard(batches):
            held = list(located(*(rows.column(c).to_pylist() for c in ("words", "lo", "hi")), window))
            if held:
                at, count, lo = zip(*(f for _, found in held for f in found))
                ends = np.concatenate([[0], np.cumsum([len(found) for _, found in held])])
                found = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(count, pa.int32()), pa.array(lo, rows.schema.field("lo").type)], names=["at", "count", "lo"])
                take = pa.array([k for k, _ in held])
                yield pa.RecordBatch.from_arrays([*(rows.column(c).take(take).combine_chunks() for c in ("anchor", "piece", "n")), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)], names=["anchor", "piece", "n", "found"])

    dealt = pieces.withColumn("shard", F.expr(f"pmod(xxhash64(anchor), {shards})")).select("shard", "anchor", "piece", "n", "lo", "hi", "words")
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, f"anchor long, piece long, n long, found array<struct<at: int, count: int, lo: {kind}>>")


def remove_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep_text: bool = False, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document; with keep_text also spans (of words) and the words that are left."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    tagged = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text"))
    runs = cut(word_runs(tagged, window, gram))
    anchors = runs.groupBy("anchor").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor", "n")
    shared = cut(spread_join(runs, cut(anchors), "anchor", "n").drop("n"))
    pieces = cut(shared.groupBy("anchor", "piece").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min(F.struct("doc_id", "tag", "first", "count")).alias("one")))
    hot = cut(pieces.groupBy("anchor").agg(F.count("*").alias("different")).where(F.col("different") > hot_pieces).select("anchor", F.lit(True).alias("hot")))
    words = pieces.agg(F.sum(F.col("one.count") + window - 1)).first()[0] or 0
    shards = max(1, -(-words // SHARD_WORDS))
    texts = cut(piece_words(tagged, pieces.join(hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False))), window))
    found = occurrences(texts.where("not hot"), shards, window)

    # Single windows of hot anchors: counted by their words, named by two hashes of them, back to the pieces that hold them.
    name = [F.xxhash64("words").alias("anchor"), F.xxhash64(F.lit(1), "words").alias("piece")]
    single = texts.where("hot")
    windows = single.groupBy("words").agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select(*name, "n", "lo", "hi", "words")
    recurring = cut(occurrences(windows, shards, window).select(F.struct("anchor", "piece").alias("pair"), F.col("n").alias("times"), F.col("found")[0]["lo"].alias("least")))
    placed = spread_join(single.select("anchor", "piece", "n", "at", F.struct(*name).alias("pair")), recurring, "pair", "times")
    placed = placed.groupBy("anchor", "piece", "n").agg(F.collect_list(F.struct("at", F.lit(1).alias("count"), F.col("least").alias("lo"))).alias("found"))  # at most a run's windows

    found = cut(found.unionByName(placed).select(F.struct("anchor", "piece").alias("pair"), "n", "found"))
    held = spread_join(shared.select("doc_id", "tag", "first", F.struct("anchor", "piece").alias("pair")), found, "pair", "n")
    spans = held.select("doc_id", "tag", "first", F.explode("found").alias("f")).where("f.lo < doc_id").select("doc_id", "tag", F.struct((F.col("first") + F.col("f.at")).cast("long").alias("start"), (F.col("first") + F.col("f.at") + F.col("f.count") - 1).cast("long").alias("last")).alias("s"))
    spans = spans.groupBy("doc_id", "tag").agg(F.collect_set("s").alias("strings"))  # of one document, repeated rows once
    judged = tagged.join(spans, ["doc_id", "tag"], "left").select("doc_id", "text", "strings")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, strings in zip(batch.column(1), batch.column(2)):
                words = text.as_py().encode().split()
                begin, stop = merged_spans(strings.values, window) if strings.is_valid else (np.zeros(0, np.int64),) * 2
                left, at = [], 0
                for a, b in zip(begin.tolist(), stop.tolist()):
                    left += words[at:a]
                    at = b
                kept = b" ".join(left + words[at:])
                row = [len(words), int((stop - begin).sum()), hashlib.sha256(kept).hexdigest()]
                out.append(row + [[{"begin": int(a), "stop": int(b)} for a, b in zip(begin, stop)], kept.decode()] if keep_text else row)
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())])), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=["doc_id", *NAMES[: len(out[0])]])

    more = ", spans array<struct<begin: long, stop: long>>, kept string" if keep_text else ""
    return judged.mapInArrow(remove, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string{more}")


NAMES = ["n_words", "n_removed", "kept_sha256", "spans", "kept"]
