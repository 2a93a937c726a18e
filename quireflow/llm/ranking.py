"""Ranked lexical search: WAND over document shards, whole-number scores.

Terms are maximal runs of letters and digits (anything above ASCII counts as such), A-Z lower-cased. N documents hold a term, L terms in all; a term
in df of them weighs w = floor(1000 * ln((2N + 2) / (2df + 1))); a document of n terms has m = 50 + 50 * n * N div L and scores the sum of
w * (10**9 * tf div (1000 * tf + 20 * m)) over the query's different terms.

1. Queries with the same terms are one. They are taken in blocks of BLOCK_BYTES of terms, the most that is ever broadcast; a larger query set
   takes more passes over the documents.
2. One scan of the texts keeps, per document, its length and the block's terms with their counts (hash, then every byte compared). N, L
   and df are sums over these rows.
3. Each task turns its documents into shards of bounded size, each an inverted index with every term's greatest impact. For a query the lists
   are ordered by that bound. Those that cannot reach the heap's threshold together only ever get probed; the others, read window by window, give
   the pivots: documents whose lists' bounds reach the threshold. All pivots of a window are selected at once and scored by skipping ahead in the
   probed lists, the greatest bound first, dropping each document as soon as what remains cannot lift it. The scores of a query's heap are carried
   to the task's next shard, so later shards skip more.
4. Heaps, at most `k` rows a query and shard, are merged by a window whose limit Spark applies before its shuffle.

Null and empty texts hold no term: they count nowhere and items without terms have no rows. Equal scores are ranked by ascending doc_id, null last;
repeated documents are ranked each. Each row of the items is an item, repeated or not. Very long texts are scanned whole. Empty tables give
none. Other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireflow.llm.common import NOT_ALNUM, blocks, cut, prefix_sums, slice_hash, spread_join, word_spans, word_table

TOP, BLOCK_BYTES = 50, 4 << 20
SHARD_POSTINGS, SHARD_TEXTS, FIRST_WINDOW = 1 << 20, 1 << 14, 256
TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORDS = word_table(True, NOT_ALNUM)


def queries_of(items: DataFrame) -> DataFrame:
    """item_id and key, the item's different terms in order with blanks between, of items with any."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return items.select("item_id", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(lower, F.lit(TERMS), F.lit(0)))), " ").alias("key")).where("key != ''")


class Vocabulary:
    """Terms with their numbers; finds them among the words of a block of texts."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(t) for t in raw])
        hashes = slice_hash(prefix_sums(data), ends - [len(t) for t in raw], ends)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.data, self.begin, self.size = hashes[self.order], data, ends - [len(t) for t in raw], np.array([len(t) for t in raw])

    def numbers(self, kept: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The term's number for each word, -1 for others."""
        hashes = slice_hash(prefix_sums(kept), begin, end)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        term = self.order[at]
        like = np.flatnonzero((self.hashes[at] == hashes) & (self.size[term] == end - begin))
        out = np.full(len(begin), -1)
        if not len(like):
            return out
        size = self.size[term[like]]
        first = np.cumsum(size) - size
        along = np.arange(int(size.sum())) - np.repeat(first, size)
        same = kept[np.repeat(begin[like], size) + along] == self.data[np.repeat(self.begin[term[like]], size) + along]
        equal = like[np.logical_and.reduceat(same, first)]
        out[equal] = term[equal]
        return out


def term_counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n (all terms), terms and counts (of the vocabulary) of every document with a term."""
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(terms))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        for rows, data, starts in blocks(batches, "text"):
            kept = _WORDS[data]
            begin, end, first = word_spans(kept, starts)
            term = vocabulary.numbers(kept, begin, end) if len(begin) else np.zeros(0, np.int64)
            known = np.flatnonzero(term >= 0)
            owner = np.searchsorted(first, known, "right") - 1
            pair, count = np.unique(owner * len(terms) + term[known], return_counts=True)
            length = np.diff(first)
            lists = pa.array(np.searchsorted(pair, np.arange(rows.num_rows + 1) * len(terms)), pa.int32())
            out = pa.RecordBatch.from_arrays([rows.column(0), pa.array(length), pa.ListArray.from_arrays(lists, pa.array((pair % len(terms)).astype(np.int32))), pa.ListArray.from_arrays(lists, pa.array(count))], names=["doc_id", "n", "terms", "counts"])
            yield out.filter(pa.array(length > 0))

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n long, terms array<int>, counts array<long>")


def weights(counted: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and each term's weight; what reaches the driver is bounded by the vocabulary of a block of queries."""
    n, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = np.zeros(n_terms, np.int64)
    for term, held in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weight[term] = math.floor(1000 * math.log((2 * n + 2) / (2 * held + 1)))
    return n, total, weight


class Shard:
    """An inverted index over some documents: per term ascending places, impacts and the greatest impact."""

    def __init__(self, rows: pa.Table, n: int, total: int, weight: np.ndarray):
        rows = rows.take(pc.sort_indices(rows.column("doc_id"), null_placement="at_end"))
        self.ids = rows.column("doc_id").combine_chunks()
        length = rows.column("n").to_numpy()
        lists = rows.column("terms").combine_chunks()
        term, count = np.asarray(lists.flatten()), np.asarray(rows.column("counts").combine_chunks().flatten())
        exact = length if int(length.max()) * n * 50 < 1 << 62 else length.astype(object)
        m = (50 + (50 * exact * n) // total).astype(np.int64)
        place = np.repeat(np.arange(len(length)), np.asarray(pc.list_value_length(lists)))
        impact = weight[term] * ((1_000_000_000 * count) // (1000 * count + 20 * m[place]))
        order = np.argsort(term, kind="stable")
        term, self.place, self.impact = term[order], place[order], impact[order]
        present, first = np.unique(term, return_index=True)
        stop = np.append(first[1:], len(term))
        most = np.maximum.reduceat(self.impact, first) if len(first) else first
        self.lists = {t: (a, b, m) for t, a, b, m in zip(present.tolist(), first.tolist(), stop.tolist(), most.tolist()) if m > 0}

    def search(self, terms: list[int], k: int, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the best k documents, those below the k-th of `seen` (scores of other shards) left out."""
        lists = sorted((m, a, b) for m, a, b in ((m, a, b) for a, b, m in (self.lists[t] for t in terms if t in self.lists)))
        bounds = np.cumsum([m for m, _, _ in lists])
        lists = [(m, self.place[a:b], self.impact[a:b]) for m, a, b in lists]
        best, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, width = 0, FIRST_WINDOW
        while lists and low < len(self.ids):
            high = min(low + width, len(self.ids))
            every = np.concatenate([best, seen])
            least = max(1, int(np.partition(every, -k)[-k])) if len(every) >= k else 1  # the heap's threshold
            probed = int(np.searchsorted(bounds, least))  # these lists together stay below it
            if probed == len(lists):
                break
            reach, score = np.zeros(high - low, np.int64), np.zeros(high - low, np.int64)
            for m, places, impacts in lists[probed:]:
                a, b = np.searchsorted(places, (low, high))
                reach[places[a:b] - low] += m
                score[places[a:b] - low] += impacts[a:b]
            spare = int(bounds[probed - 1]) if probed else 0
            pivots = np.flatnonzero((reach > 0) & (reach + spare >= least))
            score = score[pivots]
            pivots += low
            for j in range(probed - 1, -1, -1):
                able = score + bounds[j] >= least
                pivots, score = pivots[able], score[able]
                if not len(pivots):
                    break
                _, places, impacts = lists[j]
                to = np.minimum(np.searchsorted(places, pivots), len(places) - 1)
                score = score + np.where(places[to] == pivots, impacts[to], 0)
            able = score >= least
            best, at = np.concatenate([best, score[able]]), np.concatenate([at, pivots[able]])
            if len(best) > k:
                keep = np.lexsort((at, -best))[:k]
                best, at = best[keep], at[keep]
            low, width = high, 2 * width
        return at, best


def shards(batches: Iterator[pa.RecordBatch], n: int, total: int, weight: np.ndarray) -> Iterator[Shard]:
    """A task's documents as indexes of bounded size (one more document at most)."""
    held, postings, texts = [], 0, 0
    for batch in batches:
        sizes = np.cumsum(np.asarray(pc.list_value_length(batch.column(2))))
        first = 0
        while first < batch.num_rows:
            before = int(sizes[first - 1]) if first else 0
            last = min(batch.num_rows, first + SHARD_TEXTS - texts, max(first + 1, int(np.searchsorted(sizes, before + SHARD_POSTINGS - postings, "right"))))
            held.append(batch.slice(first, last - first))
            postings, texts, first = postings + int(sizes[last - 1]) - before, texts + last - first, last
            if postings >= SHARD_POSTINGS or texts >= SHARD_TEXTS or first < batch.num_rows:
                yield Shard(pa.Table.from_batches(held), n, total, weight)
                held, postings, texts = [], 0, 0
    if held:
        yield Shard(pa.Table.from_batches(held), n, total, weight)


def _found(docs: DataFrame, block: list[tuple[int, list[str]]], k: int) -> DataFrame:
    """query, doc_id, score: every shard's heaps for a block of queries."""
    terms = sorted({t for _, q in block for t in q})
    number = {t: i for i, t in enumerate(terms)}
    counted = cut(term_counts(docs, terms))
    n, total, weight = weights(counted, len(terms))
    sent = docs.sparkSession.sparkContext.broadcast((weight, [(query, [number[t] for t in q]) for query, q in block]))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, wanted = sent.value
        seen = [np.zeros(0, np.int64)] * len(wanted)
        for shard in shards(batches, n, total, weight):
            query, place, score = [], [], []
            for j, (number, terms) in enumerate(wanted):
                at, best = shard.search(terms, k, seen[j])
                seen[j] = -np.sort(-np.concatenate([seen[j], best]))[:k]
                keep = best >= seen[j][-1] if len(seen[j]) == k else best > 0
                query.append(np.full(int(keep.sum()), number))
                place.append(at[keep])
                score.append(best[keep])
            query, place, score = (np.concatenate(x).astype(np.int64) for x in (query, place, score))
            yield pa.RecordBatch.from_arrays([pa.array(query), shard.ids.take(pa.array(place)), pa.array(score)], names=["query", "doc_id", "score"])

    return counted.mapInArrow(run, f"query long, doc_id {kind}, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents (see the module's text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = cut(queries_of(items))
    queries = cut(asked.groupBy("key").agg(F.count("*").alias("n_items")).withColumn("query", F.monotonically_increasing_id()))
    volume = queries.agg(F.sum(F.octet_length("key"))).first()[0] or 0
    n_blocks = -(-volume // block_bytes)
    found = docs.sparkSession.createDataFrame([], f"query long, doc_id {kind}, score long")
    for b in range(n_blocks):
        block = queries.where(F.expr(f"pmod(xxhash64(query), {n_blocks}) = {b}")).select("query", "key").collect()  # about block_bytes
        if block:
            found = found.unionByName(_found(docs, [(r["query"], r["key"].split(" ")) for r in block], k))
    along = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(along)).where(F.col("rank") <= k)
    tops = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("top"))  # k of them
    tops = cut(tops.join(queries, "query").select("key", "n_items", "top"))
    return spread_join(asked, tops, "key", "n_items").select("item_id", F.explode("top").alias("t")).select("item_id", "t.rank", "t.doc_id", "t.score")
