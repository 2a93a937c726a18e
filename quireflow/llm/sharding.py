"""Sharding by Karmarkar-Karp differencing: near-equal bytes per shard, groups of equal texts undivided.

Sizes are UTF-8 bytes plus 16. Differencing merges, again and again, the two partial partitions of largest spread,
the one's heaviest part with the other's lightest. A merged partition is itself a tuple of part sums, so the work nests: hash buckets
of at most a few thousand groups are differenced one by one (one task each), then their tuples are differenced 256 at a
time, level by level, until one is left; small joins carry the parts back to the groups. No task sees more than one
bucket. Equal rows are one row with a count until the end, and a text with very many different ids is spread over tasks where it
meets its shard. Slots are running counts inside (shard, hash bucket) plus the bucket's offset, so no task numbers a whole shard.

Null texts have size 16 and are a group with empty texts. Repeated rows take their group's shard. Ties between sums go by
position, of slots by hash. Very long texts are one size like any other. Empty tables give none. Input columns named
like a result column are replaced.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.llm.common import cut, spread_join

SHARDS, OVERHEAD = 40, 16
BUCKET_GROUPS, FAN_IN, SLOT_ROWS = 4096, 256, 4096
COPY_BLOCK = 4096  # equal rows are written out in such blocks, which are dealt to all tasks


def difference(tuples: np.ndarray) -> np.ndarray:
    """Part for each slot of each tuple (rows: part sums of one partial partition) after Karmarkar-Karp differencing."""
    n, k = tuples.shape
    order = np.argsort(tuples, axis=1, kind="stable")
    nodes: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    sums = list(np.take_along_axis(tuples, order, 1))
    heap = [(-int(s[-1] - s[0]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        total = sums[a] + sums[b][::-1]  # heaviest with lightest
        by = np.argsort(total, kind="stable")
        nodes.append((a, b, by, k - 1 - by))
        sums.append(total[by])
        sums[a] = sums[b] = None
        heapq.heappush(heap, (-int(sums[-1][-1] - sums[-1][0]), len(sums) - 1))
    parts = [None] * len(sums)
    parts[-1] = np.arange(k)
    for i in range(len(nodes) - 1, -1, -1):
        a, b, from_a, from_b = nodes[i]
        parts[a], parts[b] = np.empty(k, np.int64), np.empty(k, np.int64)
        parts[a][from_a] = parts[b][from_b] = parts[n + i]
    out = np.empty((n, k), np.int64)
    for i in range(n):
        out[i, order[i]] = parts[i]
    return out


def balance(groups: DataFrame, shards: int) -> DataFrame:
    """digest, bytes, n (rows of the group) -> digest, n, shard."""

    def first_level(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("digest", ignore_index=True)
        tuples = np.zeros((len(pdf), shards), np.int64)
        tuples[:, 0] = pdf["bytes"]
        return pdf.assign(part=difference(tuples)[:, 0].astype(np.int32))

    def next_level(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, row = np.unique(pdf["node"], return_inverse=True)
        tuples = np.zeros((len(ids), shards), np.int64)
        tuples[row, pdf["part"]] = pdf["bytes"]
        up = difference(tuples)
        return pd.DataFrame({"node": np.repeat(ids, shards), "part": np.tile(np.arange(shards, dtype=np.int32), len(ids)), "up": pdf["up"].iloc[0], "up_part": up.ravel().astype(np.int32), "bytes": tuples.ravel()})

    n = max(1, -(-groups.count() // BUCKET_GROUPS))
    placed = cut(groups.withColumn("bucket", F.expr(f"pmod(xxhash64(digest), {n})")).groupBy("bucket").applyInPandas(first_level, "digest string, bytes long, n long, bucket long, part int"))
    level = placed.groupBy(F.col("bucket").alias("node"), "part").agg(F.sum("bytes").alias("bytes"))
    route = None
    while True:
        m = -(-n // FAN_IN)
        merged = cut(level.withColumn("up", F.expr(f"pmod(xxhash64(node), {m})")).groupBy("up").applyInPandas(next_level, "node long, part int, up long, up_part int, bytes long"))
        step = merged.select("node", "part", "up", "up_part")
        if route is None:
            route = step.select(F.col("node").alias("bucket"), "part", F.col("up").alias("at"), F.col("up_part").alias("at_part"))
        else:
            route = route.join(step.withColumnsRenamed({"node": "at", "part": "at_part", "up": "at2", "up_part": "at_part2"}), ["at", "at_part"]).select("bucket", "part", F.col("at2").alias("at"), F.col("at_part2").alias("at_part"))
        if m == 1:
            break
        level, n = merged.groupBy(F.col("up").alias("node"), F.col("up_part").alias("part")).agg(F.sum("bytes").alias("bytes")), m
    return placed.join(route, ["bucket", "part"]).select("digest", "n", F.col("at_part").alias("shard"))


def shard_plan(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) of every document."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    sized = docs.select("doc_id", (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.sha2(raw, 256).alias("digest"))
    rows = cut(sized.groupBy("doc_id", "size", "text_crc32", "digest").agg(F.count("*").alias("copies")))
    where = balance(rows.groupBy("digest").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.count("*").alias("n")), shards)
    total, most = rows.agg(F.count("*"), F.max("copies")).first()
    lane = F.expr(f"pmod(xxhash64(doc_id, text_crc32), {max(1, -(-total // (shards * SLOT_ROWS)))})")
    placed = cut(spread_join(rows, where, "digest", "n").select("doc_id", "size", "text_crc32", "copies", "shard", lane.alias("lane")))

    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lanes = placed.groupBy("shard", "lane").agg(F.sum("copies").alias("in_lane"))
    lanes = lanes.select("shard", "lane", before(Window.partitionBy("shard").orderBy("lane"), "in_lane").alias("offset"))
    own = before(Window.partitionBy("shard", "lane").orderBy("doc_id", "text_crc32", "size"), "copies")
    first = placed.withColumn("own", own).join(lanes, ["shard", "lane"]).withColumn("first", F.col("offset") + F.col("own"))

    def out(some: DataFrame, slots: Column) -> DataFrame:
        return some.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.explode(slots).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

    each = out(first.where(F.col("copies") <= COPY_BLOCK), F.sequence("first", F.col("first") + F.col("copies") - 1))
    if (most or 0) <= COPY_BLOCK:
        return each
    dealt = first.where(F.col("copies") > COPY_BLOCK).withColumn("end", F.col("first") + F.col("copies") - 1)
    dealt = dealt.withColumn("start", F.explode(F.sequence("first", "end", F.lit(COPY_BLOCK).cast("long")))).repartition("start", "shard")
    return each.unionByName(out(dealt, F.sequence("start", F.least(F.col("start") + COPY_BLOCK - 1, F.col("end")))))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The whole documents as Parquet, one folder per shard."""
    kept = docs.drop("shard")
    plan = shard_plan(docs, shards).select(F.col("doc_id").alias("__id"), F.col("text_crc32").alias("__crc"), "shard").distinct()
    crc = F.crc32(F.encode(F.coalesce(kept["text"], F.lit("")), "UTF-8"))
    rows = kept.withColumn("__key", crc).join(plan, F.expr("doc_id <=> __id and __key = __crc"))
    rows.select(*kept.columns, "shard").write.partitionBy("shard").parquet(path)
