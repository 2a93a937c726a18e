"""Mixing sources to target weights by capped water-filling, with DataFrame operations only.

A document's size is its number of words [^\\x20\\x09-\\x0D]+. Sources in code point order, null last, weigh 1, 2, 3, 1, ...
and share all words by weight; no source's target passes `epochs` (3) times its size, and what it leaves is shared among
the others by weight until none is above. In order of cap per weight the capped sources are a prefix, so two running sums
over the (small) table of sources replace the rounds; all comparisons are between integers.

Sampling: each document is taken floor(target / source size) times; of the fractional repetition, documents in the order
of a seeded hash are taken while at least half of one still fits, so that a source misses its target by half a document
at most. Running sums are built from 4,096 hash buckets per source (sums combine before the shuffle), then inside
each bucket, so a source with a third of all rows is spread over all tasks.

Null texts have size 0. Very long texts are taken whole or not at all. Rows that agree in doc_id, source and size are one place in the order; where
only some of them still fit, that many are taken once more (of different texts those of least hash). Ties between keys go by doc_id and size. Empty
tables give empty results. Input columns named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
EPOCHS, SEED = 3, "mix-1"
BLOCK = 4096  # equal rows that one row of the plan stands for at most


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target: one row per source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = per.withColumn("weight", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("long"))
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    levels = ranked.select("*", total.alias("total"), F.coalesce(F.sum(epochs * F.col("source_size")).over(before), F.lit(0)).alias("caps_before"), F.sum("weight").over(onward).alias("weights_onward"))
    capped = F.col("capped")
    levels = levels.withColumn("capped", epochs * F.col("source_size") * F.col("weights_onward") <= (F.col("total") - F.col("caps_before")) * F.col("weight"))
    rest = F.col("total") - F.coalesce(F.sum(F.when(capped, epochs * F.col("source_size"))).over(everything), F.lit(0))
    weights = F.sum(F.when(~capped, F.col("weight"))).over(everything)
    target = F.when(capped, (epochs * F.col("source_size")).cast("double")).otherwise((F.col("weight") * rest).cast("double") / weights.cast("double"))
    return levels.select("source", "source_size", target.alias("target"))


def _key(seed: str) -> Column:
    """Place of a row in its source's seeded order."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def _whole() -> Column:
    return F.coalesce(F.floor(F.col("target") / F.expr("nullif(source_size, 0)")), F.lit(0))


def _extra(before: Column, left: Column, copies: Column) -> Column:
    """Of some documents of one size that follow `before` words of their source, how many have their middle within the words that are left."""
    return F.greatest(F.lit(0), F.least(copies, F.floor((2 * left - 2 * before - F.col("size")) / (2 * F.col("size"))) + 1))


def repetitions(docs: DataFrame, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, whole, copies, extra: one row for equal (doc_id, source, size), of which there are `copies`; all
    are taken `whole` times, `extra` of them once more."""
    units = sizes(docs).groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")).withColumn("key", _key(seed)).withColumn("bucket", F.substring("key", 1, 3)).withColumn("words", F.col("size") * F.col("copies"))
    goals = targets(units.select("source", F.col("words").alias("size")), epochs)
    buckets = units.groupBy("source", "bucket").agg(F.sum("words").alias("words"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("source", "bucket", F.coalesce(F.sum("words").over(running), F.lit(0)).alias("bucket_start"))
    starts = starts.alias("s").join(goals.alias("g"), F.expr("s.source <=> g.source")).select("s.source", "s.bucket", "bucket_start", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = units.withColumn("inner_start", F.coalesce(F.sum("words").over(inside), F.lit(0))).alias("u").join(starts.alias("s"), F.expr("u.source <=> s.source and u.bucket = s.bucket"))
    placed = placed.withColumn("whole", _whole()).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    more = F.when((F.col("whole") < epochs) & (F.col("size") > 0), _extra(F.col("bucket_start") + F.col("inner_start"), F.col("left"), F.col("copies"))).otherwise(0)
    return placed.select("u.doc_id", "u.source", "size", "source_size", "target", F.col("whole").cast("long").alias("whole"), "copies", more.cast("long").alias("extra"))


def mix_plan(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per document. Very many equal ones are dealt to tasks in blocks."""
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(BLOCK).cast("long")))
    blocks = repetitions(docs).withColumn("first", first).hint("rebalance")
    nth = F.explode(F.sequence(F.col("first"), F.least(F.col("first") + BLOCK, F.col("copies")) - 1))
    rows = blocks.withColumn("nth", nth)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + (F.col("nth") < F.col("extra")).cast("long"))).alias("taken"))


def mix(docs: DataFrame, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The documents, each as often as the mix takes it; documents without words, which no target counts, stay once.

    Middles ascend along a source's order, so the documents that still fit are those up to one (key, size): the plan shrinks to a row
    per source, and texts are read where they lie, without a shuffle of their own. Only where part of equal (doc_id, source, size) is taken
    once more do these documents, counted as groups of equal rows, go in an order of their own.
    """
    plan = repetitions(docs, epochs, seed).where("size > 0").withColumn("key", _key(seed))
    last = F.max(F.when(F.col("extra") > 0, F.struct("key", "size", "extra", "copies")))
    # Written, so that the join knows its size beforehand: small, as sources mostly are, it goes to the texts and not they to it.
    limits = cut(plan.groupBy("source").agg(F.max("whole").alias("__whole"), last.alias("__last")).select(F.col("source").alias("__source"), "__whole", "__last"))
    parted = limits.where("__last.extra < __last.copies").count() > 0
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.withColumn("__size", size).withColumn("__place", F.struct(_key(seed).alias("key"), F.col("__size").alias("size"))).join(limits, F.expr("source <=> __source"), "left")
    limit = F.struct(F.col("__last.key").alias("key"), F.col("__last.size").alias("size"))
    edge = F.coalesce((F.col("__size") > 0) & (F.col("__place") == limit) & (F.col("__last.extra") < F.col("__last.copies")), F.lit(False))
    inner = rows.where(~edge) if parted else rows
    once_more = F.coalesce(F.col("__last").isNotNull() & (F.col("__place") <= limit), F.lit(False)).cast("long")
    done = inner.withColumn("__reps", F.when(F.col("__size") == 0, 1).otherwise(F.col("__whole") + once_more)).select(*docs.columns, "__reps")
    if parted:
        done = done.unionByName(_edge_rows(rows.where(edge), docs.columns))
    pieces = done.where("__reps > 0").withColumn("__first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__reps"), F.lit(BLOCK).cast("long"))))
    return pieces.withColumn("__nth", F.explode(F.sequence(F.col("__first"), F.least(F.col("__first") + BLOCK - 1, F.col("__reps"))))).select(*docs.columns)


def _edge_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The documents of each source's last place with __reps, how often all equal rows together are taken; `extra` rows, in the order of a hash, are taken once more."""
    equal = rows.groupBy(*columns, "__source", "__whole", "__last").agg(F.count("*").alias("__n")).withColumn("__hash", F.xxhash64(*columns)).withColumn("__bucket", F.pmod("__hash", F.lit(4096)))
    sums = equal.groupBy("__source", "__bucket").agg(F.sum("__n").alias("__n"))
    running = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("__source").alias("__s"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(running), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__source", "__bucket").orderBy("__hash", *columns).rowsBetween(Window.unboundedPreceding, -1)
    placed = equal.withColumn("__inner", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(starts, F.expr("__source <=> __s and __bucket = __b"))
    more = F.greatest(F.lit(0), F.least(F.col("__n"), F.col("__last.extra") - F.col("__start") - F.col("__inner")))
    return placed.select(*columns, (F.col("__whole") * F.col("__n") + more).alias("__reps"))
