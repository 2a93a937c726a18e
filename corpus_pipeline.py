"""The corpus pipeline: toxicity filter, near-duplicate removal, decontamination, mixing, sharding, in this order.

Every stage takes any table with doc_id, text and source, further columns of any name (of a result's name too) pass through, and an empty table
gives an empty one with the same columns. Null texts are texts without words: the classifier gives them the score of no words,
no near-duplicate, benchmark passage or target counts them. Rows without doc_id are judged like others. Repeated rows: toxicity and benchmark
passages reject all or none of them, near-duplicate removal keeps one, mixing takes some of them a time more, sharding places each. Ties are decided by the
operators as their own texts state. Very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quireflow.llm import decontaminate, mixing, sharding, simhash, toxicity
from quireflow.llm.common import cut, release, scope, small_batches, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents at or over their language's threshold; trained on the labelled documents of the stage's input. Nothing is rejected without labels of both classes."""
    with small_batches(spark):
        return toxicity.classify(docs, table(spark, sf_dir, "labels")).where("not toxic").select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard similarity of five-word runs 0.8 or more) stays."""
    with small_batches(spark):
        return simhash.deduplicate(docs, shingle=5, similarity=0.8)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold ten consecutive words of a benchmark item."""
    with small_batches(spark):
        return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.shard_plan(docs)


STAGES = [("toxicity", without_toxic), ("simhash", without_copies), ("decontamination", without_benchmark), ("mixing", mixed), ("sharding", sharded)]

#: A trained classifier and fingerprint groups are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; each result is written to the shared folder and read again, its predecessor's removed."""
    source = docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scope() as keep:
            before, docs = docs, keep(cut(stage(spark, docs, sf_dir)))
        if before is not source:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
