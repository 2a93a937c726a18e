"""Queries op1 to op13 and the pipeline, with their DuckDB statements where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm import chat, ctw, decontaminate, embedding, mixing, oracles, phrases, ranking, sharding, simhash, suffix_dedup, toxicity, warc, whitening
from quireflow.llm.common import table


def op1_embedding_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_texts(table(spark, sf_dir, "documents"), "crc32(encode(cast(doc_id as string), 'UTF-8')) % 7 = 2")


def op4_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = "crc32(encode(cast(doc_id as string), 'UTF-8')) % 5 = 0"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    done = toxicity.classify(docs, table(spark, sf_dir, "labels"), held_out, carry_text=False)
    score = F.col("toxicity")
    return done.select("doc_id", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "threshold", F.col("toxic").alias("rejected"))


def op7_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op8_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op9_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_plan(table(spark, sf_dir, "documents"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), carry_text=False)


def op11_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_passages(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def oracle_sql() -> dict[str, str]:
    """Fingerprints (XXH64), CRC32, eigenvectors, trained models and the pipeline are beyond DuckDB's SQL."""
    return {"op1_embedding_caps": oracles.OP1, "op2_suffix_dedup": oracles.OP2, "op5_warc_round_trip": oracles.OP5, "op7_chat_collapse": oracles.OP7, "op8_water_filling": oracles.OP8, "op10_winnowing": oracles.OP10, "op11_wand": oracles.OP11, "op12_phrase_automata": oracles.OP12}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_caps, op2_suffix_dedup, op3_ctw_score, op4_simhash_pigeonring, op5_warc_round_trip, op6_toxicity_cnn, op7_chat_collapse, op8_water_filling, op9_karmarkar_karp, op10_winnowing, op11_wand, op12_phrase_automata, op13_whitening, pipeline)}
