"""The dictionary that decides about line-end hyphens: one word per line, given as a path or a column of words."""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A dictionary is sent to every task, so its size is checked; larger ones are refused.
MAX_WORDS = 2_000_000


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """word: the distinct stripped, lower-cased lines of the file."""
    word = F.lower(F.trim("value"))
    return spark.read.text(path).select(word.alias("word")).where("word <> ''").distinct()


def dictionary(words: DataFrame | None, spark: SparkSession) -> Broadcast:
    """Set of words for join_lines; without words every hyphen stays, which is the safe choice."""
    rows = words.select("word").distinct().limit(MAX_WORDS + 1).toPandas()["word"] if words is not None else []
    if len(rows) > MAX_WORDS:
        raise ValueError(f"a dictionary may hold {MAX_WORDS} words at most")
    return spark.sparkContext.broadcast(frozenset(rows))
