"""Outcomes of searchable-PDF attempts: classification of each and a fold over a document's ordered attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Exit codes of the recognition program.
PRIOR_TEXT, FATAL, SUCCESS, OUT_OF_MEMORY = 6, (3, 8, 9), (0, 10), 137
REASONS = {2: "bad input file", 3: "missing program", 4: "invalid output", 6: "text was there before", 8: "encrypted", 9: "invalid settings", 137: "out of memory"}
FAILED, LOG_LINES = "No searchable PDF was made", 6


def classify(attempts: DataFrame) -> DataFrame:
    """attempts(doc_id, attempt_no, mode, rc, text_chars, log) with prior_ocr, killed, retryable, finished."""
    rc = F.col("rc")
    killed = (rc < 0) | (rc == OUT_OF_MEMORY)
    return attempts.withColumn("prior_ocr", (rc == PRIOR_TEXT) | F.contains(F.coalesce("log", F.lit("")), F.lit("PriorOcrFoundError"))).withColumn("killed", killed).withColumn("retryable", ~killed & ~rc.isin(*FATAL)).withColumn("finished", rc.isin(*SUCCESS))


def reason() -> Column:
    """What an exit code says, in brackets; empty where it says nothing."""
    named = F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair))
    text = F.coalesce(F.try_element_at(named, F.col("rc")), F.when(F.col("rc") < 0, "killed"))
    return F.coalesce(F.concat(F.lit(" ("), text, F.lit(")")), F.lit(""))


def log_tail() -> Column:
    """The last lines of an attempt's log."""
    lines = F.filter(F.split(F.coalesce("log", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return F.when(F.size(lines) > 0, F.concat(F.lit(" | "), F.array_join(F.slice(lines, F.greatest(F.size(lines) - LOG_LINES + 1, F.lit(1)), F.lit(LOG_LINES)), " / "))).otherwise("")


def _column(value: bool | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def not_tried(documents: DataFrame, attempts: DataFrame, fallback: bool | Column = False) -> DataFrame:
    """doc_id, outcome, warning, tried of documents without any attempt; fallback: a column of documents, or one answer for all."""
    none = documents.join(attempts.select("doc_id"), "doc_id", "left_anti")
    return none.select("doc_id", F.when(_column(fallback), "original").otherwise("not created").alias("outcome"), F.lit(None).cast("string").alias("warning"), F.lit(0).alias("tried"))


def outcomes(attempts: DataFrame, expect_text: bool | Column = True, fallback: bool | Column = False) -> DataFrame:
    """doc_id, outcome, warning, tried: the first attempt that succeeded; attempts after it or after a fatal one never run.

    expect_text and fallback may be columns of attempts that are equal for a document's rows.
    """
    ok = F.col("finished") & (~_column(expect_text) | (F.col("text_chars") > 0))
    stop = ok | (~F.col("finished") & ~F.col("retryable"))
    problem = F.when(ok, None).when(F.col("finished"), F.concat("mode", F.lit(": ended well but its pages hold no text"))).otherwise(F.concat("mode", F.lit(": exit code "), F.col("rc").cast("string"), reason(), log_tail()))
    rows = classify(attempts).withColumn("ok", ok).withColumn("stop", stop).withColumn("problem", problem).withColumn("original", _column(fallback))
    ordered = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("attempt_no", "mode", "ok", "stop", "problem"))).alias("a"), F.bool_or("original").alias("original"))
    first = F.coalesce(F.nullif(F.array_position(F.transform("a", lambda x: x["stop"]), True), F.lit(0)), F.size("a"))
    done = ordered.withColumn("run", F.slice("a", 1, first.cast("int"))).withColumn("last", F.element_at("run", -1))
    problems = F.array_join(F.filter(F.transform("run", lambda x: x["problem"]), lambda x: x.isNotNull()), "; ")
    lost = F.when(F.col("original"), "original").otherwise("failed")
    instead = F.when(F.col("original"), ". The file as given has a text layer and takes its place.").otherwise("")
    return done.select("doc_id", F.when(F.col("last.ok"), F.col("last.mode")).otherwise(lost).alias("outcome"), F.when(~F.col("last.ok"), F.concat(F.lit(f"{FAILED}: "), problems, instead)).alias("warning"), F.size("run").alias("tried"))
