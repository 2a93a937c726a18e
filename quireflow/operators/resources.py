"""Memory-aware plans for recognition work: schedule, resolution, workers, as expressions over a profile row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the memory model.
MAX_PIXELS, MIN_DPI, LOW_DPI = 60_000_000, 72, 200
WORKER_MB, MB_PER_MPIXEL, JOB_MB, HEADROOM, MIN_FREE_MB = 100, 14, 130, 0.75, 1500


def worker_mb(width: Column, height: Column, dpi: Column) -> Column:
    """Peak memory of one worker at a page of this size (points)."""
    return WORKER_MB + MB_PER_MPIXEL * F.least(width / 72 * dpi * height / 72 * dpi, F.lit(float(MAX_PIXELS))) / 1e6


def capped_dpi(width: Column, height: Column, dpi: Column) -> Column:
    """The resolution at which a page stays within the pixel limit, 72 at least."""
    pixels = (width / 72 * dpi) * (height / 72 * dpi)
    return F.when(pixels > MAX_PIXELS, F.greatest(F.lit(MIN_DPI), (dpi * F.sqrt(MAX_PIXELS / pixels)).cast("int"))).otherwise(dpi)


def schedule(free_mb: Column, forced: Column, threshold: int = MIN_FREE_MB) -> Column:
    """'concurrent' only with enough known free memory."""
    return F.when(~forced & (free_mb >= threshold), "concurrent").otherwise("sequential")


def schedule_reason(free_mb: Column, forced: Column, threshold: int = MIN_FREE_MB) -> Column:
    """Why; fixed wordings."""
    rest = F.concat(F.format_number(free_mb, 0), F.lit(f" MB free (threshold {threshold:,} MB)"))
    return F.when(forced, "forced by setting").when(free_mb.isNull(), "free memory could not be read").when(free_mb >= threshold, rest).otherwise(F.concat(F.lit("only "), rest))


def plan(profiles: DataFrame, dpi: int = 300, make_pdf: bool = True, threshold: int = MIN_FREE_MB) -> DataFrame:
    """profiles(largest struct<width, height>, free_mb, cpus, forced, ...) with schedule, reason, dpi, ocr_workers, jobs, est_peak_mb."""
    free, cpus, forced = F.col("free_mb"), F.col("cpus"), F.col("forced")
    w, h = F.col("largest.width"), F.col("largest.height")
    rows = profiles.withColumn("schedule", schedule(free, forced, threshold)).withColumn("reason", schedule_reason(free, forced, threshold))
    both = F.col("schedule") == "concurrent"
    half = F.greatest(F.lit(1), F.floor(cpus / 2))
    rows = rows.withColumn("budget", free * HEADROOM / F.when(both, 2).otherwise(1)).withColumn("per", worker_mb(w, h, F.lit(dpi)))
    low = (F.col("per") > F.col("budget")) & F.lit(dpi > LOW_DPI)
    rows = rows.withColumn("dpi", F.when(low, LOW_DPI).otherwise(dpi)).withColumn("per", F.when(low, worker_mb(w, h, F.lit(LOW_DPI))).otherwise(F.col("per")))
    fits = lambda most, mb: F.when(free.isNull(), most).otherwise(F.greatest(F.lit(1), F.least(most, F.floor(mb / F.col("per")))))
    rows = rows.withColumn("ocr_workers", fits(F.when(both, F.greatest(F.lit(1), cpus - half)).otherwise(cpus), F.col("budget")).cast("int"))
    rows = rows.withColumn("jobs", fits(F.when(both, half).otherwise(cpus), F.col("budget") - JOB_MB).cast("int"))
    ocr = F.col("ocr_workers") * F.col("per")
    pdf = (JOB_MB + F.col("jobs") * F.col("per")) if make_pdf else F.lit(0.0)
    return rows.withColumn("est_peak_mb", F.when(both, ocr + pdf).otherwise(F.greatest(ocr, pdf)).cast("int")).drop("budget", "per")


def preflight() -> Column:
    """One line that states a planned document's figures, in a fixed format."""
    free = F.coalesce(F.format_number("free_mb", 0), F.lit("unknown"))
    return F.format_string(
        "file=%s size=%.1fMB pages=%d fonts=%s text_chars=%d pages_without_text=%d hidden_text_layer=%s image_only=%s | dpi=%d schedule=%s ocr_workers=%d ocrmypdf_jobs=%d ocrmypdf_modes=%s est_peak=%dMB free=%sMB",
        F.col("name"), F.col("length") / (1 << 20), F.col("pages"), F.initcap(F.col("has_fonts").cast("string")), F.col("text_chars"), F.col("pages_without_text"), F.initcap(F.col("hidden_text_layer").cast("string")), F.initcap(F.col("image_only").cast("string")),
        F.col("dpi"), F.col("schedule"), F.col("ocr_workers"), F.col("jobs"), F.array_join("modes", ","), F.col("est_peak_mb"), free,
    )
