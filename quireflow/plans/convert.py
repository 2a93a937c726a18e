"""Files to results: each kind of file takes its branch, the branches meet in one table."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.functions import text as X
from quireflow.operators import attempts, clean, docx, layout, profile, render, resources, structure
from quireflow.plans import markdown
from quireflow.scratch import cut
from quireflow.sources import dealing
from quireflow.sources import files as sources
from quireflow.sources.docx import docx_items

BLANK = "No text was found in the document."
SCANNED = "The Word file holds hardly any text; its Markdown comes from recognition."
NATIVE, MIN_WORD_CHARS = "native (Word)", 20
STATS = "struct<pages:bigint,text_layer:string,ocr_pages:bigint,mean_conf:double,schedule:string,outcome:string,preflight:string,seconds:double>"
ATTEMPTS = "doc_id string, attempt_no int, mode string, rc int, text_chars long, log string"


class Machine(NamedTuple):
    """What the memory plan of a document assumes about the machine that recognises it; free_mb None: unknown."""

    free_mb: float | None = None
    cpus: int = 1
    sequential: bool = False
    dpi: int = 300
    threshold_mb: int = resources.MIN_FREE_MB
    make_pdf: bool = True


def _told(condition: Column, *text: str | Column) -> Column:
    """A list of one warning or none."""
    return F.when(condition, F.array(F.concat(*(F.lit(x) if isinstance(x, str) else x for x in text)))).otherwise(F.array().cast("array<string>"))


def _listed(name: str) -> Column:
    return F.coalesce(name, F.array().cast("array<string>"))


def planned(files: DataFrame, profiles: DataFrame, machine: Machine = Machine()) -> DataFrame:
    """Profile rows (force: recognise every page) with name, modes, the memory plan and its line of figures (preflight)."""
    names = files.select("doc_id", F.element_at(F.split("doc_id", "/"), -1).alias("name"), "length")
    known = profiles.join(names, "doc_id").withColumn("modes", profile.recognition_modes(F.col("force")))
    known = known.withColumns({"free_mb": F.lit(machine.free_mb).cast("double"), "cpus": F.lit(machine.cpus), "forced": F.lit(machine.sequential)})
    return resources.plan(known, machine.dpi, machine.make_pdf, machine.threshold_mb).withColumn("preflight", resources.preflight())


def attempt_results(texts: DataFrame, profiles: DataFrame, tries: DataFrame) -> DataFrame:
    """doc_id, outcome, pdf_warning of the searchable-PDF attempts (ATTEMPTS) on each profiled document.

    A file that has a text layer stands in for a PDF that was not made; text is expected of a PDF if the Markdown has any.
    """
    known = profiles.select("doc_id", (~F.col("image_only")).alias("readable")).join(texts.select("doc_id", (X.alnum_count(F.col("markdown")) > 0).alias("has_text")), "doc_id", "left")
    judged = attempts.outcomes(tries.join(known, "doc_id"), F.coalesce("has_text", F.lit(False)), F.col("readable"))
    return judged.unionByName(attempts.not_tried(known, tries, F.col("readable"))).select("doc_id", "outcome", F.col("warning").alias("pdf_warning"))


def convert_pdfs(
    files: DataFrame, extractor: sources.Extractor, dictionary: Broadcast, ratio: float = 1.5, force: bool = False, machine: Machine = Machine(), tries: DataFrame | None = None,
    read: Callable[[str], bytes] = sources.read_content, page_seconds: float | None = sources.PAGE_SECONDS, file_seconds: float | None = sources.FILE_SECONDS,
) -> DataFrame:
    """doc_id, markdown, warnings, stats of PDF files.

    Documents that are no mere images have their text layer read; pages whose lines hold too little text, or cannot be read, are
    recognised like all pages of the others; a column `force` of files stands for the parameter. Pages, words, lines and blocks are written to the shared folder (scratch.py), so the work
    is done here, in short plans; only the last join is lazy. Pages go to tasks by their cost at the resolution that their document's memory
    plan allows; the plan's number of workers decides how many CPUs a task holds. tries: attempts at searchable PDFs (ATTEMPTS); read:
    opens a file in a task; page_seconds, file_seconds: deadlines of the extractor's calls, None for none.
    """
    raw = cut(sources.page_rows(files, extractor, file_seconds))
    known = raw.where("error is null")
    forced = files.select("doc_id", F.col("force") if "force" in files.columns else F.lit(force).alias("force"))
    profiles = cut(profile.profile(known).join(forced, "doc_id"))
    plans = cut(planned(files, profiles, machine).select("doc_id", "pages", "text_layer", "schedule", "dpi", "preflight", F.expr("force or image_only").alias("scan"), dealing.task_cpus(F.col("cpus"), F.col("ocr_workers")).alias("task_cpus")))
    sheets = cut(known.select("doc_id", "page_no", "width", "height").join(plans.select("doc_id", "scan", "dpi", "task_cpus"), "doc_id").withColumn("dpi", resources.capped_dpi(F.col("width"), F.col("height"), F.col("dpi"))))
    layered = sheets.where("not scan")
    found = cut(sources.word_rows(layered.withColumns({"route": F.lit("text"), "task_cpus": F.lit(1)}), extractor, read, page_seconds))
    text = cut(markdown.structured_lines(found.where("text is not null"), layered, "text"))

    asked = cut(sheets.where("scan").unionByName(profile.pages_without_words(layered, text)))
    recognises = getattr(extractor, "recognises", True)
    ocr_rows = cut(sources.word_rows(asked.where(F.lit(recognises)).withColumn("route", F.lit("ocr")), extractor, read, page_seconds))
    words = ocr_rows.where("text is not null and conf >= 0").withColumn("size", F.coalesce("size", X.glyph_size(F.col("text"), F.col("bottom") - F.col("top"))))
    ocr = markdown.structured_lines(words, sheets, "ocr")
    gone = asked.select("doc_id", "page_no")
    lines = cut(text.join(gone, ["doc_id", "page_no"], "left_anti").unionByName(ocr, allowMissingColumns=True))
    read_words = found.where("text is not null").join(gone, ["doc_id", "page_no"], "left_anti").withColumn("source", F.lit("text"))
    sizes = cut(structure.body_sizes(read_words.unionByName(words.withColumn("source", F.lit("ocr")))))
    blocks = cut(markdown.blocks_of(clean.clean_pages(lines), sizes, dictionary, ratio))

    # What the pages said on the way: problems, seconds, pages without text that nothing recognises.
    notes = raw.select("doc_id", "error", F.lit(False).alias("fatal"), "seconds")
    for part in (found, ocr_rows):
        notes = notes.unionByName(part.select("doc_id", "error", F.coalesce("fatal", F.lit(False)).alias("fatal"), "seconds"))
    notes = cut(notes.groupBy("doc_id").agg(F.sort_array(F.collect_set("error")).alias("errors"), F.bool_or("fatal").alias("fatal"), F.round(F.sum("seconds"), 1).alias("seconds")))
    skipped = asked.where(F.lit(not recognises)).groupBy("doc_id").agg(F.count("*").alias("skipped"))

    texts = cut(render.render(render.block_markdown(blocks, dictionary)).join(notes.where("fatal").select("doc_id"), "doc_id", "left_anti"))
    conf = profile.confidence_stats(layout.ocr_lines(words))
    joined = files.select("doc_id")
    for part in (texts, plans.drop("scan", "task_cpus"), conf, notes, skipped):
        joined = joined.join(part, "doc_id", "left")
    if tries is not None:
        joined = joined.join(attempt_results(texts, profiles, tries), "doc_id", "left")
    else:
        joined = joined.withColumns({"outcome": F.lit(None).cast("string"), "pdf_warning": F.lit(None).cast("string")})
    warnings = F.concat(
        _listed("errors"), _told(F.col("skipped").isNotNull(), F.col("skipped").cast("string"), " page(s) without a text layer were left out: nothing here recognises them."),
        _told(F.col("dpi") != machine.dpi, f"Memory is short: recognition at {resources.LOW_DPI} instead of {machine.dpi} dots per inch."),
        _told(F.col("pdf_warning").isNotNull(), F.col("pdf_warning")), _told(F.col("markdown").isNull() & (F.size(_listed("errors")) == 0) & F.col("skipped").isNull(), BLANK),
    )
    stats = F.struct(F.col("pages").cast("long").alias("pages"), "text_layer", F.coalesce("ocr_pages", F.lit(0)).cast("long").alias("ocr_pages"), "mean_conf", "schedule", "outcome", "preflight", "seconds")
    return joined.select("doc_id", "markdown", warnings.alias("warnings"), stats.cast(STATS).alias("stats"))


def _word_stats(pages: Column, ocr_pages: Column, seconds: Column) -> Column:
    empty = F.lit(None)
    return F.struct(pages.alias("pages"), F.lit(NATIVE).alias("text_layer"), ocr_pages.alias("ocr_pages"), empty.alias("mean_conf"), empty.alias("schedule"), empty.alias("outcome"), empty.alias("preflight"), seconds.alias("seconds")).cast(STATS)


def convert_docx(files: DataFrame) -> DataFrame:
    """doc_id, markdown, warnings, stats of Word files (doc_id, content); short: readable, but with under 20 letters or digits."""
    done = docx.docx_markdown(docx_items(files.select(F.col("doc_id").alias("path"), "content")))
    rows = files.select("doc_id").join(done, F.col("doc_id") == F.col("path"), "left")
    problem = F.coalesce("error", F.when(F.col("markdown").isNull(), F.lit(BLANK)))
    short = F.col("error").isNull() & (X.alnum_count(F.coalesce("markdown", F.lit(""))) < MIN_WORD_CHARS)
    return rows.select("doc_id", "markdown", F.filter(F.array(problem), lambda x: x.isNotNull()).alias("warnings"), _word_stats(F.lit(None), F.lit(None), F.lit(None)).alias("stats"), short.alias("short"))


def convert(
    files: DataFrame, dictionary: Broadcast, extractor: sources.Extractor | None = None, ratio: float = 1.5, force: bool = False, machine: Machine = Machine(), tries: DataFrame | None = None,
    page_seconds: float | None = sources.PAGE_SECONDS, file_seconds: float | None = sources.FILE_SECONDS,
) -> DataFrame:
    """doc_id, markdown, warnings, stats: one row per file (sources.read_files), failures included.

    Old Word files need the extractor's to_docx. With its to_pdf, Word files with hardly any text are made PDF and recognised.
    """
    to_docx, to_pdf = (getattr(extractor, name, None) for name in ("to_docx", "to_pdf"))
    left = [kind for kind, able in (("doc", to_docx), ("pdf", extractor)) if not able]
    told = sources.unsupported(files).unionByName(files.where(F.col("ext").isin(*left)).select("doc_id", F.concat(F.lit("An extractor is needed for ."), "ext").alias("error")))
    word = files.where("ext = 'docx'").select("doc_id", "content")
    if to_docx:
        made = cut(sources.converted(files.where("ext = 'doc'"), to_docx, file_seconds))
        word = word.unionByName(made.where("error is null").select("doc_id", "content"))
        told = told.unionByName(made.where("error is not null").select("doc_id", "error"))
    texts = convert_docx(word)
    pdfs = files.where("ext = 'pdf'").select("doc_id", "content", "length", F.lit(force).alias("force"))

    if to_pdf:
        texts = cut(texts)
        scans = cut(sources.converted(word.join(texts.where("short").select("doc_id"), "doc_id", "left_semi"), to_pdf, file_seconds))
        good = scans.where("error is null").select("doc_id")
        pdfs = pdfs.unionByName(scans.where("error is null").select("doc_id", "content", F.octet_length("content").cast("long").alias("length"), F.lit(True).alias("force")))
        texts = texts.join(good, "doc_id", "left_anti").join(scans.where("error is not null").select("doc_id", "error"), "doc_id", "left")
        texts = texts.withColumn("warnings", F.concat("warnings", _told(F.col("error").isNotNull(), F.col("error")))).drop("error")

    def read(path: str) -> bytes:
        """A file as PDF."""
        kind, content = path.rsplit(".", 1)[-1].lower(), sources.read_content(path)
        content = to_docx(content) if kind == "doc" else content
        return content if kind == "pdf" else to_pdf(content)

    parts = [texts.drop("short"), told.select("doc_id", F.lit(None).cast("string").alias("markdown"), F.array("error").alias("warnings"), F.lit(None).cast(STATS).alias("stats"))]
    if extractor:
        done = convert_pdfs(pdfs, extractor, dictionary, ratio, machine=machine, tries=tries, read=read, page_seconds=page_seconds, file_seconds=file_seconds)
        if to_pdf:
            done = done.join(good.withColumn("scan", F.lit(True)), "doc_id", "left")
            stats = F.when(F.col("scan"), _word_stats(F.col("stats.pages"), F.col("stats.ocr_pages"), F.col("stats.seconds"))).otherwise(F.col("stats"))
            done = done.select("doc_id", "markdown", F.concat(_told(F.col("scan"), SCANNED), "warnings").alias("warnings"), stats.alias("stats"))
        parts.append(done)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def once(files: DataFrame) -> DataFrame:
    """Of files with equal bytes the first by path."""
    nth = F.row_number().over(Window.partitionBy(F.sha2("content", 256)).orderBy("doc_id"))
    return files.withColumn("nth", nth).where("nth = 1").drop("nth")
