"""python -m quireflow INPUT -o OUT: a folder of files to Markdown files, warnings on standard error."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from quireflow.operators import resources
from quireflow.plans import convert
from quireflow.scratch import cut
from quireflow.sources import files as sources
from quireflow.sources import wordlist


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quireflow")
    parser.add_argument("input")
    parser.add_argument("-o", "--output", required=True, help="folder, as a URI or path that all executors share")
    parser.add_argument("--heading-ratio", type=float, default=1.5)
    parser.add_argument("--force-ocr", action="store_true")
    parser.add_argument("--wordlist", help="file with one word per line, for line-end hyphens")
    parser.add_argument("--extractor", help="module:object (or class) with pages() and words(), for PDF files")
    parser.add_argument("--dpi", type=int, default=300, help="resolution of recognition, lowered where memory is short")
    parser.add_argument("--free-mb", type=float, help="free memory of a machine that recognises, for the memory plan; unknown if absent")
    parser.add_argument("--cpus", type=int, default=1, help="CPUs of such a machine")
    parser.add_argument("--memory-threshold", type=int, default=resources.MIN_FREE_MB, help="free MB from which work runs side by side")
    parser.add_argument("--sequential", action="store_true", help="never side by side")
    parser.add_argument("--no-pdf", action="store_true", help="plan without jobs for searchable PDFs")
    parser.add_argument("--page-seconds", type=float, default=sources.PAGE_SECONDS, help="deadline of a page, 0 for none")
    parser.add_argument("--file-seconds", type=float, default=sources.FILE_SECONDS, help="deadline of opening or converting a file, 0 for none")
    return parser


def main(args: list[str] | None = None) -> int:
    asked = arguments().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    known = wordlist.dictionary(wordlist.read_words(spark, asked.wordlist) if asked.wordlist else None, spark)
    extractor = None
    if asked.extractor:
        module, _, name = asked.extractor.partition(":")
        extractor = getattr(importlib.import_module(module), name)
        extractor = extractor() if isinstance(extractor, type) else extractor
    output = asked.output if "://" in asked.output else f"file://{asked.output}"
    machine = convert.Machine(asked.free_mb, asked.cpus, asked.sequential, asked.dpi, asked.memory_threshold, not asked.no_pdf)
    rows = convert.convert(sources.read_files(spark, asked.input), known, extractor, asked.heading_ratio, asked.force_ocr, machine, page_seconds=asked.page_seconds or None, file_seconds=asked.file_seconds or None)
    # The figures are taken while the results are written, in the one run that there is.
    seen = Observation("conversion")
    results = cut(rows.observe(seen, F.count("*").alias("files"), F.count_if(F.col("markdown").isNull()).alias("failed"), F.sum("stats.pages").alias("pages"), F.sum("stats.ocr_pages").alias("recognised"), F.round(F.sum("stats.seconds"), 1).alias("seconds")))
    written = sources.write_markdown(results, output)
    for row in results.where("size(warnings) > 0").select("doc_id", "warnings").toLocalIterator():
        print(f"{row.doc_id}: {'; '.join(row.warnings)}", file=sys.stderr)
    print(" ".join(f"{name}={value or 0}" for name, value in (seen.get | {"written": written}).items()), file=sys.stderr)
    return 1 if seen.get["failed"] else 0


if __name__ == "__main__":
    sys.exit(main())
