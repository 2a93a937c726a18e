"""Word body items to Markdown: inline marks, tables, headings, numbered and bullet lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.functions import text as X

MAX_LEVEL = 6


def inline_markdown(runs: Column) -> Column:
    """Neighbouring runs with equal marks join; marks hug the text and leave white space outside."""
    kind = "array<struct<text:string,bold:boolean,italic:boolean,url:string>>"

    def add(done: Column, raw: Column) -> Column:
        run = F.struct(F.translate(raw["text"], "\t\n", "  ").alias("text"), raw["bold"].alias("bold"), raw["italic"].alias("italic"), raw["url"].alias("url"))
        last = F.try_element_at(done, F.lit(-1))
        same = (F.size(done) > 0) & (last["bold"] == run["bold"]) & (last["italic"] == run["italic"]) & (last["url"] == run["url"])
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.concat(last["text"], run["text"]).alias("text"), run["bold"].alias("bold"), run["italic"].alias("italic"), run["url"].alias("url"))))
        return F.when(same, joined).when(run["text"] == "", done).otherwise(F.concat(done, F.array(run)))

    def marked(run: Column) -> Column:
        core = X.strip(run["text"])
        lead, trail = F.regexp_extract(run["text"], rf"(?U)^({X.SPACE}*)", 1), F.regexp_extract(run["text"], rf"(?U)({X.SPACE}*)\z", 1)
        mark = F.concat(F.when(run["bold"], "**").otherwise(""), F.when(run["italic"], "*").otherwise(""))
        linked = F.when(run["url"] != "", F.concat(F.lit("["), core, F.lit("]("), run["url"], F.lit(")"))).otherwise(core)
        return F.when(core == "", run["text"]).otherwise(F.concat(lead, mark, linked, F.reverse(mark), trail))

    merged = F.aggregate(runs, F.expr(f"cast(array() as {kind})"), add)
    return X.strip(F.regexp_replace(F.array_join(F.transform(merged, marked), ""), rf"(?U){X.SPACE}+", " "))


def plain_text(runs: Column) -> Column:
    return X.strip(F.regexp_replace(F.array_join(F.transform(runs, lambda r: r["text"]), ""), rf"(?U){X.SPACE}+", " "))


def table_markdown(rows: Column) -> Column:
    """Ragged rows padded; the first one is the header; pipes escaped, line ends as <br>."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda c: X.strip(F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
    return F.when(F.size(rows) == 0, "").otherwise(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n"))


def list_counters(items: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """items(path, pos, run, num_id, ilvl) with n: a counter per list level that starts anew with each run of list items and
    whenever a shallower item of the same list came in between. ties: columns that order items of one position."""
    same = Window.partitionBy("path", "run", "num_id").orderBy("pos")
    # Levels below ilvl restart: the number of shallower items so far names the stretch in which a level counts.
    levels = range(0, 9)
    stretch = F.coalesce(*(F.when(F.col("ilvl") == k, F.sum((F.col("ilvl") < k).cast("int")).over(same.rangeBetween(Window.unboundedPreceding, 0))) for k in levels), F.lit(0))
    counted = items.withColumn("stretch", stretch)
    return counted.withColumn("n", F.row_number().over(Window.partitionBy("path", "run", "num_id", "ilvl", "stretch").orderBy("pos", *ties))).drop("stretch")


def docx_markdown(items: DataFrame) -> DataFrame:
    """path, markdown, error of each document. Items of one position are one part, in the order of their texts."""
    doc = Window.partitionBy("path")
    order = doc.orderBy("pos", "plain", "rows")
    so_far = doc.orderBy("pos").rangeBetween(Window.unboundedPreceding, 0)
    errors = items.where("kind = 'error'").select("path", "error")
    # Files store built-in style names in lower case ("heading 1"), programs show them capitalised: case does not count.
    items = items.withColumn("style", F.lower("style"))
    shift = F.max((F.col("style") == "title").cast("int")).over(doc)
    rows = items.where("kind <> 'error'").withColumn("shift", F.coalesce(shift, F.lit(0))).withColumn("plain", F.when(F.col("kind") == "para", plain_text(F.col("runs"))))
    rows = rows.where("kind = 'table' or plain <> ''")
    level = F.nullif(F.regexp_extract("style", r"^heading (\d)", 1), F.lit("")).cast("int")
    listed = (F.col("kind") == "para") & (F.col("style") != "title") & level.isNull() & (F.col("num_id").isNotNull() | F.col("style").startswith("list"))
    rows = rows.withColumn("level", level).withColumn("listed", F.coalesce(listed, F.lit(False)))
    rows = rows.withColumns({"before": F.coalesce(F.lag("listed").over(order), F.lit(False)), "nth": F.row_number().over(order)})
    rows = rows.withColumn("run", F.sum(F.when(F.col("listed") & F.col("before"), 0).otherwise(1)).over(so_far))
    fallback = F.when(F.contains(F.col("style"), F.lit("number")), "decimal").otherwise("bullet")
    lists = rows.where("listed").withColumn("fmt", F.coalesce("fmt", fallback)).withColumn("num_id", F.coalesce("num_id", "style")).withColumn("ilvl", F.coalesce("ilvl", F.lit(0)))
    inline = inline_markdown(F.col("runs"))
    marker = F.when(F.col("fmt").isin("bullet", "none"), "-").otherwise(F.concat(F.col("n").cast("string"), F.lit(".")))
    done_lists = list_counters(lists, ("nth",)).select("path", "run", "nth", F.concat(F.repeat(F.lit("   "), F.col("ilvl")), marker, F.lit(" "), inline).alias("md"))
    others = rows.where("not listed").select("path", "run", "nth", F.when(F.col("kind") == "table", table_markdown(F.col("rows"))).when(F.col("style") == "title", F.concat(F.lit("# "), "plain")).when(F.col("level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.least(F.col("level") + F.col("shift"), F.lit(MAX_LEVEL))), F.lit(" "), F.col("plain"))).otherwise(X.escape_start(inline)).alias("md"))
    ordered = lambda at, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "md"))), lambda x: x["md"]), sep)
    parts = done_lists.unionByName(others).groupBy("path", "run").agg(ordered("nth", "\n").alias("md")).where("md <> ''")
    joined = parts.groupBy("path").agg(F.concat(X.strip(ordered("run", "\n\n")), F.lit("\n")).alias("markdown"))
    return joined.withColumn("error", F.lit(None).cast("string")).unionByName(errors.select("path", F.lit(None).cast("string").alias("markdown"), "error"))
