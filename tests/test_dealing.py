"""Pages dealt by cost, plans that act, deadlines, and the committing sink."""

from __future__ import annotations

import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F
from tests.test_convert import Plain, folder

from quireflow.plans import convert
from quireflow.sources import dealing, deadline, sink, wordlist
from quireflow.sources import files as sources


def parts(df, cost="cost"):
    return sorted((r.n, r.cost, r.docs) for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum(cost).alias("cost"), F.countDistinct("doc_id").alias("docs")).collect())


def test_costs_are_even(spark):
    """10,000 pages on all slots: one giant file is split, sizes differ sixteenfold, no part is over 1.2 times the mean."""
    small = spark.range(4000).selectExpr("concat('d', id % 200) as doc_id", "cast(id / 200 as int) + 1 as page_no", "double(if(id % 7 = 0, 16, 1)) as cost")
    pages = small.unionByName(spark.range(6000).selectExpr("'giant' as doc_id", "cast(id as int) + 1 as page_no", "8.4D as cost"))
    dealt = dealing.deal(pages, slots=8)
    costs = [c for _, c, _ in parts(dealt)]
    assert dealt.count() == 10_000 and len(costs) == -(-int(pages.agg(F.sum("cost")).first()[0]) // 1000) >= 8 and max(costs) < 1.2 * sum(costs) / len(costs)
    few = parts(dealing.deal(pages, task_cost=1e9, slots=8))
    assert len(few) == 8 and max(c for _, c, _ in few) < 1.2 * sum(c for _, c, _ in few) / 8
    # Each part reads few files: pages of a file stay together.
    assert sum(d for _, _, d in few) < 201 + 8 * 6
    order = [(r.p, r.doc_id, r.page_no) for r in dealing.deal(pages, slots=3).withColumn("p", F.spark_partition_id()).collect()]
    assert order == sorted(order)


def test_dealing_without_pages_and_with_dear_ones(spark):
    none = spark.createDataFrame([], "doc_id string, page_no int, cost double")
    assert dealing.deal(none).count() == 0
    odd = spark.createDataFrame([("a", 1, 1e6), ("a", 2, 0.0), (None, 3, 1.0), ("b", None, 1.0), ("a", 1, 1.0)], "doc_id string, page_no int, cost double")
    assert dealing.deal(odd, task_cost=1e5).count() == 5
    cost = lambda *row: spark.createDataFrame([row], "route string, w double, h double, dpi int").select(dealing.page_cost(F.col("route"), F.col("w"), F.col("h"), F.col("dpi"))).first()[0]
    assert cost("ocr", 612.0, 792.0, 300) == pytest.approx(8.415) and cost("ocr", None, None, 300) == pytest.approx(8.415) and cost("ocr", 1e6, 1e6, 300) == 60 and cost("text", 1e6, 1e6, 300) == dealing.TEXT_COST


def test_recognition_uses_all_slots(spark):
    class Slot:
        def words(self, content, page_no, route, dpi):
            return [{"text": f"{dpi}", "conf": 90.0}]

    pages = spark.range(2000).selectExpr("concat('d', id % 20) as doc_id", "cast(id as int) as page_no", "'ocr' as route", "612D as width", "792D as height", "200 as dpi", "1 as task_cpus")
    rows = sources.word_rows(pages, Slot(), read=lambda path: b"", limit=5.0)
    spread = [n for n, _, _ in parts(rows, F.lit(1))]
    assert len(spread) >= 8 and max(spread) < 1.2 * 2000 / len(spread) and {r.text for r in rows.select("text").distinct().collect()} == {"200"}


class Seen(Plain):
    """Tells the resolution that it was asked for."""

    def words(self, content, page_no, route, dpi):
        return [x | {"text": f"Word{dpi}"} for x in super().words(content, page_no, route, dpi)]


def test_planned_resolution_reaches_the_extractor(spark, tmp_path):
    files = sources.read_files(spark, folder(tmp_path)).where("doc_id like '%b.PDF'")
    known = wordlist.dictionary(None, spark)
    for machine, dpi in ((convert.Machine(150.0, 4), 200), (convert.Machine(8000.0, 4), 300), (convert.Machine(8000.0, 4, dpi=400), 400)):
        text = convert.convert_pdfs(files, Seen(), known, force=True, machine=machine).first().markdown
        assert f"Word{dpi}" in text and text.count("Word") == text.count(f"Word{dpi}")


def test_plan_classes(spark):
    got = spark.createDataFrame([(8, 8), (8, 4), (8, 3), (8, 1), (1, 1), (6, 1)], "cpus int, workers int").select(dealing.task_cpus(F.col("cpus"), F.col("workers")).alias("k")).collect()
    assert [r.k for r in got] == [1, 2, 4, 8, 1, 6] and dealing.profile_of(spark, 4) is None


CLUSTER = """
from pyspark import TaskContext
from pyspark.sql import SparkSession
from quireflow.sources import files as sources
spark = SparkSession.builder.master("local-cluster[1,4,1024]").config("spark.ui.enabled", "false").config("spark.executor.memory", "1g").getOrCreate()
class Cpus:
    def words(self, content, page_no, route, dpi):
        return [{"text": str(TaskContext.get().cpus()), "conf": 90.0}]
pages = spark.range(40).selectExpr("concat('d', id % 4) as doc_id", "cast(id as int) as page_no", "'ocr' as route", "612D as width", "792D as height", "300 as dpi", "cast(if(id % 4 < 2, 1, 4) as int) as task_cpus")
rows = sources.word_rows(pages, Cpus(), read=lambda path: b"", limit=None)
print(sorted((r.doc_id, r.text, r["count"]) for r in rows.groupBy("doc_id", "text").count().collect()))
spark.stop()
"""


def test_classes_run_with_their_cpus():
    """On a cluster (of one executor) the tasks of a class hold the CPUs that its plan asks for."""
    env = os.environ | {"PYTHONPATH": os.getcwd(), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run([sys.executable, "-c", CLUSTER], capture_output=True, text=True, timeout=300, env=env, check=False)
    assert "[('d0', '1', 10), ('d1', '1', 10), ('d2', '4', 10), ('d3', '4', 10)]" in done.stdout, done.stderr[-2000:]


class Hangs(Plain):
    """Page 2 sleeps for ever, page 3 kills its process."""

    def words(self, content, page_no, route, dpi):
        if page_no == 2:
            time.sleep(10_000)
        if page_no == 3:
            os._exit(7)
        return super().words(content, page_no, route, dpi)


def test_deadlines(spark, tmp_path):
    (tmp_path / "h.pdf").write_bytes(b"First page of text.\fsecond\fthird\fFourth page of text.")
    files = sources.read_files(spark, str(tmp_path))
    began = time.monotonic()
    row = convert.convert_pdfs(files, Hangs(), wordlist.dictionary(None, spark), page_seconds=1.0).first()
    assert time.monotonic() - began < 60 and "First page of text." in row.markdown and "Fourth page of text." in row.markdown
    assert [w for w in row.warnings if "Page 2 failed: no answer within 1 seconds" in w] and [w for w in row.warnings if "Page 3 failed: the extractor's process ended with code 7" in w]

    class Stuck(Plain):
        def pages(self, content):
            time.sleep(10_000)

    assert "within 0.5 seconds" in sources.page_rows(files, Stuck(), 0.5).first().error
    assert "within 0.5 seconds" in sources.converted(files, lambda content: time.sleep(10_000), 0.5).first().error


def test_helper_is_clean_afterwards():
    class OddError(Exception):
        def __init__(self, a, b):
            super().__init__(f"{a} {b}")

    def make():
        held = []

        def call(x):
            held.append(x)
            if x == "sleep":
                time.sleep(10_000)
            if x == "fatal":
                raise sources.FatalError("no data")
            if x == "odd":
                raise OddError(1, 2)
            return len(held)

        return call

    with deadline.Helper(make, 0.5) as helper:
        assert [helper("a"), helper("b")] == [1, 2]
        first = helper.process.pid
        for asked, error in (("fatal", sources.FatalError), ("odd", RuntimeError), ("sleep", deadline.OverdueError)):
            with pytest.raises(error):
                helper(asked)
        assert helper.process is None and helper("c") == 1  # a new process with new state
        assert helper.process.pid != first
        last = helper.process.pid
    for pid in (first, last):
        with pytest.raises(ProcessLookupError):
            os.kill(pid, 0)
    with deadline.Helper(make, None) as helper:
        assert [helper("a"), helper("b")] == [1, 2] and helper.process is None


def listing(path) -> list[str]:
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names)


def test_sink_commits(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([(f"n{k}.pdf", bytes([k, 255])) for k in range(20)] + [("deep/x y.md", None)], "name string, content binary").repartition(4)
    assert sink.write_files(rows, out) == 21
    assert len(listing(tmp_path / "out")) == 21 and (tmp_path / "out/n3.pdf").read_bytes() == b"\x03\xff" and (tmp_path / "out/deep/x y.md").read_bytes() == b""
    assert sink.write_files(spark.createDataFrame([("n3.pdf", "ü")], "name string, content string"), out) == 1
    assert (tmp_path / "out/n3.pdf").read_text() == "ü" and len(listing(tmp_path / "out")) == 21
    assert sink.write_files(rows.limit(0), f"file://{tmp_path}/none") == 0 and listing(tmp_path / "none") == []


def test_sink_shows_nothing_of_failed_jobs(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    bad = spark.range(40).selectExpr("concat('n', id) as name", "if(id = 33, cast(raise_error('half-way') as string), 'x') as content").repartition(4, "name")
    with pytest.raises(Exception, match="half-way"):
        sink.write_files(bad, out)
    assert listing(tmp_path) == []
    for names in (["a", "a"], ["../a"], ["/a"], [None], [""], ["x/../../a"]):
        with pytest.raises(Exception):  # noqa: B017
            sink.write_files(spark.createDataFrame([(n, "x") for n in names], "name string, content string"), out)
    assert listing(tmp_path) == []


def test_sink_recovers(spark, tmp_path):
    """A driver lost after the commit, in the middle of publishing, and before the commit."""
    out, top = f"file://{tmp_path}/out", tmp_path / "out"
    job = sink.stage(spark.createDataFrame([(f"n{k}", "x") for k in range(10)], "name string, content string").repartition(3), out)
    assert all(f.startswith(sink.HIDDEN) for f in listing(top)) and len(listing(top)) == 11
    moved = next(f for f in listing(top) if f.endswith("/n4"))
    os.rename(top / moved, top / "n4")
    writer = sink.FilesWriter(out, "uncommitted")
    writer.write(iter([{"name": "lost", "content": b"y"}]))
    assert sink.recover(spark, out) == {job: 10, "uncommitted": None}
    assert listing(top) == sorted(f"n{k}" for k in range(10)) and sink.recover(spark, out) == {}


def test_attempts_of_one_task_leave_one_file(spark, tmp_path):
    """Of a task that ran twice only the attempt that Spark reports is published."""
    out, top = f"file://{tmp_path}/out", tmp_path / "out"
    writer = sink.FilesWriter(out, "job")
    writer.write(iter([{"name": "a", "content": b"lost attempt"}, {"name": "b", "content": b"lost attempt"}]))
    kept = writer.write(iter([{"name": "a", "content": b"kept"}]))
    writer.commit([kept, None])
    assert sink.publish(spark, out, "job") == 1 and listing(top) == ["a"] and (top / "a").read_bytes() == b"kept"
