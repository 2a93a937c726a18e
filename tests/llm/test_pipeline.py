"""The corpus pipeline: each stage on its own input, against the brute-force versions."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F
from tests.llm import test_decontaminate, test_mixing, test_simhash
from tests.llm.fixtures import documents, frame, smallest_reachable

from quireflow.llm import common
from quireflow.llm.common import cut, table


def kept_of_similar(rows: list[tuple]) -> set:
    """Least id of each group that Jaccard similarities of 0.8 or more of five-word runs connect, over all pairs."""
    texts = [r[1] or "" for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if test_simhash.jaccard(texts[i], texts[j]) >= 0.8]
    least: dict = {}
    for r, part in zip(rows, smallest_reachable(len(rows), links)):
        least[part] = min(least.get(part, r[0]), r[0])
    return set(least.values())


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, bench = docs.columns, [tuple(r) for r in table(spark, sf_dir, "benchmark").collect()]
    toxic = {r.doc_id for r in table(spark, sf_dir, "labels").where("toxic = 1").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.collect()]
        docs = cut(stage(spark, docs, sf_dir))
        after = [tuple(r) for r in docs.collect()]
        assert docs.columns == columns and set(after) <= set(before)
        ids = {r[0] for r in after}
        if name == "toxicity":
            gone = {r[0] for r in before} - ids
            known = {r.doc_id for r in table(spark, sf_dir, "labels").where("toxic is not null").collect()}
            assert len(gone & toxic) >= 0.7 * len(toxic) and len((gone & known) - toxic) <= 0.1 * len(known)
        elif name == "simhash":
            assert ids == kept_of_similar(before) and len(ids) == len(after)
        elif name == "decontamination":
            assert ids == {r[0] for r in test_decontaminate.brute(before, bench) if not r[5]}
        else:
            sizes = Counter()
            for r in before:
                sizes[r[3]] += test_mixing.size(r[1])
            want, mixed = test_mixing.water(dict(sizes)), Counter()
            for r in after:
                mixed[r[3]] += test_mixing.size(r[1])
            most = max(test_mixing.size(r[1]) for r in before)
            assert all(abs(mixed[s] - want[s]) <= most / 2 + 1e-6 for s in sizes)
    plan = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert sorted(r.doc_id for r in plan) == sorted(r[0] for r in after)


def test_awkward_rows_pass_every_stage(spark, sf_dir):
    """Nulls, empty and long texts, repeated rows and foreign columns go through all stages."""
    for rows in (documents(1, 40), []):
        docs = frame(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = cut(stage(spark, docs, sf_dir))
            assert docs.columns == frame(spark, []).columns
        corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and {r.shard for r in rows} <= set(range(40))


def test_stages_send_small_batches(spark, monkeypatch):
    """The texts of a task go to Python in several batches of bounded bytes, and the session's own limit stays as it is."""
    docs = frame(spark, [(k, f"meadow{k} river stone " * 4000, "en", "s", 1) for k in range(120)]).coalesce(1)
    seen = []

    def measured(rows, *_, **__):
        got = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"bytes": [b.nbytes]}) for b in batches), "bytes long").collect()
        seen.append([r["bytes"] for r in got])
        return rows.withColumns({"toxic": F.lit(False), "contaminated": F.lit(False)})

    for operator, name in ((corpus_pipeline.toxicity, "classify"), (corpus_pipeline.simhash, "deduplicate"), (corpus_pipeline.decontaminate, "decontaminate")):
        monkeypatch.setattr(operator, name, measured)
    for _, stage in corpus_pipeline.STAGES[:3]:
        stage(spark, docs, "/root/testdata/sf0.001")
    assert len(seen) == 3 and all(sum(sizes) > 10e6 and max(sizes) < 1.1 * common.BATCH_BYTES for sizes in seen), seen
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    assert spark.conf.get(limit, None) is None
    spark.conf.set(limit, "1m")
    try:
        with common.small_batches(spark):
            assert spark.conf.get(limit) == "1m"
        assert spark.conf.get(limit) == "1m"
    finally:
        spark.conf.unset(limit)
