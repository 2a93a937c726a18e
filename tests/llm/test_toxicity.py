"""The toxicity classifier: held-out accuracy, thresholds, and what must not move a score."""

from __future__ import annotations

import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.fixtures import documents, frame

from quireflow.llm import toxicity
from quireflow.llm.common import table
from quireflow.llm.queries import op6_toxicity_cnn

BIG, SMALL = "/root/testdata/sf0.1", "/root/testdata/sf0.01"


def auc(score: np.ndarray, label: np.ndarray) -> float:
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    for s in np.unique(score):
        rank[score == s] = np.searchsorted(score[order], s, "left") + 1 + ((score == s).sum() - 1) / 2
    n = label.sum()
    return float((rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n)))


@pytest.mark.parametrize("folder, least, found", [(BIG, 0.97, 0.8), (SMALL, 0.95, 0.6)])
def test_held_out_accuracy(spark, folder, least, found):
    """The small table trains on 45 toxic rows, 11 of them in three languages other than English, and holds out 6: four are found."""
    got = op6_toxicity_cnn(spark, folder).join(table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id").where("held_out and label is not null").toPandas()
    assert all(zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id)
    assert auc(got.score.to_numpy(), got.label.to_numpy()) > least
    assert (got.predicted == got.label).mean() > 0.95
    for decision in (got.predicted == 1, got.rejected):
        assert decision[got.label == 1].mean() >= found and decision[got.label == 0].mean() < 0.03


def toy(n: int = 400) -> list[tuple]:
    rng = np.random.default_rng(2)
    calm, rude = "sun lake tree path bird cloud".split(), "vile scum filth".split()
    rows = []
    for k in range(n):
        words = [calm[i] for i in rng.integers(0, 6, rng.integers(3, 40))]
        if k % 3 == 0:
            words.insert(int(rng.integers(len(words))), rude[k % 9 // 3])
        rows.append((k, " ".join(words), ["en", "de"][k % 2], "s", 1))
    return rows


def test_learns_words_in_long_texts_too(spark):
    rows = toy()
    labels = spark.createDataFrame([(r[0], int(r[0] % 3 == 0)) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, rows), labels)
    long = "lake path " * 60_000
    asked = [(1, "vile bird", "en", "s", 1), (2, "bird tree", "en", "s", 1), (3, long + "filth", "en", "s", 1), (4, long, "en", "s", 1), (5, None, None, None, None), (6, "", "en", "s", 0), (7, "vile bird", "de", None, 0), (8, "vile bird", None, None, 0)]
    got = {r.doc_id: r for r in toxicity.score(frame(spark, asked), model).collect()}
    assert got[1].toxicity > 0.5 > got[2].toxicity and got[3].toxicity > 0.5 > got[4].toxicity
    assert got[5].toxicity == got[6].toxicity and 0 <= got[5].toxicity <= 1
    assert got[7].toxicity == got[8].toxicity == got[1].toxicity, "language is no input of a score"


def test_one_class_none_and_empty(spark):
    docs = frame(spark, documents(2, 20))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")):
        rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
        assert len(rows) == docs.count() and len({r.toxicity for r in rows}) == 1
    assert toxicity.score(frame(spark, []), toxicity.fit(frame(spark, []), none)).collect() == []


def test_same_rows_same_model(spark):
    rows = toy(120)
    labels = spark.createDataFrame([(r[0], int(r[0] % 3 == 0)) for r in rows], "doc_id long, toxic int")
    a, b = (toxicity.fit(frame(spark, x), labels) for x in (rows, rows[::-1]))
    assert a.bias == b.bias and (a.embedding == b.embedding).all()


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = table(spark, BIG, "documents")
    labels = table(spark, BIG, "labels")
    held = "crc32(encode(cast(doc_id as string), 'UTF-8')) % 5 = 0"
    turned = labels.withColumn("toxic", F.when(F.expr(held), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels, held).bias == toxicity.fit(docs, turned, held).bias


def test_thresholds_come_from_all_labels(spark):
    """Every labelled row counts, in and beyond the training sample, and a language with few toxic rows is calibrated as well."""
    rows = [(k, t, "es" if k % 40 == 0 else l, s, n) for k, t, l, s, n in toy(1200)]
    labels = spark.createDataFrame([(r[0], int(r[0] % 3 == 0)) for r in rows], "doc_id long, toxic int")
    seen = []
    own = toxicity.calibrate
    toxicity.calibrate = lambda model, counts: (seen.extend(counts), own(model, counts))
    try:
        model = toxicity.fit(frame(spark, rows), labels, sample=300)
        done = toxicity.classify(frame(spark, rows), labels, sample=300)
    finally:
        toxicity.calibrate = own
    assert sum(a + b for _, _, a, b in seen) == 2 * 1200 and sum(a for _, _, a, _ in seen) == 2 * 400
    assert set(model.thresholds) == {"", "de", "en", "es"} and all(x != 0.5 for x in model.thresholds.values())
    limits = {(r.lang, r.threshold) for r in done.select("lang", "threshold").distinct().collect()}
    assert limits == {(x, model.thresholds[x]) for x in ("de", "en", "es")}
    again = toxicity.score(frame(spark, rows), model)
    assert sorted(map(str, again.select(done.columns).collect())) == sorted(map(str, done.collect()))


def test_few_rows_move_a_threshold_little_and_many_set_it():
    zero = lambda: toxicity.ToxicityModel(np.zeros((1, 1)), [], [], np.ones(3, np.float32), 0.0)
    shared = [("en", 100, 500, 0), ("en", -100, 0, 500)]
    few, many = zero(), zero()
    toxicity.calibrate(few, [*shared, ("es", -300, 1, 0), ("es", -400, 0, 1)])
    toxicity.calibrate(many, [*shared, ("es", -300, 900, 0), ("es", -400, 0, 900)])
    assert abs(few.thresholds["es"] - few.thresholds["en"]) < 0.05 and many.thresholds["es"] < many.thresholds["en"] - 0.05


def plain_logit(model: toxicity.ToxicityModel, text: str) -> float:
    """The classifier by plain loops over words, filters and places."""
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()))
    rows = []
    for word in words:
        data = np.frombuffer(word, np.uint8)
        parts, _ = toxicity.word_ids(data, np.array([0, len(data)]))
        rows.append([sum(float(model.embedding[p][d]) for p in parts[0]) for d in range(toxicity.DIM)])
    total = model.bias
    for j, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = 0.0
            for at in range(len(rows) - width + 1):
                z = float(model.shift[j][f])
                for k in range(width):
                    for d in range(toxicity.DIM):
                        z += rows[at + k][d] * float(model.filters[j][k][d][f])
                best = max(best, z)
            total += best * float(model.output[j * toxicity.FILTERS + f])
    return total


def test_forward_pass_against_plain_loops(spark):
    rows = toy(60)
    model = toxicity.train([r[1] for r in rows], np.array([float(r[0] % 3 == 0) for r in rows]))
    texts = ["", "vile", "Vile bird", "lake, tree; SCUM!", "a b", "日本語 filth ÄÖ", *(r[1] for r in rows[:10])]
    raw = [t.encode() for t in texts]
    got = model.score(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    assert np.allclose(got, [plain_logit(model, t) for t in texts], atol=1e-4)


def test_registered_query_against_plain_loops(spark, sf_dir):
    """Each score of op6 is the plain classifier's, under the model that the query's own steps give."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "crc32(encode(cast(doc_id as string), 'UTF-8')) % 5 = 0")
    got = {r.doc_id: r for r in op6_toxicity_cnn(spark, sf_dir).collect()}
    assert len(got) == docs.count()
    for r in docs.where(F.length("text") < 1500).limit(15).collect():
        want = 1 / (1 + np.exp(-model.slope * plain_logit(model, r.text) - model.offset))
        assert abs(got[r.doc_id].score - want) < 1e-4 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_the_training_sample_is_bounded_in_bytes(spark):
    """Longer texts than the bound never reach a training task; the rest still trains."""
    rows = [*toy(120), (900, "vile " * 60_000, "en", "s", 1), (901, "lake " * 60_000, "en", "s", 1)]
    labels = spark.createDataFrame([(r[0], int(r[0] % 3 == 0)) for r in rows], "doc_id long, toxic int")
    got = toxicity.sampled(frame(spark, rows), labels, 6000, 20_000).toPandas()
    assert 0 < sum(len(t.encode()) for t in got["text"]) <= 20_000 and len(got) == 120
    assert 48 <= toxicity.sampled(frame(spark, rows), labels, 50, 20_000).count() <= 50  # less the long ones among them


def test_a_training_task_holds_numbers_only(spark, monkeypatch):
    """Once training begins, neither Arrow batches nor texts are held, only the words' numbers: 6 bytes a word."""

    class Stop(Exception):
        pass

    taken = {}

    def capture(self, run, schema):
        taken["run"] = run
        raise Stop

    def first_step(*_):
        taken["held"] = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - taken["before"]
        raise Stop

    def batches():
        for at in range(0, 800, 100):
            texts = [f"meadow{k} " * 2000 for k in range(at, at + 100)]
            columns = {"doc_id": list(range(at, at + 100)), "lang": ["en"] * 100, "text": texts, "toxic": [k % 2.0 for k in range(100)], "fold": pa.array([k % 5 for k in range(100)], pa.int32()), "mark": [0] * 100, "k": pa.array([5] * 100, pa.int32())}
            yield pa.RecordBatch.from_pydict(columns)

    rows = spark.createDataFrame([(1, "en", "a", 1.0, 0, 1)], "doc_id long, lang string, text string, toxic double, fold int, mark long")
    with monkeypatch.context() as patch, pytest.raises(Stop):
        patch.setattr(type(rows), "mapInArrow", capture)
        toxicity.cross_fit(rows)
    monkeypatch.setattr(toxicity, "gradients", first_step)
    tracemalloc.start()
    try:
        taken["before"] = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes()
        with pytest.raises(Stop):
            list(taken["run"](batches()))
    finally:
        tracemalloc.stop()
    assert taken["held"] < 20e6, "15 MB of texts in 1.6 million words, of 10 MB; 5 MB of parameters"


def test_gradients_against_differences():
    """Each slope of the loss is what a small step of the parameter says, in double precision."""
    rows = toy(12)
    toxic = np.array([float(r[0] % 3 == 0) for r in rows])
    model = toxicity.train([r[1] for r in rows], toxic)
    model.filters, model.shift, model.embedding, model.output = [f.astype(np.float64) for f in model.filters], [s.astype(np.float64) for s in model.shift], model.embedding.astype(np.float64), model.output.astype(np.float64)
    raw = [r[1].encode() for r in rows]
    ids, first = toxicity.word_ids(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    weight = np.linspace(0.5, 1.5, len(rows))

    def loss() -> float:
        z = np.array([plain_logit(model, r[1]) for r in rows])
        return float(weight @ (np.logaddexp(0, z) - toxic * z))

    model.tracing = True
    grads, slope, touched, pushes = toxicity.gradients(model, ids, first, toxic, weight)
    rng = np.random.default_rng(1)
    by_row = np.zeros_like(model.embedding)
    np.add.at(by_row, touched, pushes)
    pairs = [*zip((*model.filters, *model.shift, model.output), grads), (model.embedding, by_row)]
    for values, slopes in pairs:
        flat = np.flatnonzero(np.abs(slopes.ravel()) > 1e-4)
        for at in rng.choice(flat, min(4, len(flat)), replace=False):
            old = values.flat[at]
            values.flat[at] = old + 1e-4
            above = loss()
            values.flat[at] = old - 1e-4
            below = loss()
            values.flat[at] = old
            assert abs((above - below) / 2e-4 - slopes.flat[at]) < 2e-3 * max(1.0, abs(slopes.flat[at]))
    assert abs(float(slope.sum()) - float(weight @ (1 / (1 + np.exp(-np.array([plain_logit(model, r[1]) for r in rows]))) - toxic))) < 1e-3
