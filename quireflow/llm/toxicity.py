"""Toxicity: a convolutional text classifier, trained in numpy, scored inside Arrow batches.

Words (runs of ASCII letters and digits and of other non-ASCII bytes, lower-cased) become the sum of three hashed
embeddings: of the whole word and of its first four and six bytes, which carry stems through inflection. Filters of
widths 1, 2 and 3 slide over the words; each filter's greatest response over the WHOLE text feeds one logistic unit.
Training takes a bounded, documented sample of the labelled rows (the `sample` ids with the least hash, up to `sample_bytes` of text; equal
rows of one id once) and leaves out most words at random in each step, so that no single rare word is relied on. Calibration (Platt
scaling) and thresholds count all labelled rows by language and bin of score, at any size in the same way: sampled rows by models that were
trained without their fold, all others by the model itself. The models are trained in a task each. A language's threshold is the cut
of best F1 on its own counts plus PRIOR toxic rows' worth of the counts of all languages, so few rows move it little from
the shared one. Scores use the text alone: language only picks the threshold of the filtering decision, never the score.

Null and empty texts have no words: every filter answers 0 and the score is that of the bias. Long texts are scored in
overlapping pieces whose maxima combine, so memory is bounded. Without labelled rows of both classes every score is the
(smoothed) share of toxic labels. An id with several labels is toxic if one says so. Repeated rows are scored alike, ties in the order of
ids go by text hash, empty tables give none. Input columns named like a result column are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireflow.llm.common import NOT_ALNUM, append_columns, blocks, cut, prefix_sums, slice_hash, word_spans, word_table

BUCKETS, STEMS, DIM, WIDTHS, FILTERS = 1 << 15, (4, 6), 12, (1, 2, 3), 8
DROPPED = 0.6  # share of words left out of a training step
SAMPLE, SAMPLE_BYTES, STEPS, BATCH_WORDS = 6000, 48 << 20, 1000, 20000
LANGUAGES = 1000  # most languages with a threshold of their own; rarer ones have the common one
FOLDS, PRIOR, BINS = 5, 20, 256  # of the ids, for calibration; pseudo rows of the shared counts; bins per unit of asinh(logit)
RESULT = ("toxicity", "threshold", "toxic")
_WORDS = word_table(True, NOT_ALNUM)


def word_ids(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of each word (itself and its beginnings of STEMS bytes), and the words before each text and in all."""
    kept = _WORDS[data]
    begin, end, first = word_spans(kept, starts)
    sums = prefix_sums(kept)
    parts = [end, *(np.minimum(end, begin + k) for k in STEMS)]
    return np.stack([slice_hash(sums, begin, stop) % np.uint64(BUCKETS) + np.uint64(k * BUCKETS) for k, stop in enumerate(parts)], 1).astype(np.int32), first


def packed(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """word_ids of each text in 16 bits a part, 6 bytes a word: a part's first row is left out."""
    ids, first = word_ids(data, starts)
    short = (ids % BUCKETS).astype(np.uint16)
    return [short[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def unpacked(short: np.ndarray) -> np.ndarray:
    return short + np.arange(0, (1 + len(STEMS)) * BUCKETS, BUCKETS, dtype=np.int32)


@dataclass
class ToxicityModel:
    """Plain arrays; thresholds: by language, "" for any other."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    shift: list[np.ndarray]
    output: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    thresholds: dict[str, float] = field(default_factory=lambda: {"": 0.5})

    def responses(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest response of each filter in each text (0 where none is positive), and the word where it begins (-1)."""
        texts, total = len(first) - 1, len(ids)
        best = np.zeros((texts, len(WIDTHS) * FILTERS), np.float32)
        where = np.full(best.shape, -1, np.int64)
        if not total:
            return best, where
        words = self.embedding[ids].sum(1)
        owner = np.repeat(np.arange(texts), np.diff(first))
        for j, width in enumerate(WIDTHS):
            n = total - width + 1
            if n <= 0:
                continue
            z = np.full((n, FILTERS), self.shift[j], np.float32)
            for k in range(width):
                z += words[k : k + n] @ self.filters[j][k]
            z[owner[:n] != owner[width - 1 : width - 1 + n]] = -1  # runs over the end of a text
            at = np.flatnonzero((first[:-1] < first[1:]) & (first[:-1] < n))
            cols = slice(j * FILTERS, (j + 1) * FILTERS)
            best[at, cols] = np.maximum(np.maximum.reduceat(z, first[at], axis=0), 0)
            for f in range(FILTERS) if self.tracing else ():
                equal = np.flatnonzero((z[:, f] > 0) & (z[:, f] == best[owner[:n], j * FILTERS + f]))
                where[owner[equal[::-1]], j * FILTERS + f] = equal[::-1]
        return best, where

    tracing: bool = False

    def logits(self, best: np.ndarray) -> np.ndarray:
        return best @ self.output + self.bias

    def score(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.answers(*word_ids(data, starts))

    def answers(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        step, lap = 1 << 16, max(WIDTHS) - 1
        if len(ids) <= step:
            return self.logits(self.responses(ids, first)[0])
        best = np.zeros((len(first) - 1, len(WIDTHS) * FILTERS), np.float32)
        for at in range(0, len(ids), step):
            stop = min(len(ids), at + step + lap)
            piece = np.clip(first, at, stop) - at
            best = np.maximum(best, self.responses(ids[at:stop], piece)[0])
        return self.logits(best)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gradients(model: ToxicityModel, ids: np.ndarray, first: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Slopes of the weighted logistic loss of some texts: by filters, shifts and output, by logit, and by embedding rows (with repeats) and their pushes."""
    best, where = model.responses(ids, first)
    slope = ((sigmoid(model.logits(best)) - toxic) * weight).astype(np.float32)
    down = slope[:, None] * model.output * (where >= 0)
    grads = [np.zeros_like(p) for p in (*model.filters, *model.shift, model.output)]
    grads[-1][:] = slope @ best
    touched, pushes = [np.zeros(0, np.int32)], [np.zeros((0, DIM), np.float32)]
    for j, width in enumerate(WIDTHS):
        r, f = np.nonzero(where[:, j * FILTERS : (j + 1) * FILTERS] >= 0)
        place, g = where[r, j * FILTERS + f], down[r, j * FILTERS + f]
        np.add.at(grads[len(WIDTHS) + j], f, g)
        for k in range(width):
            parts = ids[place + k]
            np.add.at(grads[j][k].T, f, g[:, None] * model.embedding[parts].sum(1))
            touched.append(parts.ravel())
            pushes.append(np.repeat(g[:, None] * model.filters[j][k].T[f], parts.shape[1], axis=0))
    return grads, slope, np.concatenate(touched), np.concatenate(pushes)


def train(texts: list[str], toxic: np.ndarray, seed: int = 7) -> ToxicityModel:
    return train_packed([packed(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for t in texts], toxic, seed)


def train_packed(coded: list[np.ndarray], toxic: np.ndarray, seed: int = 7) -> ToxicityModel:
    """Adam on the logistic loss of texts whose words are packed numbers."""
    rng = np.random.default_rng(seed)
    model = ToxicityModel(
        rng.normal(0, 0.1, ((1 + len(STEMS)) * BUCKETS, DIM)).astype(np.float32), [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) / w for w in WIDTHS], [np.full(FILTERS, 0.01, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), float(np.log((toxic.sum() + 1) / (len(toxic) - toxic.sum() + 1))),
    )
    if not 0 < toxic.sum() < len(toxic):
        model.output[:] = 0
        return model
    n = len(coded)
    dense = [*model.filters, *model.shift, model.output]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in dense]
    squares = np.zeros(len(model.embedding), np.float32)
    bias_moment, rate, steps = 0.0, 0.02, 0
    weight = np.where(toxic > 0, len(toxic) / (2 * toxic.sum()), len(toxic) / (2 * (len(toxic) - toxic.sum())))
    model.tracing = True
    while steps < STEPS:
        order, at = rng.permutation(n), 0
        while at < len(order) and steps < STEPS:
            stop, words = at, 0
            while stop < len(order) and (stop == at or words + len(coded[order[stop]]) <= BATCH_WORDS) and stop - at < 32:
                words += len(coded[order[stop]])
                stop += 1
            rows = order[at:stop]
            at = stop
            ids = np.concatenate([coded[r] for r in rows])
            kept = rng.random(len(ids)) >= DROPPED
            first = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum([len(coded[r]) for r in rows])])]
            ids = unpacked(ids[kept])
            grads, slope, touched, pushes = gradients(model, ids, first, toxic[rows], weight[rows] / len(rows))
            steps += 1
            for p, g, (m, v) in zip(dense, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-6)
            bias_moment += 0.1 * (float(slope.sum()) - bias_moment)
            model.bias -= rate * bias_moment
            if len(touched):
                ids, inverse = np.unique(touched, return_inverse=True)
                total = np.zeros((len(ids), DIM), np.float32)
                np.add.at(total, inverse, pushes)
                squares[ids] += (total * total).mean(1)
                model.embedding[ids] -= 0.1 * total / (np.sqrt(squares[ids]) + 1e-6)[:, None]
    model.tracing = False
    return model


def calibrate(model: ToxicityModel, counts: list[tuple[str | None, int, int, int]]) -> None:
    """Platt scaling and thresholds from (language, bin, toxic rows, clean rows) of rows that did not train."""
    bins = np.array(sorted({b for _, b, _, _ in counts}), np.int64)
    langs = sorted({x for x, *_ in counts if x is not None})
    place, row = {b: k for k, b in enumerate(bins.tolist())}, {x: k for k, x in enumerate(langs)}
    own, shared = np.zeros((len(langs), 2, len(bins))), np.zeros((2, len(bins)))
    for lang, b, hits, others in counts:
        shared[:, place[b]] += hits, others
        if lang is not None:
            own[row[lang], :, place[b]] += hits, others
    if not shared.sum(1).all():
        return
    # Rows of both classes weighed alike in training; the scaling turns logits into probabilities.
    logit = np.sinh((bins + 0.5) / BINS)
    slope, shift = platt(np.tile(logit, 2), np.repeat([1.0, 0.0], len(bins)), shared.ravel())
    model.slope, model.offset = slope, shift
    logit = logit * slope + shift
    model.thresholds[""] = float(sigmoid(best_cut(logit, *shared)))
    for lang in langs:
        model.thresholds[lang] = float(sigmoid(best_cut(logit, *(own[row[lang]] + shared * (PRIOR / shared[0].sum())))))


def platt(logit: np.ndarray, toxic: np.ndarray, times: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic fit of the labels on the logits, with smoothed targets; by damped Newton steps."""
    hits, total = (toxic * times).sum(), times.sum()
    target = np.where(toxic > 0, (hits + 1) / (hits + 2), 1 / (total - hits + 2))
    rows = np.stack([logit / max(1e-6, np.abs(logit).max()), np.ones(len(logit))], 1)
    at = np.zeros(2)
    loss = lambda x: float(times @ np.logaddexp(0, rows @ x) - (target * times) @ (rows @ x))
    for _ in range(100):
        p = sigmoid(rows @ at)
        step = np.linalg.solve((rows * (times * p * (1 - p))[:, None]).T @ rows + 1e-6 * np.eye(2), rows.T @ (times * (p - target)))
        rate = 1.0
        while rate > 1e-6 and loss(at - rate * step) > loss(at):
            rate /= 2
        at = at - rate * step
        if np.abs(rate * step).max() < 1e-9:
            break
    slope = at[0] / max(1e-6, np.abs(logit).max())
    return (float(slope), float(at[1])) if slope > 0 else (1.0, 0.0)


def best_cut(logit: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The midpoint of the widest gap among the cuts of highest F1; logit ascends, with so many rows of each class."""
    used = np.flatnonzero(toxic + clean > 0)[::-1]
    x, hits, seen = logit[used], np.cumsum(toxic[used]), np.cumsum((toxic + clean)[used])
    f1 = 2 * hits / (seen + toxic.sum())
    after = np.append(x[1:], x[-1] - 1)
    gaps = np.where(f1 >= f1.max() - 1e-12, x - after, -1)
    k = int(gaps.argmax())
    return float((x[k] + after[k]) / 2)


def sampled(docs: DataFrame, known: DataFrame, sample: int, sample_bytes: int) -> DataFrame:
    """doc_id, lang, text, toxic, fold, mark of at most `sample` whole labelled documents of `sample_bytes` in all."""
    rows = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", _language(docs))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # The order's running bytes bound what a task holds; the sizes of `sample` rows are one small task.
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("mark")]
    marked = rows.join(F.broadcast(chosen), "doc_id").withColumns({"mark": F.xxhash64("text"), "bytes": F.octet_length("text").cast("long")}).where(F.col("bytes") <= sample_bytes)
    first = marked.select("doc_id", "mark", "bytes").orderBy(*order).limit(sample)
    fits = first.withColumn("so_far", F.sum("bytes").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("so_far") <= sample_bytes).select("doc_id", "mark").distinct()
    got = marked.join(F.broadcast(fits), ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])
    return got.select("doc_id", "lang", "text", F.col("toxic").cast("double").alias("toxic"), F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"), "mark")


def _language(docs: DataFrame) -> Column:
    return (F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")).alias("lang")


def cross_fit(got: DataFrame) -> tuple[ToxicityModel, DataFrame]:
    """The model of all sampled rows, and lang, toxic, logit of each row under a model that has not seen its fold.

    Every model is trained in a task of its own, which gets the sample, bounded as it is, in the order of ids' hashes; the last one leaves
    out nothing. Only that one model and counts of the logits reach the driver.
    """
    spark = got.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded, toxic, fold, lang, k = [], [], [], [], None
        for rows, data, starts in blocks(batches, "text"):
            coded += packed(data, starts)  # no text and no batch outlives its turn
            k = rows.column("k")[0].as_py()
            toxic += rows.column("toxic").to_pylist()
            fold += rows.column("fold").to_pylist()
            lang += rows.column("lang").to_pylist()
        if k is None:
            return
        rows = data = None
        pa.default_memory_pool().release_unused()
        out = [i for i, x in enumerate(fold) if x == k]
        inside = [i for i, x in enumerate(fold) if x != k]
        model = train_packed([coded[i] for i in inside], np.array([toxic[i] for i in inside]))
        if k == FOLDS:
            yield pa.RecordBatch.from_pydict({"lang": pa.array([None], pa.string()), "toxic": pa.array([None], pa.float64()), "logit": pa.array([None], pa.float64()), "model": pa.array([pickle.dumps(model)], pa.binary())})
            return
        logits = [float(model.answers(unpacked(coded[i]), np.array([0, len(coded[i])]))[0]) for i in out]
        yield pa.RecordBatch.from_arrays([pa.array([lang[i] for i in out], pa.string()), pa.array([toxic[i] for i in out], pa.float64()), pa.array(logits, pa.float64()), pa.nulls(len(out), pa.binary())], names=["lang", "toxic", "logit", "model"])

    each = got.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(FOLDS)))).repartitionById(FOLDS + 1, "k").sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "mark")
    made = cut(each.mapInArrow(run, "lang string, toxic double, logit double, model binary"))
    whole = made.where("model is not null").select("model").first()
    model = pickle.loads(whole[0]) if whole else train([], np.zeros(0))
    return model, made.where("model is null").drop("model")


def with_logits(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents with __logit, the network's answer before calibration."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, fixed by BUCKETS, STEMS and DIM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, starts in blocks(batches, "text"):
            yield append_columns(rows, __logit=pa.array(shared.value.score(data, starts).astype(np.float64)))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__logit", T.DoubleType())]))


def _known(labels: DataFrame, held_out: str | None) -> DataFrame:
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return known.where(~F.expr(held_out)) if held_out else known


def _calibrate(scored: DataFrame, known: DataFrame, got: DataFrame, model: ToxicityModel, apart: DataFrame) -> None:
    """Counts by language, bin and label: of the sample under models that have not seen the row, of all other labelled rows under the model itself."""
    if not model.output.any():
        return
    binned = lambda logit: F.floor(F.asinh(logit) * BINS).alias("bin")
    # Only ids, bins and languages meet the labels.
    others = scored.where("__read").select("doc_id", _language(scored), binned("__logit")).join(known.join(F.broadcast(got.select("doc_id").distinct()), "doc_id", "left_anti"), "doc_id")
    counts = others.select("lang", "bin", (F.col("toxic") > 0).alias("hit")).unionByName(apart.select("lang", binned("logit"), (F.col("toxic") > 0).alias("hit"))).groupBy("lang", "bin", "hit").agg(F.count("*").alias("n"))
    counts = cut(counts)
    most = counts.groupBy("lang").agg(F.sum("n").alias("rows")).orderBy(F.desc("rows"), "lang").limit(LANGUAGES).select("lang", F.lit(True).alias("own"))
    rows = counts.join(F.broadcast(most), "lang", "left").groupBy(F.when(F.col("own"), F.col("lang")).alias("lang"), "bin", "hit").agg(F.sum("n").alias("n")).collect()
    calibrate(model, [(r["lang"], r["bin"], r["n"] * r["hit"], r["n"] * (not r["hit"])) for r in rows])


def _decided(scored: DataFrame, model: ToxicityModel) -> DataFrame:
    """Probability and decision from __logit, the calibration being one slope, one offset and a short list of thresholds."""
    toxicity = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("__logit") * model.slope + model.offset))))
    own = {k: v for k, v in model.thresholds.items() if k}
    # From Arrow: a list of rows would start further Python workers on the executors.
    limits = scored.sparkSession.createDataFrame(pa.table({"__lang": pa.array(own.keys(), pa.string()), "threshold": pa.array(own.values(), pa.float64())}))
    joined = scored.withColumn("toxicity", toxicity).join(F.broadcast(limits), _language(scored) == F.col("__lang"), "left")
    limit = F.coalesce("threshold", F.lit(model.thresholds[""]))
    return joined.select(*(c for c in scored.columns if not c.startswith("__")), "toxicity", limit.alias("threshold"), (F.col("toxicity") >= limit).alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, held_out: str | None = None, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> ToxicityModel:
    """Trains on at most `sample` labelled documents and calibrates on all labelled ones; rows where `held_out` holds lend no label."""
    known = _known(labels, held_out)
    got = cut(sampled(docs, known, sample, sample_bytes))
    model, apart = cross_fit(got)
    _calibrate(with_logits(docs, model).select("doc_id", _language(docs), "__logit", F.col("text").isNotNull().alias("__read")), known, got, model, apart)
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents with toxicity (double, 0 to 1), threshold (their language's) and toxic (boolean: at or over it)."""
    return _decided(with_logits(docs.drop(*RESULT), model), model)


def classify(docs: DataFrame, labels: DataFrame, held_out: str | None = None, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, carry_text: bool = True) -> DataFrame:
    """fit and score in one: the network reads every text once. Its answers are written, with the texts only if carry_text says so; labelled ones calibrate."""
    docs, known = docs.drop(*RESULT), _known(labels, held_out)
    got = cut(sampled(docs, known, sample, sample_bytes))
    model, apart = cross_fit(got)
    scored = cut(with_logits(docs, model).select(*(c for c in docs.columns if carry_text or c != "text"), "__logit", F.col("text").isNotNull().alias("__read")))
    _calibrate(scored, known, got, model, apart)
    return _decided(scored, model)
