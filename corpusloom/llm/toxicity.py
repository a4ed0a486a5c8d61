"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; everything else the learner sees is unlabelled text, toxic documents among
it. With the class prior p the risk of calling unlabelled text negative is corrected for the positives it holds:
risk = p * R_pos(+) + max(0, R_unl(-) - p * R_pos(-)). Where the bracket falls below zero the model has begun to fit
the unlabelled text, and the step goes the other way.

The classifier is linear over the distinct words of a text: a word counts by itself and by its beginnings, as insults are
inflected. Only words and beginnings take part that the positives hold several times as often as all texts that may be
seen do; that frequency is counted over all these texts.

Labelled rows are bounded (POSITIVES, drawn by hash), unlabelled ones are not: every unlabelled text is encoded once as the
features it holds, a table of a few numbers a row. The weights, at most FEATURES of them, start from a fit in numpy on the
positives and some of these rows, and then take STEPS steps by the risk over all of them, whose gradient is summed by an
aggregate. Every whole text is then scored in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, held_out, slices

#: Positive documents at most, and the weights of the model at most.
POSITIVES, FEATURES = 2500, 5000
#: Encoded unlabelled rows that the weights start from, at most, and the steps that they then take by the risk over all.
START, STEPS = 5000, 16
#: A feature occurs in so many positives at least, in that share of them, and so many times as often as in all texts.
LEAST, SHARE, LIFT = 3, 0.02, 4.0
#: Features of the positives whose frequency in all texts is counted, at most, the commonest.
CANDIDATES = 50_000
#: Bytes of the beginnings of a word.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
THRESHOLD = 0.7
ROUNDS, RATE, RIDGE = 600, 0.05, 2e-5
#: Words whose score a worker remembers.
CACHED = 200_000
_TOKEN = re.compile(rb"[a-z\x80-\xff]+")


def words_of(text: str | None) -> set[bytes]:
    """The distinct words of a text: runs of letters in lower case."""
    return set(_TOKEN.findall((text or "").lower().encode("utf-8", "surrogatepass")))


def features_of(word: bytes) -> list[bytes]:
    """The word, marked as whole, and its beginnings."""
    return [word + b"=", *(word[:n] for n in BEGINNINGS if n <= len(word))]


@dataclass
class Model:
    weights: dict[bytes, float]
    bias: float
    known: dict[bytes, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        known, words = self.known, words_of(text)
        if len(known) > CACHED:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = sum(self.weights.get(x, 0.0) for x in features_of(w))
        f = self.bias + math.fsum(known[w] for w in words)
        return 1 / (1 + math.exp(-min(max(f, -30.0), 30.0)))


def _loss(f: np.ndarray, sign: int) -> tuple[float, np.ndarray]:
    """Mean logistic loss of calling f's texts sign, and its gradient by f."""
    z = np.clip(-sign * f, -30, 30)
    n = max(len(f), 1)
    return float(np.log1p(np.exp(z)).sum() / n), -sign / (1 + np.exp(-z)) / n


def risk(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk of scores for positives and unlabelled texts, and the step's direction by either.

    Where the correction has gone below zero the direction undoes the fit to the unlabelled texts.
    """
    (l_pos, g_pos), (l_neg, g_neg), (l_unl, g_unl) = _loss(fp, 1), _loss(fp, -1), _loss(fu, -1)
    rest = l_unl - prior * l_neg
    if rest >= 0:
        return prior * l_pos + rest, prior * (g_pos - g_neg), g_unl
    return prior * l_pos, prior * g_neg, -g_unl


def chosen_features(held: dict[bytes, int], positives: int, frequency: dict[bytes, float]) -> list[bytes]:
    """The features that enough of the positives hold, and several times as often as all texts: the FEATURES of most lift."""
    lift = {}
    for x, n in held.items():
        p, u = n / positives, frequency.get(x, 0.0)
        if n >= max(LEAST, SHARE * positives) and p > LIFT * u:
            lift[x] = p - u
    return sorted(lift, key=lambda x: (-lift[x], x))[:FEATURES]


class Rows:
    """Texts as the features that they hold: for each entry its row and its feature."""

    def __init__(self, features: list[np.ndarray]):
        self.n = len(features)
        self.row = np.repeat(np.arange(self.n), [len(x) for x in features])
        self.of = np.concatenate([*features, np.empty(0)]).astype(np.int64)

    def score(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.of], self.n) + w[-1]

    def gradient(self, g: np.ndarray, size: int) -> np.ndarray:
        """By each weight and the bias, from the gradient by each row's score."""
        return np.append(np.bincount(self.of, g[self.row], size), g.sum())


class Adam:
    """Steps of the optimizer; ridge pulls all weights but the bias to zero."""

    def __init__(self, size: int):
        self.first, self.second, self.t = np.zeros(size), np.zeros(size), 0

    def step(self, w: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        gradient[:-1] += RIDGE * w[:-1]
        self.t += 1
        self.first, self.second = 0.9 * self.first + 0.1 * gradient, 0.999 * self.second + 0.001 * gradient**2
        return w - RATE * (self.first / (1 - 0.9**self.t)) / (np.sqrt(self.second / (1 - 0.999**self.t)) + 1e-8)


def start(positive: Rows, unlabelled: Rows, prior: float, size: int) -> tuple[np.ndarray, Adam]:
    """Weights and bias by the risk over rows in memory."""
    w, adam = np.zeros(size + 1), Adam(size + 1)
    w[-1] = math.log(prior / (1 - prior))
    for _ in range(ROUNDS):
        _, gp, gu = risk(positive.score(w), unlabelled.score(w), prior)
        w = adam.step(w, positive.gradient(gp, size) + unlabelled.gradient(gu, size))
    return w, adam


def refine(w: np.ndarray, adam: Adam, positive: Rows, unlabelled: DataFrame, prior: float, steps: int = STEPS) -> np.ndarray:
    """The weights after some steps by the risk over the table of all unlabelled rows (features).

    A step is one job: each task sums the losses of its rows and their gradient, and an aggregate adds them up by weight.
    """
    size = len(w) - 1
    for _ in range(steps):
        sums = unlabelled.mapInArrow(_losses(w), "i long, x double").groupBy("i").agg(F.sum("x").alias("x"))
        x = np.zeros(size + 3)
        for i, own in sums.collect():  # a number a weight
            x[i] = own
        n = max(x[-1], 1.0)
        fp = positive.score(w)
        (l_pos, g_pos), (l_neg, g_neg) = _loss(fp, 1), _loss(fp, -1)
        whole = x[: size + 1] / n
        if x[-2] / n - prior * l_neg >= 0:
            gradient = positive.gradient(prior * (g_pos - g_neg), size) + whole
        else:
            gradient = positive.gradient(prior * g_neg, size) - whole
        w = adam.step(w, gradient)
    return w


def _losses(w: np.ndarray):
    """Sums over a task's rows: the gradient of the loss of calling them negative by weight and bias, that loss, the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.zeros(len(w) + 2)
        for batch in batches:
            rows = Rows([np.frombuffer(r, dtype="<u2") for r in batch.column(0).to_pylist()])
            if rows.n:
                loss, g = _loss(rows.score(w), -1)  # means
                x += np.concatenate((rows.gradient(g, len(w) - 1), [loss, 1.0])) * rows.n
        own = np.flatnonzero(x)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(x[own])], ["i", "x"])

    return run


def fit(positive: list[set[bytes]], unlabelled: list[set[bytes]], prior: float) -> Model:
    """The classifier of word sets in memory; without positives every text scores the prior."""
    prior = min(max(prior, 1e-3), 0.9)
    held = Counter(x for s in positive for x in {x for w in s for x in features_of(w)})
    seen = Counter(x for s in unlabelled for x in {x for w in s for x in features_of(w)})
    names = chosen_features(held, len(positive), {x: seen[x] / len(unlabelled) for x in held}) if positive and unlabelled else []
    place = {x: i for i, x in enumerate(names)}
    rows = [Rows([np.array([place[x] for w in sorted(s) for x in features_of(w) if x in place]) for s in sets]) for sets in (positive, unlabelled)]
    return _model(names, start(*rows, prior, len(names))[0] if names else None, prior)


def _model(names: list[bytes], w: np.ndarray | None, prior: float) -> Model:
    if w is None:
        return Model({}, math.log(prior / (1 - prior)))
    return Model(dict(zip(names, w[:-1].tolist(), strict=True)), float(w[-1]))


def _encoded(names: list[bytes]):
    """The id of each text and the places of the features that it holds; a feature counts for each of its words."""
    place = {x: i for i, x in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, ...]] = {}
        for batch in slices(batches):
            out = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                if len(known) > CACHED:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = tuple(place[x] for x in features_of(w) if x in place)
                out.append(np.array(sorted(i for w in words for i in known[w]), dtype="<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "features"])

    return run


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and how many of a task's texts hold them; the empty one stands for all texts."""
    held: Counter = Counter()
    for batch in slices(batches, 50):
        for text in batch.column(0).to_pylist():
            held.update({x for w in words_of(text) for x in features_of(w)})
            held[b""] += 1
        if len(held) > CACHED:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["feature", "n"])
            held.clear()
    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["feature", "n"])


def train(docs: DataFrame, labels: DataFrame, steps: int = STEPS) -> Model:
    """Fit on rows that are not held out: confirmed toxic documents, and all documents without any label.

    The prior is the share of toxic rows among all labels that may be seen, and how often a feature occurs is counted over
    all documents that may be seen. Of the toxic documents POSITIVES ids count, those first by hash; their rows are
    documents of their own, and all their words count. Where every document has a label, all that may be seen serve as
    unlabelled text.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    seen = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    total, toxic = seen.agg(F.count(F.lit(1)), F.sum(F.col("toxic").cast("long"))).first()
    prior = min(max((toxic or 0) / total if total else 0.0, 1e-3), 0.9)
    ids = seen.filter("toxic = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(POSITIVES)
    ids = scratch.write(ids, "positives", tasks=1)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    positive = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("text")
    held = positive.mapInArrow(_holders, "feature binary, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    held = held.filter(F.col("n") >= LEAST).orderBy(F.desc("n"), "feature").limit(CANDIDATES + 1)
    held = {bytes(x): n for x, n in held.collect()}
    rows = held.pop(b"", 0)
    common = {x: n for x, n in held.items() if n >= SHARE * rows}
    names = chosen_features(common, rows, _frequency(docs, sorted(common))) if rows else []
    if not names:
        return _model([], None, prior)
    own = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    table = scratch.write(own.mapInArrow(_encoded(names), "doc_id long, features binary"), "encoded")
    known = Rows([np.frombuffer(r[0], dtype="<u2") for r in table.join(F.broadcast(ids), "doc_id", "left_semi").select("features").orderBy("features").collect()])
    free = scratch.write(table.join(labels.select("doc_id"), "doc_id", "left_anti"), "unlabelled")
    if free.isEmpty():
        free = table.join(seen.select("doc_id"), "doc_id", "left_semi")
    some = free.orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(START).select("features").collect()
    w, adam = start(known, Rows([np.frombuffer(r[0], dtype="<u2") for r in some]), prior, len(names))
    return _model(names, refine(w, adam, known, free.select("features"), prior, steps), prior)


def _counted(wanted: list[bytes]):
    place = {x: i for i, x in enumerate(wanted)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, ...]] = {}
        counts, rows = np.zeros(len(wanted), dtype=np.int64), 0
        for batch in slices(batches):
            found: list[int] = []
            for t in batch.column(0).to_pylist():
                words = words_of(t)
                if len(known) > CACHED:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = tuple(place[x] for x in features_of(w) if x in place)
                found += {i for w in words for i in known[w]}
            rows += batch.num_rows
            counts += np.bincount(np.array(found, dtype=np.int64), minlength=len(wanted))
        some = np.append(np.flatnonzero(counts), len(wanted))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.append(counts, rows)[some])], ["feature", "n"])

    return run


def _frequency(docs: DataFrame, wanted: list[bytes]) -> dict[bytes, float]:
    """The share of all documents that are not held out which hold each of the features: a count a feature comes back."""
    texts = docs.filter(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))).select("text")
    counts = texts.mapInArrow(_counted(wanted), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    n = {r[0]: r[1] for r in counts.collect()}
    rows = n.pop(len(wanted), 0)
    return {wanted[i]: k / rows for i, k in n.items()}


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = [model.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from THRESHOLD on) for every row of docs.

    Defined cases: a null or empty text scores as one without words; of a text of any length all words count; an empty table gives an empty result; repeated
    rows are scored each; a null doc_id is not held out; other columns of docs are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(model), "doc_id long, score double")
    return rows.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity(docs, train(docs, labels))
