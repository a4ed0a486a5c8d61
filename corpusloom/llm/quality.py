"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of PASSAGE words. Each passage is encoded from its own characters and words, and from what
it repeats of earlier ones; nothing is told of a document but through its passages. Gated
attention (a tanh and a sigmoid layer, multiplied) weighs the passages, and the weighted sum of their representations is
scored. Only documents are labelled, so the attention learns by itself which passages tell.

Fitting is numpy on a bounded sample of labelled documents, drawn by hash; every whole text is then scored in one pass
over the table, without a shuffle. A passage's character counts come from one bincount over the text's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import held_out, slices

#: Words of a passage.
PASSAGE = 100
#: Labelled documents that are fitted on, at most.
SAMPLE = 3000
#: Passages of a document that are fitted on, at most, and passages that are scored together, about.
PASSAGES, TOGETHER = 256, 4096
THRESHOLD = 0.5
HIDDEN, GATE = 24, 12
ROUNDS, RATE, DECAY = 300, 0.01, 1e-3

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",", b"!", b"?", b"|", b"#*$%&", b"<>{}[]()=/\\;:@_~^+", b"'\"-"]
_CLASS = np.full(256, len(_CLASSES), dtype=np.int64)
_CLASS[128:192], _CLASS[192:] = len(_CLASSES) + 1, len(_CLASSES) + 2
for _i, _chars in enumerate(_CLASSES):
    _CLASS[list(_chars)] = _i
_N = len(_CLASSES) + 3
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
#: Class shares, then word statistics of the passage, then shares of words by the bucket of their hash.
WORDS = 32
FEATURES = _N + 10 + WORDS


def encode(text: str | None) -> np.ndarray:
    """The passages of a text as rows of FEATURES; a text without words is one passage of zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, dtype=np.uint8)
    space = _SPACE[data]
    start = np.flatnonzero(~space & np.concatenate(([True], space[:-1]))) if len(data) else np.empty(0, np.int64)
    n = len(start)
    if not n:
        return np.zeros((1, FEATURES))
    passages = -(-n // PASSAGE)
    edge = start[::PASSAGE].copy()
    edge[0] = 0
    of = np.repeat(np.arange(passages), np.diff(np.append(edge, len(data))))
    counts = np.bincount(of * _N + _CLASS[data], minlength=passages * _N).reshape(passages, _N).astype(float)
    total = counts.sum(axis=1, keepdims=True)
    words = raw.split()
    own = np.fromiter(map(xxhash.xxh32_intdigest, words), dtype=np.int64, count=n)
    size = np.fromiter(map(len, words), dtype=np.float64, count=n)
    at = np.arange(n) // PASSAGE
    per = np.bincount(at, minlength=passages).astype(float)
    mean = np.bincount(at, size, passages) / per
    spread = np.sqrt(np.maximum(np.bincount(at, size * size, passages) / per - mean * mean, 0))
    keyed = np.unique(at * (1 << 32) + own)
    distinct = np.bincount(keyed >> 32, minlength=passages) / per
    again = np.zeros(n)
    again[1:] = own[1:] == own[:-1]
    last = data[np.append(start[1:], len(data) + 1) - 2].astype(np.int64) if n > 1 else data[-1:].astype(np.int64)
    first = data[start]
    upper = (first >= 65) & (first <= 90)
    one = size == 1

    def share(x: np.ndarray) -> np.ndarray:
        return np.bincount(at, x.astype(float), passages) / per

    words_of_lines = np.log1p(per / (1 + counts[:, 4]))
    stats = [mean / 10, spread / 10, distinct, share(again), share(upper), share(one), words_of_lines, np.log1p(per) / 5, share(_CLASS[last] == 5)]
    hashed = np.bincount(at * WORDS + own % WORDS, minlength=passages * WORDS).reshape(passages, WORDS) / per[:, None]
    # Words of the passage that an earlier one has as well: what repeats across passages, seen from each.
    ids = np.unique(own, return_inverse=True)[1]
    earliest = np.full(ids.max() + 1, n, dtype=np.int64)
    np.minimum.at(earliest, ids, at)
    return np.column_stack([counts / total, *stats, share(earliest[ids] < at), hashed])


@dataclass
class Model:
    """Weights of the encoder layer, the gated attention and the score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def score(self, rows: np.ndarray, bags: np.ndarray) -> np.ndarray:
        """rows: the passages of all bags, one after the other; bags: the first row of each."""
        return _forward(self.weights, (rows - self.mean) / self.scale, bags)[-1]


def _forward(weights: list[np.ndarray], x: np.ndarray, bags: np.ndarray) -> tuple:
    w1, b1, v, u, a, c, d = weights
    h = np.tanh(x @ w1 + b1)
    tv, su = np.tanh(h @ v), 1 / (1 + np.exp(-np.clip(h @ u, -30, 30)))
    e = (tv * su) @ a
    of = np.repeat(np.arange(len(bags)), np.diff(np.append(bags, len(x))))
    e = np.exp(e - np.maximum.reduceat(e, bags)[of])
    att = e / np.add.reduceat(e, bags)[of]
    z = np.add.reduceat(att[:, None] * h, bags)
    p = 1 / (1 + np.exp(-np.clip(z @ c + d[0], -30, 30)))
    return h, tv, su, att, of, z, p


def gradients(weights: list[np.ndarray], x: np.ndarray, bags: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """The gradient of the mean logistic loss by each of the weights."""
    _, _, v, u, a, c, _ = weights
    h, tv, su, att, of, z, p = _forward(weights, x, bags)
    g = (p - y) / len(y)
    gz = g[:, None] * c
    gh = att[:, None] * gz[of]
    ga = (gz[of] * h).sum(axis=1)
    ge = att * (ga - np.add.reduceat(att * ga, bags)[of])
    gv, gu = ge[:, None] * a * su * (1 - tv**2), ge[:, None] * a * tv * su * (1 - su)
    gh += gv @ v.T + gu @ u.T
    gh *= 1 - h**2
    return [x.T @ gh, gh.sum(axis=0), h.T @ gv, h.T @ gu, (tv * su).T @ ge, z.T @ g, np.array([g.sum()])]


def fit(texts: list[np.ndarray], labels: np.ndarray, seed: int = 1) -> Model:
    """Fit by Adam on all bags at once, from a fixed start; without both labels the score is the share of ones."""
    if not len(texts):
        texts, labels = [np.zeros((1, FEATURES))], np.array([0.5])
    rows = np.concatenate(texts)
    bags = np.cumsum([0, *(len(t) for t in texts[:-1])])
    mean, scale = rows.mean(axis=0), rows.std(axis=0)
    scale = np.where(scale > 1e-6, scale, 1.0)
    x, y = ((rows - mean) / scale).astype(np.float32), labels.astype(np.float32)
    rng = np.random.default_rng(seed)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    weights = [
        rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), rng.normal(0, GATE**-0.5, GATE), np.zeros(HIDDEN), np.array([np.log(share / (1 - share))]),
    ]
    weights = [w.astype(np.float32) for w in weights]
    if y.min() == y.max() and len(y):
        return Model(mean, scale, weights)
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for t in range(1, ROUNDS + 1):
        for i, gradient in enumerate(gradients(weights, x, bags, y)):
            first[i] = 0.9 * first[i] + 0.1 * gradient
            second[i] = 0.999 * second[i] + 0.001 * gradient**2
            step = first[i] / (1 - 0.9**t) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
            weights[i] = (weights[i] - RATE * (step + DECAY * weights[i] * (weights[i].ndim == 2))).astype(np.float32)
    return Model(mean, scale, weights)


def part(rows: np.ndarray, most: int = PASSAGES) -> np.ndarray:
    """At most so many passages, evenly spread over the text: what a long text brings into the fit."""
    return rows if len(rows) <= most else rows[np.linspace(0, len(rows) - 1, most).astype(int)]


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [part(encode(t)).astype("<f4").tobytes() for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["doc_id", "y", "rows"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the labels of at most `sample` documents that are not held out, those first by hash of their ids.

    Conflicting labels of a document count by their mean. Rows that repeat an id are documents of their own, and the
    first `sample` rows count; a text longer than PASSAGES passages is fitted on so many of them. So the broadcast, and
    what reaches the driver (4 * FEATURES * PASSAGES bytes a row at most), do not depend on the tables.
    """
    seen = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isNotNull())
    seen = seen.groupBy("doc_id").agg(F.avg("quality").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    bags = docs.select("doc_id", "text").join(F.broadcast(seen), "doc_id").select("doc_id", "y", "text")
    bags = bags.mapInArrow(_encoded, "doc_id long, y double, rows binary").orderBy(F.xxhash64("doc_id"), "doc_id", "rows").limit(sample)
    found = sorted((r[0], r[1], bytes(r[2])) for r in bags.collect())
    return fit([np.frombuffer(r, dtype="<f4").reshape(-1, FEATURES).astype(float) for _, _, r in found], np.array([y for _, y, _ in found]))


def scores_of(model: Model, texts: list[str | None]) -> np.ndarray:
    """The scores of whole texts, some thousand passages at a time."""
    out, bags = [], []
    for i, t in enumerate(texts):
        bags.append(encode(t))
        if i + 1 == len(texts) or sum(map(len, bags[-64:])) >= TOGETHER or len(bags) == 64:
            out.append(model.score(np.concatenate(bags), np.cumsum([0, *map(len, bags[:-1])])))
            bags = []
    return np.concatenate(out) if out else np.empty(0)


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = scores_of(model, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from THRESHOLD on) for every row of docs.

    Defined cases: a null text and one without words score as a passage of zeros; of a text of any length every passage
    counts; an empty table gives an empty result;
    repeated rows are scored each; a null doc_id is not held out; other columns of docs are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(model), "doc_id long, score double")
    return rows.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that the model does not reject."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[c for c in docs.columns if c != "text"], "text").schema)
    ordered = docs.select(*[c for c in docs.columns if c != "text"], "text")
    return ordered.mapInArrow(_kept(model), kinds).select(*docs.columns)


def _kept(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            yield batch.filter(pa.array(scores_of(model, texts) >= THRESHOLD, pa.bool_()))

    return run


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality(docs, train(docs, labels))
