"""Which language a text is in, by character trigrams: naive Bayes fitted on labelled documents.

Trigrams are counted in the tasks and added up by Spark; the model is the KEPT commonest of them with their logarithmic shares
in each language, add-one smoothed. Texts are told in Arrow batches, some rows at a time; their trigrams are numbers, which
numpy counts, and a text of any length is one row of counts.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trigrams of a model, and distinct ones that a task counts before it hands them on, about.
KEPT, GATHERED = 2000, 200_000
#: Rows that a worker holds at a time, and characters of them, about.
ROWS, CHARS = 200, 1_000_000
#: Sums as near as this, of their size, are made again without rounding.
NEAR = 1e-9


def plain(text: Column) -> Column:
    """The text in lower case, one blank for all that is no letter, and at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")), F.lit(" "))


def numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of plain texts as numbers, in order, and the text that each is of; none without a letter."""
    own = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    of, end = np.repeat(np.arange(len(texts)), size), np.repeat(np.cumsum(size), size)
    at = np.flatnonzero(np.arange(len(own)) + 2 < end)
    return own[at] << 42 | own[np.minimum(at + 1, len(own) - 1)] << 21 | own[np.minimum(at + 2, len(own) - 1)], of[at]


def number(gram: str) -> int:
    return ord(gram[0]) << 42 | ord(gram[1]) << 21 | ord(gram[2])


def spelled(number: int) -> str:
    return chr(number >> 42) + chr(number >> 21 & 0x1FFFFF) + chr(number & 0x1FFFFF)


def _short(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, as lists of few rows and characters."""
    first = size = 0
    for i, text in enumerate(texts):
        if i > first and (i - first == ROWS or size + len(text) > CHARS):
            yield texts[first:i]
            first, size = i, 0
        size += len(text)
    yield texts[first:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = defaultdict(Counter)

    def out() -> pa.RecordBatch:
        rows = [(lang, spelled(gram), n) for lang, own in counts.items() for gram, n in own.items()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "gram", "n"])

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            texts: dict[str, list[str]] = defaultdict(list)
            for lang, text in zip(*(c.slice(at, ROWS).to_pylist() for c in batch.columns), strict=True):
                texts[lang].append(text)
            for lang, every in texts.items():
                for few in _short(every):
                    grams, n = np.unique(numbered(few)[0], return_counts=True)
                    counts[lang].update(dict(zip(grams.tolist(), n.tolist(), strict=True)))
            if sum(map(len, counts.values())) > GATHERED:
                yield out()
    yield out()


@dataclass
class Model:
    """The languages in order, and for each trigram the logarithm of its share in each."""

    names: list[str]
    shares: dict[str, tuple[float, ...]]

    @cached_property
    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        """The trigrams as numbers, in order, and their logarithms."""
        grams = sorted((number(g), s) for g, s in self.shares.items())
        return np.array([g for g, _ in grams], dtype=np.int64), np.array([s for _, s in grams]).reshape(len(grams), len(self.names))

    def tell(self, texts: list[str]) -> list[str | None]:
        """The likeliest language of each plain text, the first of equals; None if it has none of the trigrams."""
        known, shares = self._table
        if not len(known):
            return [None] * len(texts)
        grams, of = numbered(texts)
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        found = known[at] == grams
        counts = np.bincount(of[found] * len(known) + at[found], minlength=len(texts) * len(known)).reshape(len(texts), len(known))
        sums = counts @ shares
        best = sums.argmax(axis=1)
        none = ~counts.any(axis=1)
        near = sums >= np.take_along_axis(sums, best[:, None], axis=1) * (1 + NEAR)  # sums are below zero
        for i in np.flatnonzero((near.sum(axis=1) > 1) & ~none):
            own = np.flatnonzero(counts[i])
            exact = [math.fsum((counts[i, own] * shares[own, k]).tolist()) for k in range(len(self.names))]
            best[i] = exact.index(max(exact))
        return [None if empty else self.names[k] for k, empty in zip(best.tolist(), none.tolist(), strict=True)]

    def language(self, text: Column) -> Column:
        tell = self.tell

        @F.arrow_udf("string")
        def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                for at in range(0, max(len(batch), 1), ROWS):
                    yield pa.array([x for few in _short(batch.slice(at, ROWS).to_pylist()) for x in tell(few)], pa.string())

        return told(plain(text))

    def is_language(self, text: Column, lang: str) -> Column:
        """Whether a text is in a language; one that tells none passes."""
        return F.coalesce(self.language(text) == lang, F.lit(True))


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", kept: int = KEPT) -> Model:
    """The model of labelled documents; rows without a label are left out. What reaches the driver is kept trigrams by language."""
    counts = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string"), plain(F.col(text))).mapInArrow(_counted, "lang string, gram string, n long")
    counts = counts.groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    cells = counts.groupBy("gram").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    found = cells.orderBy(F.desc("all"), "gram").limit(kept).collect()
    names = sorted({x for r in found for x in r.by})
    totals = {x: sum(r.by.get(x, 0) for r in found) + len(found) for x in names}
    return Model(names, {r.gram: tuple(math.log((r.by.get(x, 0) + 1) / totals[x]) for x in names) for r in found})
