"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of labelled text. A text is parsed against it: from where the last phrase
ended, the longest match in the labelled text is the next phrase. A language that a text is written in needs few phrases;
phrases times the bits that a pointer into the labelled text takes, over the text's letters, estimate the cross entropy, and
the language with the least wins.

Where the automaton has no way on, a new phrase begins with the same letter; so the beginnings of phrases are written
into the automaton's table, and parsing is one lookup a letter. Texts are cut into spans of SPAN letters, whose phrases are counted
each from its start, and numpy takes all spans of a batch a letter further at a time: whole texts of any length, no loop
over letters in Python, one pass over the table without a shuffle.

What is fitted on is bounded: whole documents in order of a hash, LETTERS letters of all languages together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import held_out, slices

#: Letters of all languages together that are fitted on, at most, and of one language; its rows that are looked at, the first
#: in each of PARTS parts of its hashes.
LETTERS, OWN, ROWS, PARTS = 400_000, 60_000, 2048, 64
#: Letters of a span.
SPAN = 256
#: Letters that a worker parses together, about.
TOGETHER = 1 << 19
UNKNOWN = "und"


def letters_of(text: Column) -> Column:
    """The text in lower case, a blank for each run of other characters than letters and their marks."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))


class Automaton:
    """The suffix automaton of a sequence of codes below `kinds`, of which 0 stands between texts and matches nothing.

    table[state * kinds + code] is twice the next state, plus one where a phrase begins with the code: at the start, after a
    code that matches nothing, and where the automaton has no way on.
    """

    def __init__(self, codes: np.ndarray, kinds: int):
        ways: list[dict[int, int]] = [{}]
        link, longest, last = [-1], [0], 0

        def twin_of(p: int, code: int, q: int) -> int:
            """A state for the matches of q that are no longer than p's and the code; q keeps the longer ones."""
            twin = len(ways)
            ways.append(dict(ways[q]))
            longest.append(longest[p] + 1)
            link.append(link[q])
            link[q] = twin
            while p >= 0 and ways[p].get(code) == q:
                ways[p][code] = twin
                p = link[p]
            return twin

        for code in codes.tolist():
            if not code:
                last = 0
            elif code in ways[last]:  # an earlier text has this as well
                q = ways[last][code]
                last = q if longest[q] == longest[last] + 1 else twin_of(last, code, q)
            else:
                now, p = len(ways), last
                ways.append({})
                longest.append(longest[last] + 1)
                link.append(0)
                while p >= 0 and code not in ways[p]:
                    ways[p][code] = now
                    p = link[p]
                if p >= 0:
                    q = ways[p][code]
                    link[now] = q if longest[q] == longest[p] + 1 else twin_of(p, code, q)
                last = now
        self.states = len(ways)
        start = np.zeros(kinds, dtype=np.int32)
        for code, to in ways[0].items():
            start[code] = to
        table = np.tile(2 * start + 1, (self.states, 1))
        for state, own in enumerate(ways[1:], 1):
            for code, to in own.items():
                table[state, code] = 2 * to
        self.table, self.kinds = table.ravel().astype(np.int32), kinds

    def phrases(self, spans: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The phrases of each span; spans holds their codes, a column a letter, in falling order of size."""
        state = np.zeros(len(sizes), dtype=np.int64)
        begun = np.zeros(len(sizes), dtype=np.int64)
        for i in range(spans.shape[0]):
            n = int(np.searchsorted(-sizes, -i, "left"))  # spans longer than i
            step = self.table[state[:n] * self.kinds + spans[i, :n]]
            begun[:n] += step & 1
            state[:n] = step >> 1
        return begun


@dataclass
class Model:
    """Of each language its automaton and the bits of a pointer into its text; the code of each known character."""

    names: list[str]
    automata: list[Automaton]
    bits: list[float]
    known: np.ndarray

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Bits a letter that each text (as letters_of gives it, not empty) takes by each language."""
        out = np.zeros((len(texts), len(self.names)))
        parts, of, size = [], [], 0
        for i, text in enumerate(texts):
            for at in range(0, len(text), TOGETHER):  # a multiple of SPAN
                parts.append(text[at : at + TOGETHER])
                of.append(i)
                size += len(parts[-1])
                if size >= TOGETHER:
                    np.add.at(out, of, self._phrases(parts))
                    parts, of, size = [], [], 0
        if parts:
            np.add.at(out, of, self._phrases(parts))
        return out * np.array(self.bits) / np.array([[max(len(t), 1)] for t in texts])

    def _phrases(self, texts: list[str]) -> np.ndarray:
        """The phrases of each text by each language, its spans side by side."""
        out = np.zeros((len(texts), len(self.names)))
        codes = [code(t, self.known) for t in texts]
        sizes = np.array([len(c) for c in codes])
        counts = -(-sizes // SPAN)
        of = np.repeat(np.arange(len(texts)), counts)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        own = np.minimum(sizes[of] - nth * SPAN, SPAN)
        order = np.argsort(-own, kind="stable")
        grid = np.zeros((len(of), SPAN), dtype=np.int64)
        flat = np.concatenate(codes)
        at = np.repeat(np.arange(len(of)) * SPAN, own) + np.arange(len(flat)) - np.repeat(np.cumsum(own) - own, own)
        grid.ravel()[at] = flat
        spans = np.ascontiguousarray(grid[order].T)
        for k, automaton in enumerate(self.automata):
            out[:, k] = np.bincount(of[order], automaton.phrases(spans, own[order]), len(texts))
        return out


def code(text: str, known: np.ndarray) -> np.ndarray:
    """The codes of a text's characters; 0 for those that no language has."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at = np.searchsorted(known, points)
    return np.where(known[np.minimum(at, len(known) - 1)] == points, at + 1, 0) if len(known) else np.zeros(len(points), dtype=np.int64)


def fit(texts: dict[str, list[str]]) -> Model:
    """The model of some texts (as letters_of gives them) per language; languages without a letter are left out."""
    texts = {name: [t for t in own if t] for name, own in sorted(texts.items())}
    texts = {name: own for name, own in texts.items() if own}
    points = {p for own in texts.values() for t in own for p in map(ord, t)}
    known = np.array(sorted(points), dtype=np.uint32)
    automata, bits = [], []
    for own in texts.values():
        codes = [np.append(code(t, known), 0) for t in own]
        automata.append(Automaton(np.concatenate(codes), len(known) + 1))
        bits.append(math.log2(sum(map(len, codes)) + 1))
    return Model(list(texts), automata, bits, known)


def train(docs: DataFrame, letters: int = LETTERS) -> Model:
    """Fit on whole texts of documents that are not held out and have a lang: of each language those first by a hash of
    the id (of ROWS that are no longer than its share of `letters`, OWN at most) until the share is used up. The rows are
    chosen by their sizes, and only the texts of those chosen leave their tasks.

    The bound is on what reaches the driver, 4 bytes a letter, and on the automata, 2 states a letter at most.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    names = [r[0] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(letters // 1000).collect()]
    if not names:
        return fit({})
    share = min(letters // len(names), OWN)
    sized = rows.select("lang", "doc_id", F.length(letters_of(F.col("text"))).alias("size"), F.xxhash64("doc_id").alias("h"))
    sized = sized.filter(F.col("lang").isin(names) & (F.col("size") > 0) & (F.col("size") <= share))
    part = F.pmod("h", F.lit(PARTS))
    first = sized.withColumn("k", F.row_number().over(Window.partitionBy("lang", part).orderBy("h", "doc_id", "size"))).filter(F.col("k") <= ROWS // PARTS)
    used = F.sum("size").over(Window.partitionBy("lang").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    ids = first.withColumn("used", used).filter(F.col("used") <= share).select("lang", "doc_id").distinct()  # ROWS of a language at most
    found = rows.join(F.broadcast(ids), ["lang", "doc_id"], "left_semi").select("lang", letters_of(F.col("text")).alias("own"), F.xxhash64("doc_id").alias("h"))
    texts: dict[str, list[str]] = {}
    for lang, own, _ in found.filter(F.length("own") <= share).orderBy("lang", "h", "own").limit(ROWS * len(names)).collect():
        if sum(map(len, texts.setdefault(lang, []))) + len(own) <= share:  # rows may repeat an id
            texts[lang].append(own)
    return fit(texts)


def _told(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the number of the language that wins, the first of equals, and by how much of the runner-up's bits."""
    bits = model.entropies(texts)
    best = bits.argmin(axis=1)
    two = np.sort(bits, axis=1)[:, :2]
    return best, 1 - two[:, 0] / two[:, 1] if two.shape[1] > 1 else np.ones(len(texts))


def _predicted(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            chosen = [i for i, t in enumerate(texts) if t and model.names]
            if chosen:
                best, scores[chosen] = _told(model, [texts[i] for i in chosen])
                for i, b in zip(chosen, best, strict=True):
                    langs[i] = model.names[b]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of docs; score is 1 - bits of the winner / bits of the runner-up.

    Defined cases: a null text, one without a letter, and any text where nothing was learned is `und` with score 0; with
    one language learned its score is 1; of equal languages the first by name wins; of a text of any length every letter
    counts; an empty table gives an empty result; repeated rows are told each; a null doc_id is not held out; other
    columns of docs are ignored.
    """
    has = F.rlike(F.col("text"), F.lit(r"\p{L}"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(has, letters_of(F.col("text"))).alias("own"))
    rows = rows.mapInArrow(_predicted(model), "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return languages(docs, train(docs))
