"""Best-fit packing into sequences: a configuration linear program over the length histogram.

Documents become token pieces in one pass over the table; only piece lengths, of which there are at most 4096, reach the
driver, as counts. Lengths are grouped, each group counted by its longest; short ones are one fluid group. The linear
program over patterns (which groups share a sequence) is solved by multiplicative weights: a group that is behind in its
coverage gains price, and knapsack dynamic programming finds the pattern of largest price. The solution is rounded by
largest remainders, exact lengths are put into its places, and what has no place goes by best fit into the room that
grouping and rounding have left. All of that works on counts, so its time does not depend on the number of pieces.

The plan says, by length and rank in that length, which sequence a piece goes to; ranks come from windows over salted
buckets, so that no length, however common, meets in one task.
"""

from __future__ import annotations

import math
import os
import re
import sys
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, slices

CAPACITY = 4096
#: Id that ends each document.
END = 1
#: Units of room that the linear program counts in, its groups of lengths, and the rounds of the multiplicative weights.
UNITS, GROUPS, ROUNDS = 512, 128, 1500
#: Lengths of up to that part of a sequence are fluid.
FLUID = 16
#: Pieces in a bucket that is ranked on its own, about.
BUCKET = 128
#: Buckets whose sizes are summed together.
SPAN = 1024
#: Words whose ids a worker remembers, twice: when so many are known, they make room and stay only while they are asked for.
CACHED = 100_000

_LETTER = "a-zÀ-ÖØ-öø-ɏ"
#: Texts of these characters alone take the fast way: beyond ASCII, the letters of _LETTER (none changes under NFC) whose
#: lower case is one letter of _LETTER too. Some capitals have theirs beyond U+024F.
_SAFE = "".join(c for c in map(chr, range(0xC0, 0x250)) if re.fullmatch(f"[{_LETTER}]", c.lower()))
_PLAIN = re.compile(f"[^\t\n\r\x20-\x7e{_SAFE}]")
#: Fixed: the tokenizer's own split pattern, for such texts.
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\\s{_LETTER}0-9]+")


#: The byte-level alphabet of such tokenizers: printable bytes stand for themselves, the others follow from 256 on.
_OTHER = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_BYTES = {b: 256 + i for i, b in enumerate(_OTHER)}


class Encoder:
    """Token ids as little-endian 32-bit bytes, equal to those of the tokenizers library.

    The tokenizer lower-cases, splits and merges each word by itself, so words go to the library's merge model directly
    and their ids are remembered; texts with other characters, or with a special token's spelling, go through the
    whole library.
    """

    def __init__(self, path: str):
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are taken as they lie in memory: little-endian, 32 bits")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        spelt = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.merge(spelt)]).tobytes()

    def encode(self, text: str) -> bytes:
        if _PLAIN.search(text) or "<|" in text:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        words = _SPLIT.findall(text.lower())
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        if len(known) > CACHED:
            self.older, self.known = known, {}
            known = self.known
        older = self.older
        for w in words:
            if w not in known:
                known[w] = older.get(w) or self._word(w)
        return b"".join([known[w] for w in words])


@lru_cache(maxsize=2)
def _encoder(path: str | None) -> Encoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Encoder(path)


def _pieces(path: str | None):
    end = np.array([END], dtype="<u4").tobytes()
    most = 4 * CAPACITY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = encoder.encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), most)):
                    part = ids[at : at + most]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return run


def tokenized(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32. tokenizer: the vocabulary file on every node."""
    return docs.select("doc_id", "text").mapInArrow(
        _pieces(tokenizer), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


#: (length -> how many of it, for how many sequences)
Pattern = tuple[dict[int, int], int]


def _best_pattern(sizes: np.ndarray, price: np.ndarray, room: int) -> dict[int, int]:
    """Knapsack by dynamic programming: the multiset of sizes within room that has the largest total price."""
    best = np.zeros(room + 1)
    take = np.full(room + 1, -1)
    upto = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for w in range(1, room + 1):
        best[w] = best[w - 1]
        k = upto[w]
        if k:
            gain = best[w - sizes[:k]] + price[:k]
            j = int(gain.argmax())
            if gain[j] > best[w]:
                best[w], take[w] = gain[j], j
    out: dict[int, int] = defaultdict(int)
    w = room
    while w > 0:
        if take[w] < 0:
            w -= 1
        else:
            out[int(sizes[take[w]])] += 1
            w -= int(sizes[take[w]])
    return out


def _fractional(counts: dict[int, float], room: int, rounds: int) -> list[tuple[dict[int, int], float]]:
    """Patterns and how often each is used, by multiplicative weights on the covering constraints of the sizes."""
    sizes = np.array(sorted(counts))
    need = np.array([counts[int(s)] for s in sizes], dtype=float)
    covered = np.zeros(len(sizes))
    step = float(sizes @ need) / room / rounds
    eta = 12.0
    used: dict[tuple, float] = defaultdict(float)
    for t in range(rounds):
        behind = (t + 1) / rounds - covered / need
        price = sizes * np.exp(eta * np.clip(behind, -2, 2)) * (covered < need)
        if not price.any():
            break
        pattern = _best_pattern(sizes, price, room)
        used[tuple(sorted(pattern.items()))] += step
        for s, m in pattern.items():
            covered[np.searchsorted(sizes, s)] += m * step
    return [(dict(p), x) for p, x in sorted(used.items(), key=lambda kv: (-kv[1], kv[0]))]


def _grouped(counts: dict[int, int], unit: int, groups: int) -> list[tuple[int, list[int]]]:
    """Lengths dealt into groups of about equal volume: the group's size in units, and its lengths, long ones first."""
    share = sum(s * n for s, n in counts.items()) / groups
    out: list[tuple[int, list[int]]] = []
    filled = 0.0
    for s in sorted(counts, reverse=True):
        if not out or filled >= share:
            out.append((-(-s // unit), []))
            filled = 0.0
        out[-1][1].append(s)
        filled += s * counts[s]
    return out


def _rounded(fractional: list[tuple[dict[int, int], float]]) -> list[Pattern]:
    """Whole numbers by largest remainders: every pattern's whole part, and one more for the largest of what is left of
    each, so that the total stays."""
    whole = [math.floor(x + 1e-9) for _, x in fractional]
    more = math.ceil(sum(x for _, x in fractional) - 1e-6) - sum(whole)
    order = sorted(range(len(whole)), key=lambda i: (whole[i] - fractional[i][1], i))
    for i in order[:more]:
        whole[i] += 1
    return [(p, n) for (p, _), n in zip(fractional, whole, strict=True) if n]


class _Bins:
    """Sequences that are being filled, those of one filling together, by their free room."""

    def __init__(self, room: int):
        self.room = room
        self.free: list[int] = []
        self.by: dict[int, list[tuple[dict[int, int], int]]] = {}

    def add(self, free: int, held: dict[int, int], times: int) -> None:
        if free not in self.by:
            self.by[free] = []
            insort(self.free, free)
        self.by[free].append((held, times))

    def fit(self, s: int, n: int) -> None:
        """n pieces of length s, each into the fullest sequence that has room for it, into new ones where none has."""
        while n:
            at = bisect_left(self.free, s)
            if at == len(self.free):
                m = min(self.room // s, n)
                self.add(self.room - m * s, {s: m}, n // m)
                n -= n // m * m
                continue
            free = self.free[at]
            held, times = self.by[free].pop()
            if not self.by[free]:
                del self.by[free]
                del self.free[at]
            m = min(free // s, n)
            use = min(times, n // m)
            if use < times:
                self.add(free, held, times - use)
            self.add(free - m * s, {**held, s: held.get(s, 0) + m}, use)
            n -= m * use

    def patterns(self) -> list[Pattern]:
        return [b for free in self.free for b in self.by[free]]


def best_fit(counts: dict[int, int], room: int) -> list[Pattern]:
    """Plain best fit by falling length, on counts: what the plan is measured against."""
    bins = _Bins(room)
    for s in sorted(counts, reverse=True):
        bins.fit(s, counts[s])
    return bins.patterns()


def _placed(left: dict[int, int], lengths: list[int], groups: dict[int, list[int]], pattern: dict[int, int], times: int, room: int, bins: _Bins) -> None:
    """Sequences of a rounded pattern: its groups' longest pieces in their places, and in the last place, which takes up
    what grouping has left free, the longest piece that fits. lengths: all that are not fluid, rising."""
    places = [g for g, m in sorted(pattern.items(), reverse=True) for _ in range(m)]
    while times and places:
        held: dict[int, int] = {}
        free = room
        for g in places[:-1]:
            if s := next((s for s in groups[g] if left[s] > held.get(s, 0)), 0):
                held[s] = held.get(s, 0) + 1
                free -= s
        at = bisect_right(lengths, free) - 1
        while at >= 0 and left[lengths[at]] <= held.get(lengths[at], 0):
            at -= 1
        if at >= 0:
            held[lengths[at]] = held.get(lengths[at], 0) + 1
            free -= lengths[at]
        if not held:
            return
        use = min(times, *(left[s] // m for s, m in held.items()))
        for s, m in held.items():
            left[s] -= m * use
        bins.add(free, held, use)
        times -= use


def plan(counts: dict[int, int], room: int, rounds: int = ROUNDS) -> list[Pattern]:
    """Patterns (length -> how many) and for how many sequences each serves; they use up counts exactly.

    Lengths of up to room / FLUID are the fluid group: in the linear program they are so many single units, less what
    grouping adds to the other lengths, and best fit puts them where there is room.
    """
    left = {s: n for s, n in counts.items() if n}
    unit = -(-room // UNITS)
    bins = _Bins(room)
    lengths = sorted(s for s in left if s > room // FLUID)
    grouped = _grouped({s: left[s] for s in lengths}, unit, GROUPS)
    groups: dict[int, list[int]] = defaultdict(list)
    for size, held in grouped:
        groups[size] += held
    need = {g: float(sum(left[s] for s in held)) for g, held in groups.items()}
    fluid = sum(s * n for s, n in left.items()) / unit - sum(g * n for g, n in need.items())
    if fluid > 0:
        need[1] = need.get(1, 0.0) + fluid
    if need:
        for pattern, times in _rounded(_fractional(need, room // unit, rounds)):
            solid = {g: m for g, m in sorted(pattern.items(), reverse=True) if g in groups}
            _placed(left, lengths, groups, solid, times, room, bins)
    for s in sorted(left, reverse=True):
        bins.fit(s, left[s])
    return [(p, n) for p, n in bins.patterns() if n]


def _runs(patterns: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank, the pieces a sequence takes, and the first sequence, of each pattern that uses it."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    upto: dict[int, int] = defaultdict(int)
    first = 0
    for pattern, times in patterns:
        for s, m in pattern.items():
            runs[s].append((upto[s], m, first))
            upto[s] += m * times
        first += times
    return {s: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for s, r in runs.items()}


def _assigned(runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kind, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (-2, -1))
            out = np.empty(len(kind), dtype=np.int64)
            for s in np.unique(kind):
                at = np.flatnonzero(kind == s)
                start, each, first = runs[int(s)]
                j = np.searchsorted(start, rank[at], side="right") - 1
                out[at] = first[j] + (rank[at] - start[j]) // each[j]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out)], [*batch.schema.names[:-2], "sequence_id"])

    return run


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Every document's pieces with sequence_id and offset: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Sequences hold at most CAPACITY tokens and have no gaps; only documents longer than that are cut.

    Defined cases: a null text is empty and still has its end token; a text of any length is cut into as many pieces as it
    needs; an empty table gives an empty result; repeated rows, and documents without an id, are packed each; other
    columns of docs are ignored.
    """
    scratch = Scratch(spark, "pack")
    pieces = scratch.write(tokenized(docs, tokenizer), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most CAPACITY rows
    runs = _runs(plan(counts, CAPACITY))
    buckets = spark.createDataFrame([(s, -(-n // BUCKET)) for s, n in counts.items()], "length long, buckets long")
    dealt = pieces.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets")))
    sizes = dealt.groupBy("length", "bucket").count().withColumn("span", F.floor(F.col("bucket") / SPAN))
    earlier = lambda by, order, n: F.coalesce(F.sum(n).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = sizes.groupBy("length", "span").agg(F.sum("count").alias("n")).select("length", "span", earlier(["length"], "span", "n").alias("spans"))
    before = sizes.withColumn("inside", earlier(["length", "span"], "bucket", "count")).join(spans, ["length", "span"])
    before = before.select("length", "bucket", (F.col("inside") + F.col("spans")).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(inside) - 1).join(before, ["length", "bucket"])
    ranked = ranked.select(*pieces.columns, F.col("length").alias("class"), (F.col("rank") + F.col("before")).alias("rank"))
    placed = ranked.mapInArrow(
        _assigned(runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long"
    )
    placed = scratch.write(placed, "placed")  # equal rows get their places once
    scratch.drop("pieces")
    along = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece", "ids_crc32")
    ends = F.sum("length").over(along.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("offset", ends - F.col("length"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
