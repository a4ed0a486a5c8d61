"""Phrase collocations: frequent word sequences and how firmly they hold together, by counting arrays behind perfect hashes.

Length by length, only Apriori-safe candidates are counted: a phrase can be frequent only if its first words and its last
words are. Texts become arrays of word numbers once, with breaks where no frequent phrase can go on; a phrase of k words is
the number of its first k - 1 words and its last word, one 64-bit key, and so exact.

For each length there are three passes over these arrays:
- Each task gathers its distinct windows and how often it has seen them, dealt to parts by key: ascending keys, of which the
  gaps are stored, mostly a byte or two each. For each part they are added up. Keys seen less than the least frequency are
  no candidates; so those that are left are as few as the frequent phrases, at any size of the table. There are as many
  parts as windows / PART, so what a task holds of them stays the same.
- The candidates are dealt to shards of SHARD keys, about, and each becomes a minimal perfect hash whose slots hold the key
  itself, for verification.
- Each task looks its windows up, compares the stored key, and counts them by slot into arrays, which are summed in a tree.
Slots of frequent phrases are the numbers of the next length. Shards are files in the shared folder, and a worker holds a few
of them at a time, however many there are.

Each phrase is stored with the slots of its first and of its last k - 1 words, so the parts of a cut are read by slot.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, OrderedDict, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, slices
from corpusloom.llm.exact_dedup import PerfectHash

#: Occurrences of a phrase, words of the longest, and phrases of a language in the report.
LEAST, LONGEST, MOST = 100, 5, 2000
#: Keys of a shard, about; shards that a worker remembers.
SHARD, REMEMBERED = 25_000, 16
#: Word numbers in a row of the encoded table, about.
ROW = 1 << 15
#: Distinct words that a task counts or remembers, and windows that it gathers, before it hands them on, about.
WORDS, WINDOWS = 60_000, 300_000
#: Windows whose sums are made together, at most.
PART = 2_000_000
#: Arrays that one step of the tree adds up.
FAN = 32
NO_LANG = "und"
_MIX = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
#: A-Z in lower case, the characters that end a piece as line ends, tabs as blanks.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
#: Stands between pieces; no text in UTF-8 holds this byte.
_END = b"\xff"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in lower case, with _END between pieces."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).replace(b"\n", b" \xff ").split()


def mixed(keys: np.ndarray) -> np.ndarray:
    """Four 64-bit mixes of each key, as the 32 bytes that a perfect hash places it by; distinct keys stay distinct."""
    h = keys.astype(np.uint64)[:, None] * _MIX
    h ^= h >> np.uint64(29)
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 32)


def _word_digest(lang: str, word: bytes) -> bytes:
    return hashlib.blake2b(lang.encode("utf-8", "surrogatepass") + b"\xff" + word, digest_size=32).digest()


def _shard_of(lang: str, word: bytes, shards: int) -> int:
    return zlib.crc32(lang.encode("utf-8", "surrogatepass") + b"\xff" + word) % shards


# Shards: one row each in the shared folder, with the levels of the hash and what its slots hold.


def _levels(mph: PerfectHash) -> dict:
    return {"sizes": [len(alone) for alone, _ in mph.levels], "bits": [np.packbits(alone).tobytes() for alone, _ in mph.levels]}


def _hash_of(sizes: list[int], bits: list[bytes]) -> PerfectHash:
    mph, base = PerfectHash(np.empty((0, 32), dtype=np.uint8)), 0
    for size, packed in zip(sizes, bits, strict=True):
        alone = np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=size).astype(bool)
        mph.levels.append((alone, (base + np.cumsum(alone) - 1).astype(np.int32)))
        base += int(alone.sum())
    mph.n = base
    return mph


class Shards:
    """The shards of one length, as a worker reads them: a few at a time."""

    def __init__(self, folder: str, count: int):
        self.folder, self.count = folder, count
        self.held: OrderedDict[int, tuple[PerfectHash, dict]] = OrderedDict()

    def shard(self, k: int) -> tuple[PerfectHash, dict] | None:
        if k in self.held:
            self.held.move_to_end(k)
            return self.held[k]
        store, root = fs.FileSystem.from_uri(self.folder)
        there = [f for f in store.get_file_info(fs.FileSelector(f"{root}/shard={k}", allow_not_found=True)) if f.path.endswith(".parquet")]
        rows = [r for f in there for r in pq.ParquetFile(store.open_input_file(f.path)).read().to_pylist()]
        self.held[k] = (_hash_of(rows[0]["sizes"], rows[0]["bits"]), rows[0]) if rows else None
        if len(self.held) > REMEMBERED:
            self.held.popitem(last=False)
        return self.held[k]

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The numbers (slot * shards + shard) of distinct keys, in order; -1 where the slot holds another key."""
        out = np.full(len(keys), -1, dtype=np.int64)
        of = keys % self.count
        for k in np.unique(of):
            found = self.shard(int(k))
            if found is None:
                continue
            mph, row = found
            mine = np.flatnonzero(of == k)
            at = mph.slots(mixed(keys[mine]))
            stored = np.frombuffer(row["keys"], dtype="<i8")
            right = (at >= 0) & (stored[np.maximum(at, 0)] == keys[mine])
            if row.get("n") is not None:
                right &= np.frombuffer(row["n"], dtype="<i8")[np.maximum(at, 0)] >= row["least"]
            out[mine[right]] = at[right] * self.count + k
        return out

    def words(self, lang: str, words: list[bytes]) -> list[int]:
        """The numbers of words of a language; -1 for those that the slots don't hold."""
        out, by = [-1] * len(words), defaultdict(list)
        for i, w in enumerate(words):
            by[_shard_of(lang, w, self.count)].append(i)
        for k, mine in by.items():
            found = self.shard(k)
            if found is None:
                continue
            mph, row = found
            digests = b"".join(_word_digest(lang, words[i]) for i in mine)
            at = mph.slots(np.frombuffer(digests, dtype=np.uint8).reshape(-1, 32))
            for i, slot in zip(mine, at.tolist(), strict=True):
                if slot >= 0 and row["words"][slot] == words[i] and row["langs"][slot] == lang:
                    out[i] = slot * self.count + k
        return out


def _built_words(rows: pd.DataFrame) -> pd.DataFrame:
    digests = [_word_digest(lang, word) for lang, word in zip(rows["lang"], rows["word"], strict=True)]
    have = np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 32)
    mph = PerfectHash(have)
    order = np.argsort(mph.slots(have))
    pick = lambda c: [rows[c].iloc[i] for i in order]
    return pd.DataFrame([{"shard": int(rows["shard"].iloc[0]), **_levels(mph), "langs": pick("lang"), "words": pick("word"), "f": np.array(pick("n"), dtype="<i8").tobytes()}])


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    keys = rows["key"].to_numpy(dtype="<i8")
    mph = PerfectHash(mixed(keys))
    at = mph.slots(mixed(keys))
    stored, second = np.empty_like(keys), np.empty(len(keys), dtype="<i8")
    stored[at], second[at] = keys, rows["second"].to_numpy()
    return pd.DataFrame([{"shard": int(rows["shard"].iloc[0]), **_levels(mph), "keys": stored.tobytes(), "second": second.tobytes()}])


# Passes over texts and over the arrays made of them


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and, as a null word, the number of all, for each language of a task."""
    counts: dict[str, Counter] = defaultdict(Counter)  # words, and at None the number of all

    def out() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            own[None] = sum(own.values()) - own.pop(_END, 0)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.keys(), pa.binary()), pa.array(own.values(), pa.int64())], ["lang", "word", "n"])
        counts.clear()

    for batch in slices(batches):
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts[lang].update(words_of(text))
        if sum(map(len, counts.values())) > WORDS:
            yield from out()
    yield from out()


def _encoded(folder: str, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, known = Shards(folder, shards), defaultdict(dict)
        for batch in slices(batches):
            texts: dict[str, list[bytes]] = defaultdict(list)
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                texts[lang] += words_of(text)
                texts[lang].append(_END)
            parts = []
            for lang, words in texts.items():
                own = known[lang]
                if sum(map(len, known.values())) > WORDS:
                    for others in known.values():
                        others.clear()
                own[_END] = -1
                new = sorted(set(words) - own.keys())
                own.update(zip(new, store.words(lang, new), strict=True))
                parts.append(np.fromiter(map(own.__getitem__, words), dtype=np.int32, count=len(words)))
            ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
            ids = ids[(ids >= 0) | np.append(False, ids[:-1] >= 0)]  # one break stands for several
            ends = np.flatnonzero(ids < 0) + 1
            cuts = np.unique(ends[np.minimum(np.searchsorted(ends, np.arange(ROW, len(ids), ROW)), len(ends) - 1)]) if len(ends) else []
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in np.split(ids, cuts)], pa.binary())], ["words"])

    return run


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word numbers and slots of each row; of single words, which have no column of their own, the slots are the numbers."""
    for i in range(batch.num_rows):
        own = [np.frombuffer(c[i].as_buffer(), dtype="<i4") for c in batch.columns]
        yield own[0], own[-1]


def windows(words: np.ndarray, slots: np.ndarray, k: int, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where phrases of k words stand whose first and last k - 1 words are frequent: place, key and the number of the last ones."""
    n = max(len(words) - k + 1, 0)
    at = np.flatnonzero((slots[:n] >= 0) & (slots[1 : n + 1] >= 0) & (words[k - 1 : k - 1 + n] >= 0))
    return at, slots[at].astype(np.int64) * kinds + words[at + k - 1], slots[at + 1]


def _summed_rows(parts: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for of, n in parts:
        yield pa.RecordBatch.from_arrays([pa.array([of]), pa.array([task]), pa.array([n.astype("<i8").tobytes()], pa.binary())], ["part", "task", "n"])


SUMS = "part long, task long, n binary"


def tree_sum(rows: DataFrame, tasks: int) -> DataFrame:
    """The sums of the arrays n of each part, FAN tasks' at a time."""

    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(n, dtype="<i8") for n in group["n"])
        return pd.DataFrame([{"part": int(group["part"].iloc[0]), "task": int(group["task"].iloc[0]) // FAN, "n": total.tobytes()}])

    while True:
        rows, tasks = rows.groupBy("part", F.expr(f"task div {FAN}")).applyInPandas(added, SUMS), -(-tasks // FAN)
        if tasks <= 1:
            return rows.select("part", "n")


def packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0, the lowest bytes of all before the next ones, so that small numbers compress to what they hold."""
    planes = np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def parts_for(windows: int, kinds: int) -> int:
    """Parts for so many windows, without a factor that kinds has: the keys of one word are dealt to all of them."""
    parts = max(1, -(-windows // PART))
    while math.gcd(parts, kinds) > 1:
        parts += 1
    return parts


def _enumerated(k: int, kinds: int, parts: int):
    """The distinct windows of a task and how often they were seen, by part (key % parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held = [], 0

        def out() -> pa.RecordBatch:
            own, seen = np.unique(np.concatenate(keys), return_counts=True)
            order = np.argsort(own % parts, kind="stable")
            own, seen = own[order], seen[order]
            ends = np.flatnonzero(np.diff(own % parts, append=-1)) + 1
            rows = [(int(x[0] % parts), len(x), packed(np.diff(x // parts, prepend=0)), packed(n)) for x, n in zip(np.split(own, ends[:-1]), np.split(seen, ends[:-1]), strict=True) if len(x)]
            kinds_of = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds_of)], ["part", "n", "gaps", "seen"])

        for batch in batches:
            for words, slots in _arrays(batch):
                keys.append(windows(words, slots, k, kinds)[1])
                held += len(keys[-1])
                if held > 4 * WINDOWS:
                    yield out()
                    keys, held = [], 0
        if keys:
            yield out()

    return run


def _frequent(parts: int, least: int):
    """The keys of a part that were seen so often."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.cumsum(unpacked(x, n)) for x, n in zip(rows["gaps"], rows["n"], strict=True)])
        seen = np.concatenate([unpacked(x, n) for x, n in zip(rows["seen"], rows["n"], strict=True)])
        order = np.argsort(keys)
        keys, seen = keys[order], seen[order]
        starts = np.flatnonzero(np.diff(keys, prepend=-1))
        often = np.add.reduceat(seen, starts) >= least
        return pd.DataFrame({"key": keys[starts[often]] * parts + int(rows["part"].iloc[0])})

    return run


def _ending(keys: DataFrame, before: DataFrame | None, kinds: int) -> DataFrame:
    """Keys with the number of their last words. before: the frequent phrases that are shorter by a word, None for words.

    A phrase a..yz ends with the phrase that begins with the last words of a..y and has z as its last word.
    """
    keys = keys.select("key", F.expr(f"key div {kinds}").alias("first"), F.expr(f"key % {kinds}").alias("last"))
    if before is None:
        return keys.select("key", F.col("last").alias("second"))
    head = before.select(F.col("slot").alias("first"), F.col("second").alias("middle"))
    tail = before.select(F.col("first").alias("middle"), "last", F.col("slot").alias("second"))
    return keys.join(head, "first").join(tail, ["middle", "last"]).select("key", "second")


def _slotted(folder: str, shards: int, sizes: dict[int, int], k: int, kinds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, counts, keys, held = Shards(folder, shards), {}, [], 0

        def count() -> None:
            own, n = np.unique(np.concatenate(keys), return_counts=True)
            at = store.slots(own)
            own, n = at[at >= 0], n[at >= 0]
            for s in np.unique(own % shards).tolist():
                mine = own % shards == s
                held = counts.setdefault(s, np.zeros(sizes[s], dtype=np.int64))
                held += np.bincount(own[mine] // shards, n[mine], sizes[s]).astype(np.int64)

        for batch in batches:
            for words, slots in _arrays(batch):
                keys.append(windows(words, slots, k, kinds)[1])
                held += len(keys[-1])
                if held > WINDOWS:
                    count()
                    keys, held = [], 0
                if sum(map(len, counts.values())) > 8 * WINDOWS:
                    yield from _summed_rows(list(counts.items()))
                    counts = {}
        if keys:
            count()
        yield from _summed_rows(list(counts.items()))

    return run


def _annotated(folder: str, shards: int, k: int, kinds: int):
    """The arrays again: slots of the frequent phrases of k words, and of the words only those that such a phrase covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Shards(folder, shards)
        for batch in batches:
            for words, slots in _arrays(batch):
                at, key, _ = windows(words, slots, k, kinds)
                own, back = np.unique(key, return_inverse=True)
                found = store.slots(own)[back]
                at, found = at[found >= 0], found[found >= 0]
                new = np.full(len(words), -1, dtype=np.int32)
                new[at] = found
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + k, -1)
                covered = np.cumsum(edge[:-1]) > 0
                kept = covered | np.append(False, covered[:-1])
                words = np.where(covered, words, np.int32(-1))[kept]
                yield pa.RecordBatch.from_arrays([pa.array([words.tobytes()], pa.binary()), pa.array([new[kept].tobytes()], pa.binary())], ["words", "slots"])

    return run


def _rows_of_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, langs, words, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                slot = np.arange(len(words), dtype=np.int64) * shards + k
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(langs, pa.string()), pa.array([w.decode("utf-8", "surrogatepass") for w in words], pa.string()), pa.array(np.frombuffer(f, dtype="<i8"))], ["slot", "lang", "phrase", "f"])

    return run


def _rows_of(shards: int, kinds: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, keys, second, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, second, n = (np.frombuffer(x, dtype="<i8") for x in (keys, second, n))
                at = np.flatnonzero(n >= least)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at * shards + k, keys[at] // kinds, second[at], keys[at] % kinds, n[at])], ["slot", "first", "second", "last", "f"])

    return run


def _write(scratch: Scratch, df: DataFrame, name: str) -> tuple[str, DataFrame]:
    """df in a folder for each shard, which workers read by themselves; where it is, and as a table."""
    at = f"{scratch.path}/{name}"
    df.write.mode("overwrite").partitionBy("shard").parquet(at, compression="uncompressed")
    return at if "://" in at or at.startswith("file:") else f"file://{at}", scratch.spark.read.schema(df.schema).parquet(at)


def collocations(spark: SparkSession, docs: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = MOST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the `most` phrases of each lang that hold together best.

    Defined cases: a null text is the empty text, a null lang is `und`; of a text of any length all words count; rows that
    repeat a document count again; an empty table, and one without a frequent phrase, give an empty result; other columns of
    docs are ignored.
    Products of counts are exact up to 38 digits.
    """
    scratch = Scratch(spark, "phrases")
    texts = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")
    counts = texts.mapInArrow(_counted, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = scratch.write(counts.filter(F.col("word").isNull() | (F.col("n") >= least)), "counts")
    totals = counts.filter("word is null").select("lang", "n")
    frequent = counts.filter("word is not null")
    shards = max(1, -(-frequent.count() // SHARD))
    of = F.crc32(F.concat(F.encode("lang", "UTF-8"), F.unhex(F.lit("FF")), "word"))
    frequent = frequent.withColumn("shard", (of % shards).cast("int"))
    kinds_of = "shard int, sizes array<int>, bits array<binary>, "
    built = frequent.groupBy("shard").applyInPandas(_built_words, kinds_of + "langs array<string>, words array<binary>, f binary")
    folder, words = _write(scratch, built, "words")
    kinds = max([0, *(r[0] for r in words.agg(F.max(F.size("words"))).collect() if r[0])]) * shards + 1
    if kinds > 1 << 31:
        raise ValueError("more frequent words than word numbers")
    rows = words.select("shard", "langs", "words", "f").mapInArrow(_rows_of_words(shards), "slot long, lang string, phrase string, f long")
    first = scratch.write(rows.select("*", F.array().cast("array<long>").alias("heads"), F.array().cast("array<long>").alias("tails")), "phrases1")
    table = scratch.write(texts.mapInArrow(_encoded(folder, shards), "words binary"), "table1")

    levels, before = [first], None
    found = first.agg(F.sum("f")).first()[0] or 0
    for k in range(2, longest + 1):
        tasks = table.rdd.getNumPartitions()
        parts = parts_for(found, kinds)  # a window begins with a phrase that was found
        seen = table.mapInArrow(_enumerated(k, kinds, parts), "part int, n long, gaps binary, seen binary")
        often = seen.groupBy("part").applyInPandas(_frequent(parts, least), "key long")
        keys = scratch.write(_ending(often, before, kinds), f"keys{k}")
        n = keys.count()
        if not n:
            break
        shards = -(-n // SHARD)
        keys = keys.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
        folder, held = _write(scratch, keys.groupBy("shard").applyInPandas(_built, kinds_of + "keys binary, second binary"), f"candidates{k}")
        sizes = {r[0]: r[1] // 8 for r in held.select("shard", F.octet_length("keys")).collect()}
        sums = tree_sum(table.mapInArrow(_slotted(folder, shards, sizes, k, kinds), SUMS), tasks)
        done = held.join(sums.withColumnRenamed("part", "shard_"), F.col("shard") == F.col("shard_")).drop("shard_").withColumn("least", F.lit(least))
        folder, done = _write(scratch, done, f"counted{k}")
        own = done.select("shard", "keys", "second", "n").mapInArrow(_rows_of(shards, kinds, least), "slot long, first long, second long, last long, f long")
        own = scratch.write(own, f"frequent{k}")
        found = own.agg(F.sum("f")).first()[0]
        if not found:
            break
        levels.append(scratch.write(_named(own, levels[-1], first), f"phrases{k}"))
        if k < longest:
            fresh = scratch.write(table.mapInArrow(_annotated(folder, shards, k, kinds), "words binary, slots binary"), f"table{k}")
            scratch.drop(f"table{k - 1}")
            table = fresh
        scratch.drop(f"keys{k}", f"candidates{k}", f"frequent{k - 1}")
        before = own
    return _ranked([_kept(level, above) for level, above in zip(levels[1:], [*levels[2:], None], strict=False)], totals, levels[0], most)


def _named(own: DataFrame, shorter: DataFrame, words: DataFrame) -> DataFrame:
    """Phrases with their words, and the frequencies of all that they begin (heads) and end with (tails), shortest first."""
    head = shorter.select(F.col("slot").alias("first"), "lang", F.col("phrase").alias("head"), F.col("f").alias("hf"), F.col("heads").alias("hh"))
    tail = shorter.select(F.col("slot").alias("second"), F.col("f").alias("tf"), F.col("tails").alias("tt"))
    word = words.select(F.col("slot").alias("last"), F.col("phrase").alias("word"))
    met = own.join(head, "first").join(tail, "second").join(word, "last")
    return met.select(
        "slot", "lang", F.concat_ws(" ", "head", "word").alias("phrase"), "f",
        F.concat("hh", F.array("hf")).alias("heads"), F.concat("tt", F.array("tf")).alias("tails"), "first", "second",
    )


def _kept(level: DataFrame, above: DataFrame | None) -> DataFrame:
    """The phrases that no longer one holds as often. If one does, so does one that is longer by a word: it lies between them."""
    level = level.drop("first", "second")
    if above is None:
        return level
    inside = above.select(F.col("first").alias("slot"), "f").unionByName(above.select(F.col("second").alias("slot"), "f")).groupBy("slot").agg(F.max("f").alias("longer"))
    return level.join(inside, "slot", "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("f"))).drop("longer")


def _ranked(levels: list[DataFrame], totals: DataFrame, words: DataFrame, most: int) -> DataFrame:
    every = None
    for level in levels:
        every = level if every is None else every.unionByName(level)
    if every is None:
        every = words.limit(0)
    # The cut after k + 1 words: how often its first part occurs, and the rest.
    cuts = F.transform("heads", lambda l, k: F.struct(l.alias("l"), F.element_at("tails", -(k + 1)).alias("r"), (k + 1).alias("k")))
    rows = every.join(totals, "lang").withColumn("cuts", cuts)
    rows = rows.withColumn("best", F.expr("array_min(transform(cuts, c -> struct((cast(f as decimal(20,0)) * n * 1000) div (cast(c.l as decimal(20,0)) * c.r) as score, c.k as k, c.l as l, c.r as r)))"))
    rows = rows.select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", "n", "best.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    near = rows.withColumn("k", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("k") <= most)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return near.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


OP12_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
     worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
     totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
     grams AS (SELECT lang, k, unnest([w[i + 1:i + k] FOR i IN range(len(w) - k + 1)]) AS p FROM worded, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
     f AS (SELECT lang, k, p, count(*) AS f FROM grams GROUP BY lang, k, p HAVING count(*) >= 100),
     inside AS (SELECT lang, p[1:k - 1] AS p, f FROM f WHERE k > 2 UNION ALL SELECT lang, p[2:k] AS p, f FROM f WHERE k > 2),
     dropped AS (SELECT DISTINCT c.lang, c.p FROM f c JOIN inside i ON i.lang = c.lang AND i.p = c.p AND i.f >= c.f),
     kept AS (SELECT f.* FROM f ANTI JOIN dropped d USING (lang, p) WHERE k >= 2),
     cuts AS (SELECT lang, k, p, f AS a, unnest(range(1, k)) AS c FROM kept),
     scored AS (SELECT c.lang, c.p, c.a, c.c, l.f AS l, r.f AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
                FROM cuts c JOIN f l ON l.lang = c.lang AND l.p = c.p[1:c.c] JOIN f r ON r.lang = c.lang AND r.p = c.p[c.c + 1:c.k] JOIN totals t ON t.lang = c.lang),
     best AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, c) AS nth FROM scored),
     ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM best WHERE nth = 1)
SELECT * FROM ranked WHERE rank <= 2000
"""
