"""Overlap with evaluation items by shared word windows: indexes, hit counts, owners, sides, touched items.

Texts are normalized by Spark; windows are rolling hashes of word hashes, computed in numpy batch by batch. An index of up
to HELD windows goes to the workers as one sorted array, and only windows that it holds leave them, so that of the corpus
nothing but hits is shuffled. A larger index is joined by its windows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.functions.text import capped, normalize
from corpusloom.operators.sample import first_k

#: Words of a window.
N = 13
#: Items listed for an evaluation item at most (the report says how many were left out).
LISTED = 200
#: Windows of an index that workers hold at most (8 bytes each).
HELD = 8_000_000
#: Rows that a worker holds at a time.
ROWS = 500
#: Windows among which a task looks for recurring ones at a time, about: twice that at most, for whole texts (8 bytes each).
CHUNK = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(words: list[bytes], n: int) -> np.ndarray:
    """A 64-bit hash of every window of n words, in order and with repeats; none if there are fewer words."""
    if len(words) < n:
        return np.empty(0, dtype=np.int64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    rolled = own
    for k in range(1, n):
        rolled = rolled[:-1] * _BASE + own[k:]
    rolled = (rolled ^ (rolled >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (rolled ^ (rolled >> np.uint64(32))).view(np.int64)


def _windowed(n: int, known: Callable[[], np.ndarray] | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = known() if known else None
        for whole in batches:
            for first in range(0, max(whole.num_rows, 1), ROWS):
                batch = whole.slice(first, ROWS)
                row, at, found, of = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    h = window_hashes((text or b"").split(), n)
                    where = np.arange(len(h))
                    if held is not None:
                        near = np.searchsorted(held, h)
                        where = np.flatnonzero(held[np.minimum(near, len(held) - 1)] == h) if len(held) else where[:0]
                    if len(where):
                        row.append(np.full(len(where), i))
                        at.append(where)
                        found.append(h[where])
                        of.append(np.full(len(where), len(h)))
                rows = pa.array(np.concatenate(row))
                new = [pa.array(np.concatenate(x)) for x in (at, found, of)]
                yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[:-1]), *new], [*batch.schema.names[:-1], "at", "h", "n_windows"])

    return run


def grams(rows: DataFrame, keys: list[str], text: str = "text", n: int = N, cap: bool = False, known: Callable[[], np.ndarray] | None = None) -> DataFrame:
    """The keys with a row for each window: its position at, its hash h, and the number of the text's windows.

    Rows with fewer than n words give none. cap: of the first characters of a text only. known: only windows it holds.
    """
    source = capped(F.col(text)) if cap else F.col(text)
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keys)
    plain = rows.select(*keys, normalize(source).cast("binary").alias("_text"))
    return plain.mapInArrow(_windowed(n, known), f"{kinds}at long, h long, n_windows long")


def probed(rows: DataFrame, keys: list[str], idx: DataFrame, text: str = "text", n: int = N, cap: bool = False) -> DataFrame:
    """grams of rows that the index holds."""
    known = idx.select("h").distinct()
    held = known.limit(HELD + 1).toPandas()["h"].to_numpy(dtype=np.int64)
    if len(held) > HELD:
        return grams(rows, keys, text, n, cap).join(known, "h", "left_semi")
    sent = rows.sparkSession.sparkContext.broadcast(np.sort(held))
    return grams(rows, keys, text, n, cap, known=lambda: sent.value)


def index(items: DataFrame, item: str = "item_id", set_name: Column | None = None, n: int = N) -> DataFrame:
    """The distinct windows of evaluation items: h, set, item."""
    named = items.withColumn("set", set_name if set_name is not None else F.lit("benchmark")).withColumnRenamed(item, "item")
    return grams(named, ["set", "item"], n=n).select("h", "set", "item").distinct()


def owned(idx: DataFrame, sets: list[str] | None = None) -> DataFrame:
    """Each window with a single owner, the first by set and item; of some sets only, chosen before owners are."""
    idx = idx.filter(F.col("set").isin(sets)) if sets is not None else idx
    first = F.min(F.struct("set", "item")).alias("first")
    return idx.groupBy("h").agg(first).select("h", "first.set", "first.item")


def hits(gram_rows: DataFrame, idx: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with n_hits (windows that occur in the index, repeats counted) and sets (those hit, sorted)."""
    sets = idx.groupBy("h").agg(F.collect_set("set").alias("sets"))
    found = gram_rows.join(sets, "h").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("sets")))).alias("sets"))
    return found


def owned_hits(gram_rows: DataFrame, idx: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with set and item of each owner that is hit, and the number of windows."""
    return gram_rows.join(idx, "h").groupBy(*keys, "set", "item").agg(F.count(F.lit(1)).alias("n_windows"))


class Held:
    """An index of several named sets as a worker holds it: windows in order, each with an entry for every set that has it.

    An entry names the set and the item that owns the window there, the set's first. Entries stand in order of the sets, so
    that the first of a window is its owner among all sets; which sets a window is in is kept as bits beside it.
    """

    def __init__(self, h: np.ndarray, set_of: np.ndarray, item_of: np.ndarray, sets: list[str], items: list):
        order = np.lexsort((set_of, h))
        self.set_of, self.item_of, self.sets, self.items = set_of[order], item_of[order], sets, items
        self.h, self.first = np.unique(h[order], return_index=True)
        self.last = np.append(self.first[1:], len(h))
        self.member = np.zeros((len(self.h), -(-max(len(sets), 1) // 64)), dtype=np.uint64)
        window = np.repeat(np.arange(len(self.h)), self.last - self.first)
        np.bitwise_or.at(self.member, (window, self.set_of // 64), np.uint64(1) << (self.set_of % 64).astype(np.uint64))

    def found(self, windows: np.ndarray) -> np.ndarray:
        """The numbers of the windows that the index has, repeats counted."""
        if not len(self.h):
            return np.empty(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.h, windows), len(self.h) - 1)
        return at[self.h[at] == windows]

    def sets_of(self, found: np.ndarray) -> list[str]:
        """The sets that any of the windows is in."""
        bits = np.bitwise_or.reduce(self.member[found], axis=0) if len(found) else np.zeros(self.member.shape[1], np.uint64)
        return [name for i, name in enumerate(self.sets) if int(bits[i // 64]) >> (i % 64) & 1]

    def owners(self, found: np.ndarray) -> list[tuple[int, int, int, int]]:
        """set, item, windows that the item owns in its set, and those of them that it owns among all sets."""
        window, n = np.unique(found, return_counts=True)
        size = self.last[window] - self.first[window]
        entry = np.repeat(self.first[window], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        alone = np.repeat(n, size)
        owned = np.where(entry == np.repeat(self.first[window], size), alone, 0)
        pairs, at = np.unique(np.stack([self.set_of[entry], self.item_of[entry]]), axis=1, return_inverse=True)
        sums = [np.bincount(at.ravel(), x, pairs.shape[1]).astype(np.int64).tolist() for x in (alone, owned)]
        return list(zip(*pairs.tolist(), *sums, strict=True)) if pairs.size else []


def held(idx: DataFrame, most: int | None = None) -> Held | None:
    """The index as workers hold it; None where it has over `most` (HELD) entries. Entries are one per window and set."""
    most = HELD if most is None else most
    each = idx.groupBy("h", "set").agg(F.min("item").alias("item"))
    rows = each.limit(most + 1).toArrow()
    if rows.num_rows > most:
        return None
    sets, items = sorted(set(rows["set"].to_pylist())), sorted(set(rows["item"].to_pylist()))
    place = [{x: i for i, x in enumerate(own)} for own in (sets, items)]
    codes = [np.array([own[x] for x in rows[c].to_pylist()], dtype=np.int64) for c, own in zip(("set", "item"), place, strict=True)]
    return Held(rows["h"].to_numpy(), *codes, sets, items)


def _attributed(known: Callable[[], Held], n: int, item: pa.DataType, by_item: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = known()
        for whole in batches:
            for at in range(0, max(whole.num_rows, 1), ROWS):
                batch = whole.slice(at, ROWS)
                row, out = [], []
                for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    words = window_hashes((text or b"").split(), n)
                    found = index.found(words)
                    if not len(found):
                        continue
                    if by_item:
                        own = [(index.sets[s], index.items[x], alone, owned) for s, x, alone, owned in index.owners(found)]
                    else:
                        own = [(index.sets_of(found), len(found), len(words))]
                    row += [i] * len(own)
                    out += own
                kinds = (pa.string(), item, pa.int64(), pa.int64()) if by_item else (pa.list_(pa.string()), pa.int64(), pa.int64())
                names = ("set", "item", "n_alone", "n_owned") if by_item else ("sets", "n_hits", "n_windows")
                new = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
                rows = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[:-1]), *new], [*batch.schema.names[:-1], *names])

    return run


def attributed(rows: DataFrame, keys: list[str], idx: DataFrame, by_item: bool = False, text: str = "text", n: int = N, most: int | None = None) -> DataFrame:
    """Whom the windows of each row belong to, in one pass over whole texts; rows that share none are left out.

    By row: sets (those hit, sorted), n_hits (windows hit, repeats counted) and n_windows. by_item: a row for each set and item
    with n_alone, the windows that the item owns if its set were the only one, and n_owned, those that it owns among all sets
    (the first set by name has a window, and in it the first item), which so add up to n_hits. The keys tell the rows apart.

    The index goes to the workers up to `most` entries, and what leaves them is what is returned; a larger one is joined.
    """
    kept = held(idx, most)
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keys)
    if kept is None:
        return _joined(grams(rows, keys, text, n), keys, idx, by_item)
    sent = rows.sparkSession.sparkContext.broadcast(kept)
    item = idx.schema["item"].dataType
    made = f"`set` string, item {item.simpleString()}, n_alone long, n_owned long" if by_item else "sets array<string>, n_hits long, n_windows long"
    plain = rows.select(*keys, normalize(F.col(text)).cast("binary").alias("_text"))
    return plain.mapInArrow(_attributed(lambda: sent.value, n, to_arrow_type(item), by_item), kinds + made)


def _joined(windows: DataFrame, keys: list[str], idx: DataFrame, by_item: bool) -> DataFrame:
    each = idx.groupBy("h", "set").agg(F.min("item").alias("item"))
    entries = each.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("set", "item"))).alias("e"))  # an entry a set
    met = windows.join(entries, "h")
    if not by_item:
        out = met.groupBy(*keys).agg(F.collect_set("e.set").alias("s"), F.count(F.lit(1)).alias("n_hits"), F.max("n_windows").alias("n_windows"))
        return out.select(*keys, F.array_sort(F.array_distinct(F.flatten("s"))).alias("sets"), "n_hits", "n_windows")
    each = met.select(*keys, F.posexplode("e").alias("k", "e"))
    return each.groupBy(*keys, "e.set", "e.item").agg(F.count(F.lit(1)).alias("n_alone"), F.count(F.when(F.col("k") == 0, 1)).alias("n_owned"))


def overlap_fraction(found: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct windows shared with the index over all windows of a row, of the rows that share any (found: probed)."""
    return found.groupBy(*keys).agg((F.count_distinct("h") / F.max("n_windows")).alias("fraction"), F.max("n_windows").alias("n_windows"))


def boilerplate(idx: DataFrame, share: float = 0.5) -> DataFrame:
    """Windows that occur in more than share of the items (and in more than one): no evidence of overlap."""
    items = idx.select("set", "item").distinct().agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * share)).alias("most"))
    df = idx.select("h", "set", "item").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(items)).filter("df > most").select("h", "df")


def _recurring(n: int, least: float, windows: int) -> Callable:
    """Windows that rows of a chunk share: those in more than least of its rows that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def out(chunk: list[np.ndarray]) -> pa.RecordBatch:
            own, k = np.unique(np.concatenate(chunk), return_counts=True) if chunk else (np.empty(0, np.int64), np.empty(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(own[k > least * len(chunk)])], ["h"])

        for batch in batches:
            for text in batch.column(0):
                own = np.unique(window_hashes((text.as_py() or b"").split(), n))
                if len(own):
                    rows.append(own)
                    held += len(own)
                if held >= 2 * windows:  # so that the last chunk, too, is no small one
                    cut = int(np.searchsorted(np.cumsum([len(r) for r in rows]), windows)) + 1
                    yield out(rows[:cut])
                    rows = rows[cut:]
                    held = sum(map(len, rows))
        yield out(rows)

    return run


def boilerplate_of(items: DataFrame, item: str = "item_id", share: float = 0.5, n: int = N, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """boilerplate of the windows of items, with its result, where they are too many to be indexed.

    A window in more than share of all rows is in more than that share of the rows of some chunk of them, so a first pass
    gathers what recurs in chunks, and a second one counts only that, by item. What is shuffled are windows that recur and
    the items' ids. Where an item has several rows, the share of rows is less by as much.
    """
    plain = normalize(F.col(text))
    long = items.filter(F.size(F.filter(F.split(plain, " "), lambda w: w != "")) >= n).groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    count, rows = long.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    most = max(1, math.floor(count * share))
    least = most / max(rows, 1) * (1 - 1e-9)
    often = items.select(plain.cast("binary").alias("_text")).mapInArrow(_recurring(n, least, chunk), "h long").distinct()
    df = probed(items, [item], often, text, n).select("h", item).distinct().groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    return df.filter(F.col("df") > most)


def items_touched(gram_rows: DataFrame, idx: DataFrame, row: str, listed: int | None = LISTED) -> DataFrame:
    """Per item the rows that share a window with it: their number, the first of them by id, and how many are not listed.

    listed bounds what is gathered of an item, however many rows touch it; None lists all, for items that few rows touch.
    """
    pairs = gram_rows.join(idx, "h").select("set", "item", row).distinct()
    kept = pairs if listed is None else first_k(pairs, ["set", "item"], [row], listed)
    rows = kept.groupBy("set", "item").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return pairs.groupBy("set", "item").agg(F.count(F.lit(1)).alias("n_rows")).join(rows, ["set", "item"]).withColumn("n_unlisted", F.col("n_rows") - F.size("rows"))


def worst(hit_rows: DataFrame, by: str, key: str, k: int) -> DataFrame:
    """The k rows with most hits; ties: the smaller key."""
    return hit_rows.orderBy(F.desc(by), key).limit(k)


def quote(gram_rows: DataFrame, idx_positions: DataFrame, keys: list[str]) -> DataFrame:
    """Per row and item the first window of the item, by position in it, that the row shares."""
    return gram_rows.join(idx_positions.select("h", "set", "item", F.col("at").alias("item_at")), "h").groupBy(*keys, "set", "item").agg(F.min("item_at").alias("item_at"))


def sides(messages: DataFrame, key: str, role: str = "role", text: str = "text", order: str = "turn") -> DataFrame:
    """Per conversation the input side (all turns but the assistant's) and the target side, turns joined by newlines."""
    own = F.array_sort(F.collect_list(F.struct(order, role, text)))
    side = lambda keep: F.array_join(F.transform(F.filter("m", keep), lambda x: x[text]), "\n")
    grouped = messages.groupBy(key).agg(own.alias("m"))
    return grouped.select(key, side(lambda x: x[role] != "assistant").alias("input"), side(lambda x: x[role] == "assistant").alias("target"))


def overlap_by_side(two_sides: DataFrame, idx: DataFrame, key: str, by: list[str], cap: bool = False) -> DataFrame:
    """Per group of rows: how many there are, and how many share a window on either side, the input, the target, both."""
    hit = [probed(two_sides.select(key, F.col(s).alias("text")), [key], idx, cap=cap).select(key, F.lit(s).alias("side")).distinct() for s in ("input", "target")]
    each = hit[0].unionByName(hit[1]).groupBy(key).agg(F.max((F.col("side") == "input").cast("int")).alias("i"), F.max((F.col("side") == "target").cast("int")).alias("t"))
    all_rows = two_sides.select(key, *by).join(each, key, "left").na.fill(0, ["i", "t"])
    return all_rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.greatest("i", "t")).alias("n_hit"), F.sum("i").alias("n_input"), F.sum("t").alias("n_target"), F.sum(F.least("i", "t")).alias("n_both")
    )


def clean_probes(probes: DataFrame, corpus: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Probe items (key, text) with the number of their windows that the training corpus holds; 0 is clean."""
    own = grams(probes, [key])
    shared = probed(corpus, [], own, text).select("h").distinct()
    found = own.join(shared, "h").groupBy(key).agg(F.count(F.lit(1)).alias("n_windows"))
    return probes.select(key).join(found, key, "left").na.fill(0, ["n_windows"])
