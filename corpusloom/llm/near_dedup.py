"""Near-dedup by bottom-k sketches of one hash function.

1. A document is the set of its word shingles as 64-bit hashes, and its sketch the K smallest of them. Documents with the
   same set become one representative.
2. Inverted lists of the retained values, from each document's rarest ones only. Two sets of Jaccard similarity 0.8 have
   SURE retained values in common at least (by the binomial tail up to a chance of 1e-9; sets of up to 0.8 K shingles are
   retained whole, and share 80 % of the larger for certain). So in the order of their document frequency the first common
   one is among the first m - SURE + 1 of either's m retained values. Values that no other document retains come first
   and need no list: a document of which enough is its own meets no other, however common the passages in the rest.
3. Short lists give their pairs, of which there are at most LIST / 2 times the entries; each pair must pass the estimate
   from the union of both sketches, and then the exact comparison of the full sets.
4. Long lists, of groups of near copies however large, never give pairs. The documents they connect form families. A
   family is cut into blocks of bounded size; a task compares a block's documents, by the shared retained values, the
   estimate and the full sets, and returns a spanning forest of the links that it finds. Each tree then stands for its
   documents by one of them, and these are dealt into blocks again, until that joins no more: a family of n near copies
   costs n * BLOCK comparisons, not n * n. Only documents of one family that are still in different trees are compared
   across blocks, all of them, so that no link is missed.
5. Links become connected components (large-star, small-star); all intermediate tables are in the shared folder.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, chosen, counted, located, slices, tasks_for
from corpusloom.llm.components import components

#: Retained values of a sketch, and of the longer one that blocks compare.
K, K_BLOCK = 64, 128
#: Chance that two sketches of similar sets share fewer values than the lists count on.
CHANCE = 1e-9
#: Entries up to which a list gives pairs.
LIST = 8
#: Documents and bytes of a block, and the rows of it that are compared with all others at a time.
BLOCK, BLOCK_BYTES, STRIP = 1024, 8 << 20, 512
#: Values that sets of a block have in common, up to which whole sets are compared rather than sketches.
COMMON = 32_768
#: Standard errors below the threshold at which an estimate still passes.
SLACK = 6.0
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; of its whole sequence if it has fewer words; none without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found))
    n = min(words, len(found))
    rolled = own[: len(own) - n + 1]
    for k in range(1, n):
        rolled = rolled * _BASE + own[k : len(own) - n + 1 + k]
    return np.unique(_mixed(rolled + np.uint64(n)))


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, digests, flat, ends = [], [], [], [0]
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, words)
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                flat.append(found[:K])
                ends.append(ends[-1] + len(flat[-1]))
            values = np.concatenate(flat).view(np.int64) if flat else np.empty(0, np.int64)
            sketch = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), sketch],
                ["doc_id", "n_shingles", "digest", "sketch"],
            )

    return run


def _full_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(text, words).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])

    return run


def sure(k: int, percent: int) -> int:
    """So many of the k smallest values of a union are common, if percent of it are, but for a chance below CHANCE.

    Drawn without replacement, they are common at least as surely as by k independent draws.
    """
    p, below, n = percent / 100, 0.0, 0
    while n < k:
        below += math.comb(k, n) * p**n * (1 - p) ** (k - n)
        if below > CHANCE:
            break
        n += 1
    return n


def union_estimate(a: np.ndarray, b: np.ndarray, k: int) -> tuple[float, float]:
    """The similarity by the k smallest values of the union of two sketches (sorted), and its standard error at 0.8.

    Below k values in the union both sketches are whole sets and the similarity is exact.
    """
    union = np.union1d(a[:k], b[:k])
    exact = len(a) < k and len(b) < k
    union = union if exact else union[:k]
    both = np.intersect1d(a[:k], b[:k], assume_unique=True)
    shared = len(both) if exact else int(np.searchsorted(both, union[-1], side="right"))
    return shared / len(union), 0.0 if exact else (0.16 / len(union)) ** 0.5


def _estimated(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for n, m, a, b in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                near = 100 * min(n, m) >= percent * max(n, m)
                if near:
                    by, error = union_estimate(*(np.array(x, dtype=np.int64).view(np.uint64) for x in (a, b)), K)
                    near = by >= percent / 100 - SLACK * error - 1e-9
                keep.append(near)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = ([np.frombuffer(x, dtype=np.uint64) for x in batch.column(i).to_pylist()] for i in (2, 3))
            keep = [_similar(a, b, percent) for a, b in zip(*sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _likely(sets: list[np.ndarray], side: np.ndarray | None, tree: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs that may be similar, the likeliest first, and the number of smallest values that each set was compared by:
    all of them if the sets have few values in common, as near copies do. Of sets no larger, the pairs are similar."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    most = int(size.max())
    codes, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    if int((count > 1).sum()) > COMMON:
        most = K_BLOCK
        codes, count = np.unique(np.concatenate([s[:most] for s in sets]), return_inverse=True, return_counts=True)[1:]
    kept = np.minimum(size, most)
    often = count > 1
    column, several = np.cumsum(often) - 1, int(often.sum())
    owner = np.repeat(np.arange(n), kept)[often[codes]]
    codes = column[codes[often[codes]]]
    at = np.argsort(codes, kind="stable")  # by column, so that each strip of them is one run
    owner, codes = owner[at], codes[at]
    enough = sure(most, percent) if most == K_BLOCK else 0
    pairs = []
    for top in range(0, n, STRIP):
        rows = np.arange(top, min(top + STRIP, n))
        shared = np.zeros((len(rows), n), dtype=np.float32)
        for low in range(0, several, 4 * STRIP):
            mine = slice(*np.searchsorted(codes, (low, low + 4 * STRIP)))
            has = np.zeros((n, min(4 * STRIP, several - low)), dtype=np.float32)
            has[owner[mine], codes[mine] - low] = 1
            shared += has[rows] @ has.T
        whole = (size[rows, None] <= most) & (size[None, :] <= most)
        near = np.where(whole, 100 * shared >= percent * (size[rows, None] + size[None, :] - shared), shared >= enough)
        near &= (100 * size[rows, None] >= percent * size[None, :]) & (100 * size[None, :] >= percent * size[rows, None])
        near &= rows[:, None] < np.arange(n)[None, :]
        for apart in (side, tree):
            if apart is not None:
                near &= apart[rows, None] != apart[None, :]
        i, j = np.nonzero(near)
        pairs.append((rows[i], j, shared[i, j] / np.minimum(kept[rows[i]], kept[j])))
    first, second, share = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.argsort(-share, kind="stable")
    return first[order], second[order], most


def block_links(
    ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, percent: int, tree: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets; only of those across the two sides where side is given, and only of
    those that join different trees where tree says which are joined already."""
    n = len(sets)
    parent = list(range(n))
    if tree is not None:
        parent = np.unique(tree, return_index=True)[1][np.unique(tree, return_inverse=True)[1]].tolist()
    apart = len(set(parent))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    first, second, most = _likely(sets, side, tree, percent)
    for i, j in zip(first.tolist(), second.tolist(), strict=True):
        a, b = root(i), root(j)
        if a == b:
            continue
        near = len(sets[i]) <= most and len(sets[j]) <= most
        if not near:
            by, error = union_estimate(sets[i], sets[j], K_BLOCK)
            near = by >= percent / 100 - SLACK * error - 1e-9 and _similar(sets[i], sets[j], percent)
        if near:
            parent[a] = b
            links.append((int(ids[i]), int(ids[j])))
            apart -= 1
            if apart == 1:
                break
    return links


def _block_pairs(percent: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, dtype=np.uint64) for x in rows["shingles"]]
        across = len(key) == 3  # family and two blocks, which may be the same one
        side = rows["block"].to_numpy() if across and key[1] != key[2] else None
        links = block_links(rows["id"].to_numpy(), sets, side, percent, rows["tree"].to_numpy() if across else None)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _blocks() -> Column:
    """Blocks that an aggregated group of members fills."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.octet_length("shingles")) / BLOCK_BYTES)).cast("int")


def _family_links(scratch: Scratch, families: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all documents of each family that links join."""
    members = scratch.write(families.join(sets, "id").select("family", "id", "shingles"), "members")
    state = members.select("family", "id", F.col("id").alias("tree"))
    found, k, now = [], 0, members
    while True:
        sizes = scratch.write(now.groupBy("family").agg(F.count(F.lit(1)).alias("n"), _blocks().alias("blocks")).filter("n > 1"), f"blocks{k}")
        n, wide, rows = sizes.agg(F.count(F.lit(1)), F.count(F.when(F.col("blocks") > 1, 1)), F.sum(F.when(F.col("blocks") > 1, F.col("n")))).first()
        dealt = now.join(counted(sizes, n), "family").withColumn("block", F.pmod(F.xxhash64("id", F.lit(k)), F.col("blocks")))
        links = dealt.select("family", "block", "id", "shingles").repartitionByRange("family", "block").groupBy("family", "block")
        found.append(scratch.write(links.applyInPandas(_block_pairs(percent), "a long, b long"), f"links{k}"))
        if not k:
            if not wide:
                break  # every family was one block
            state = state.join(counted(sizes.filter("blocks > 1").select("family"), wide), "family", "left_semi")
        joined = components(scratch, found[-1], f"trees{k}").select(F.col("id").alias("tree"), "component")
        state = state.join(joined, "tree", "left").select("family", "id", F.coalesce("component", "tree").alias("tree"))
        state = scratch.write(state, f"state{k}")
        open_ = scratch.write(state.filter("id = tree").groupBy("family").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), f"open{k}")
        n_open, trees = open_.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_open:
            break
        state = state.join(counted(open_.select("family"), n_open), "family", "left_semi")
        if not wide or 2 * trees > rows:
            found.append(scratch.write(_across(scratch, members, state, percent), "links-across"))
            break
        k += 1
        leads = scratch.write(state.filter("id = tree").select("id"), f"leads{k}")
        now = members.join(counted(leads, trees), "id", "left_semi")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _across(scratch: Scratch, members: DataFrame, state: DataFrame, percent: int) -> DataFrame:
    """Links between the trees of a family (state: family, id, tree): blocks of one large tree each, or of many small
    ones, and every pair of blocks that are not of one tree."""
    rows = members.join(state.select("id", "tree"), "id")
    trees = scratch.write(rows.groupBy("family", "tree").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("shingles")).alias("bytes")), "tree-sizes")
    large = (F.col("n") >= BLOCK) | (F.col("bytes") >= BLOCK_BYTES)
    parts = lambda n, size: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES))
    small = trees.filter(~large).groupBy("family").agg(parts(F.sum("n"), F.sum("bytes")).alias("small"))
    trees = trees.join(small, "family", "left").select(
        "family", "tree", F.when(large, F.col("tree")).alias("owner"), F.when(large, parts(F.col("n"), F.col("bytes"))).otherwise(F.col("small")).alias("parts")
    )
    spread = F.pmod(F.xxhash64(F.when(F.col("owner").isNull(), F.col("tree")).otherwise(F.col("id"))), F.col("parts"))
    placed = state.join(trees, ["family", "tree"]).select("family", "id", "tree", "owner", F.xxhash64("owner", spread).alias("block"))
    placed = scratch.write(placed, "placed")
    blocks = placed.select("family", F.col("owner").alias("other_owner"), F.col("block").alias("other")).distinct()
    apart = F.col("owner").isNull() | F.col("other_owner").isNull() | (F.col("owner") != F.col("other_owner"))
    pairs = placed.join(blocks, "family").filter(apart).select(
        "family", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "tree"
    )
    full = pairs.join(members.select("id", "shingles"), "id")
    return full.repartitionByRange("family", "x", "y").groupBy("family", "x", "y").applyInPandas(_block_pairs(percent), "a long, b long")


def near_dedup(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs.

    Documents are linked where 100 * intersection >= percent * union of their shingle sets; component_id is the smallest
    doc_id that links reach, and kept says whether that is the document itself. percent below 80 is refused, as the
    lists would miss links.

    Defined cases: a text without words, or null, has no shingles and is linked with nothing; of a text of any length all
    shingles count; rows that share a doc_id
    are one document, with the links of each; rows without a doc_id have no component and are kept; an empty table gives
    an empty result; other columns of docs are ignored.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must lie between 80 and 100")
    scratch = Scratch(spark, "near")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    each = texts.mapInArrow(_sketches(words), "doc_id long, n_shingles long, digest binary, sketch array<long>")
    each = scratch.write(each, "sketches")
    lead = F.min(F.struct("doc_id", "n_shingles", "sketch"))
    reps = each.filter("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(lead.alias("lead"), F.count(F.lit(1)).alias("rows"))
    reps = scratch.write(reps.select("digest", "rows", "lead.n_shingles", "lead.sketch", F.col("lead.doc_id").alias("id")), "reps")

    whole = F.ceil(F.col("n_shingles") * percent / 100)
    due = F.when(F.col("n_shingles") <= K * percent // 100, whole).otherwise(F.least(whole, F.lit(sure(K, percent))))
    entries = reps.select("id", (F.size("sketch") - due + 1).alias("first"), F.size("sketch").alias("m"), F.explode("sketch").alias("key"))
    lists = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = entries.join(scratch.write(lists, "values"), "key").groupBy("id", "first", "m")
    rare = shared.agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("shared"))  # K of them at most
    rare = rare.withColumn("first", F.col("first") - F.col("m") + F.size("shared")).filter("first > 0")
    entries = rare.select("id", F.explode(F.slice("shared", F.lit(1), F.col("first"))).alias("e")).select("id", "e.key")
    entries = scratch.write(entries, "rare")
    lists = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).filter("n > 1")
    entries = scratch.write(entries.join(scratch.write(lists, "lists"), "key"), "entries")
    few = tasks_for(entries.count())  # for all that only shared lists give

    edges = entries.filter(F.col("n") > LIST).select(F.col("least").alias("a"), F.col("id").alias("b"))
    families = components(scratch, edges, "families").select("id", F.col("component").alias("family"))
    families = scratch.write(families, "families", few)
    short = entries.filter(F.col("n") <= LIST).join(families, "id", "left")
    one = (F.count("family") == F.count(F.lit(1))) & (F.min("family") == F.max("family"))
    mixed = short.groupBy("key").agg(one.alias("one")).filter("not one").select("key")
    short = scratch.write(short.join(mixed, "key", "left_semi").select("key", "id", "family"), "short", few)
    other = short.select("key", F.col("id").alias("b"), F.col("family").alias("of"))
    pairs = short.join(other, "key").filter("id < b and not coalesce(family = of, false)").select(F.col("id").alias("a"), "b").distinct()
    side = {c: reps.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab"}
    weighed = scratch.write(pairs, "pairs", few).join(side["a"], "a").join(side["b"], "b")
    likely = weighed.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_estimated(percent), "a long, b long")
    likely = scratch.write(likely, "likely", few)

    wanted = families.select("id").unionByName(likely.select(F.col("a").alias("id"))).unionByName(likely.select(F.col("b").alias("id"))).distinct()
    wanted = scratch.write(wanted, "wanted", few)
    at, file, row = located(scratch, docs)
    marks = at.select(F.col("doc_id").cast("long").alias("id"), file, row).join(wanted, "id").select(file, row, F.lit(1).alias("n"))
    read = at.select(F.col("doc_id").cast("long").alias("doc_id"), "text", file, row)
    sets = chosen(scratch, read, file, row, marks, "marks", 0, (_full_sets(words), "id long, shingles binary"))
    sets = scratch.write(sets, "sets")
    full = {c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"shingles_{c}")) for c in "ab"}
    found = likely.join(full["a"], "a").join(full["b"], "b").select("a", "b", "shingles_a", "shingles_b")
    found = found.mapInArrow(_verified(percent), "a long, b long")
    links = scratch.write(found.unionByName(_family_links(scratch, families, sets, percent)), "links")
    scratch.drop("values", "rare", "sets", "members", "placed", "entries", "short", "pairs", "lists", "likely", "wanted")

    reached = scratch.write(components(scratch, links, "links"), "components", few)
    told = reps.join(reached, "id", "left").withColumn("component_id", F.coalesce("component", "id"))
    told = scratch.write(told.filter("rows > 1 or component_id <> id").select("digest", "component_id"), "told", tasks_for(reps.count()))
    out = each.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")).join(told, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), (component.isNull() | (component == F.col("doc_id"))).alias("kept")
    )


def distinct(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without the rows that near_dedup does not keep, left out where they are read. Defined cases: as of near_dedup."""
    scratch = Scratch(spark, "distinct")
    at, file, row = located(scratch, docs)
    gone = near_dedup(spark, docs).filter("not kept").select("doc_id").distinct()
    marks = at.select("doc_id", file, row).join(gone, "doc_id").select(file, row, F.lit(0).alias("n"))
    return chosen(scratch, at, file, row, marks, "gone", otherwise=1)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i + 1:i + 4], ' ') FOR i IN range(len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
     links AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * m >= 80 * (p.n + q.n - m)),
     edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
     reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
     c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
