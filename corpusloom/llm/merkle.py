"""Merkle manifest of a dataset: a tree of three-way nodes per source, their roots in a tree of their own, a proof a row.

A leaf is the digest of a row's fields. Leaves of a source ascend by doc_id and are dealt out in aligned blocks of 729
rows; a block's node is found by one pass over its leaves that holds at most two nodes a level. Block nodes are the leaves
of the next tree, and so on up to the root, so a source of any size is a table of blocks and never one task.

Proofs come from traversal scheduling. While the leaves of a block are walked in order, each level of it holds the nodes
of the run that the walk is in, which are the siblings there, and a treehash stack prepares those of the next run. Every
step gives the stacks as many leaves as the block has levels, always to the stack whose lowest node is lowest, so that
they are ready in time and few nodes are held (see Walk.held). What the block's leaves have in common, the path
from its node to the root, is appended from a table.

Leaves are hashed by Spark where the text is read; only digests are shuffled or written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch

#: Children of a node, and levels of a block, which so has ARITY ** LEVELS leaves at most.
ARITY, LEVELS = 3, 6
#: Bytes of a digest as text.
WIDE = 64


def node(parts: list[bytes]) -> bytes:
    """The digest of digests, as text."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def depth(leaves: int) -> int:
    """Levels above so many leaves, until one node is left."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // ARITY), levels + 1
    return levels


class Treehash:
    """Takes the leaves first..last-1 one by one and leaves their nodes at a level: two nodes a level are held meanwhile."""

    def __init__(self, level: int, first: int, last: int, leaves: int):
        self.level, self.at, self.last, self.whole = level, first, min(last, leaves), last <= leaves
        self.parts: list[list[bytes]] = [[] for _ in range(level + 1)]

    def low(self) -> int:
        """The level of its lowest node; past all levels when nothing is left to do."""
        if self.at >= self.last:
            return 1 << 30
        return next((j for j, p in enumerate(self.parts[: self.level]) if p), self.level)

    def add(self, leaf: bytes) -> None:
        self.at += 1
        self._put(0, leaf)
        if self.at >= self.last:  # a short run becomes a node of its own
            for j in range(self.level):
                if self.parts[j]:
                    parts, self.parts[j] = self.parts[j], []
                    self._put(j + 1, node(parts))

    def _put(self, j: int, digest: bytes) -> None:
        self.parts[j].append(digest)
        while j < self.level and len(self.parts[j]) == ARITY:
            parts, self.parts[j] = self.parts[j], []
            j += 1
            self.parts[j].append(node(parts))

    @property
    def nodes(self) -> list[bytes]:
        return self.parts[self.level]

    def count(self) -> int:
        return sum(map(len, self.parts))


def root_of(leaves: list[bytes], levels: int) -> bytes:
    """The node so many levels above at most ARITY ** levels leaves."""
    tree = Treehash(levels, 0, ARITY**levels, len(leaves))
    for leaf in leaves:
        tree.add(leaf)
    return tree.nodes[0]


class Walk:
    """The paths of a block's leaves, one after the other: per level the nodes of the run that the leaf is in, and its place there."""

    def __init__(self, leaves: list[bytes], levels: int):
        self.leaves, self.levels = leaves, levels
        self.run = [Treehash(j, 0, ARITY ** (j + 1), len(leaves)) for j in range(levels)]
        self.late = self.held = 0
        for tree in self.run:  # the first runs; from then on the stacks keep ahead
            while tree.at < tree.last:
                tree.add(leaves[tree.at])
        self.nodes = [tree.nodes for tree in self.run]
        self.ahead = [self._next(j, 0) for j in range(levels)]

    def _next(self, j: int, first: int) -> Treehash:
        width = ARITY ** (j + 1)
        return Treehash(j, first + width, first + 2 * width, len(self.leaves))

    def paths(self) -> Iterator[list[tuple[list[bytes], int]]]:
        for t in range(len(self.leaves)):
            for j in range(self.levels):
                if t and t % ARITY ** (j + 1) == 0:  # the walk enters the next run of this level
                    tree = self.ahead[j]
                    while tree.at < tree.last:
                        self.late += 1
                        tree.add(self.leaves[tree.at])
                    self.nodes[j], self.ahead[j] = tree.nodes, self._next(j, t)
            yield [(self.nodes[j], t // ARITY**j % ARITY) for j in range(self.levels)]
            for _ in range(self.levels):
                tree = min(self.ahead, key=Treehash.low, default=None)
                if tree is None or tree.at >= tree.last:
                    break
                tree.add(self.leaves[tree.at])
            self.held = max(self.held, sum(map(len, self.nodes)) + sum(tree.count() for tree in self.ahead))


def pack(path: list[tuple[list[bytes], int]]) -> bytes:
    """A path as bytes: per level the number of siblings to the left and in all, then the siblings."""
    return b"".join(bytes([at, len(nodes) - 1]) + b"".join(nodes[:at] + nodes[at + 1 :]) for nodes, at in path)


def unpack(path: bytes) -> list[tuple[bytes, bytes]]:
    """Per level what stands left and right of the own node."""
    out, i = [], 0
    while i < len(path):
        left, both = path[i], path[i + 1]
        i += 2
        out.append((path[i : i + left * WIDE], path[i + left * WIDE : i + both * WIDE]))
        i += both * WIDE
    return out


def fold(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = hashlib.sha256(left + leaf + right).hexdigest().encode()
    return leaf


def _field(x: Column) -> Column:
    text = x.cast("string")
    return F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(text: Column) -> Column:
    """The digest of a row whose text is so: doc_id, source, lang, n_chars and text, each with its length."""
    return F.sha2(F.concat(*map(_field, (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text))), 256)


def _ranked(nodes: DataFrame, scratch: Scratch, name: str, order: list[str]) -> DataFrame:
    """nodes with at, their place in their tree by order, and n, the tree's size.

    Ranges of the order are numbered each by itself; per tree a window holds its ranges, never its rows.
    """
    spread = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    spread = scratch.write(spread.withColumn("id", F.monotonically_increasing_id()), name)
    part = F.shiftright("id", 33)
    ranges = spread.groupBy("tree", part.alias("part")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows"))
    own = Window.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(own).alias("n"))
    placed = spread.withColumn("part", part).join(ranges, ["tree", "part"])
    return placed.select(*nodes.columns, (F.col("id") + F.col("shift")).alias("at"), "n")


def _block(levels: int):
    size = ARITY**levels

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        n = int(rows["n"].iloc[0])
        digests = [x.encode() for x in rows["digest"]]
        out = {"tree": rows["tree"].iloc[0], "block": int(rows["at"].iloc[0]) // size, "n": n, "last": n <= size, "digests": b"".join(digests)}
        out["digest"] = root_of(digests, depth(n) if n <= size else levels).decode()
        if "changed" in rows:
            out |= {"ids": [None if pd.isna(x) else int(x) for x in rows["doc_id"]], "changed": [x or "" for x in rows["changed"]]}
        return pd.DataFrame([out])

    return run


BLOCKS = "tree string, block long, n long, last boolean, digests binary, digest string"


def _blocks(placed: DataFrame, scratch: Scratch, name: str, levels: int) -> DataFrame:
    """A row for each aligned block of a tree: its leaves and its node."""
    extra = ", ids array<long>, changed array<string>" if "changed" in placed.columns else ""
    return scratch.write(placed.groupBy("tree", F.expr(f"at div {ARITY**levels}")).applyInPandas(_block(levels), BLOCKS + extra), name)


def _paths(blocks: DataFrame, levels: int) -> DataFrame:
    """The path and the subroot of every node below blocks (with upper, the path of each block's own node): tree, at, subroot, path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, block, n, last, digests, subroot, upper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                leaves = [digests[i : i + WIDE] for i in range(0, len(digests), WIDE)]
                paths = [pack(p) + upper for p in Walk(leaves, depth(n) if last else levels).paths()]
                at = block * ARITY**levels + np.arange(len(leaves))
                yield pa.RecordBatch.from_arrays([pa.array([tree] * len(at), pa.string()), pa.array(at), pa.array([subroot] * len(at), pa.string()), pa.array(paths, pa.binary())], ["tree", "at", "subroot", "path"])

    return blocks.select("tree", "block", "n", "last", "digests", "subroot", "upper").mapInArrow(run, "tree string, at long, subroot string, path binary")


def _proven(root: str, levels: int):
    end = root.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, last, digests, ids, changed, subroot, upper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                leaves = [digests[i : i + WIDE] for i in range(0, len(digests), WIDE)]
                shared = unpack(upper)
                above = b"".join(a + b for a, b in shared)
                rows = []
                for i, path in enumerate(Walk(leaves, depth(n) if last else levels).paths()):
                    own = [(b"".join(nodes[:at]), b"".join(nodes[at + 1 :])) for nodes, at in path]
                    proof = hashlib.sha256(b"".join(a + b for a, b in own) + above).hexdigest()
                    got = fold(changed[i].encode() or leaves[i], own + shared)
                    rows.append((ids[i], leaves[i].decode(), subroot, root, proof, got.decode(), got == end))
                kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in MANIFEST.split(", ")])

    return run


MANIFEST = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def merkle_manifest(spark: SparkSession, docs: DataFrame, tampered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for every row of docs.

    tampered: the text as it is found when the manifest is checked, null where it is as it was. levels: of a block, which does
    not change the result.

    Defined cases: a null field counts as `-`, so null and empty text differ; of a text of any length every byte counts;
    null doc_ids come first in their source, and rows that repeat a doc_id ascend by leaf; a null source is a source of its
    own, the first; an empty table gives an empty result; other columns of docs are ignored.
    """
    scratch, size = Scratch(spark, "merkle"), ARITY**levels
    tree = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source")))  # null first, then by bytes
    changed = F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull(), leaf_of(tampered))
    leaves = scratch.write(docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(F.col("text")).alias("digest"), changed.alias("changed")), "leaves")

    def grown(blocks: DataFrame, name: str) -> list[DataFrame]:
        """The tables of blocks from the leaves' up to the one whose every tree is a single block."""
        tables = [blocks]
        while not tables[-1].filter("not last").isEmpty():
            low = tables[-1].filter("not last")
            up = low.select("tree", "digest", F.col("block").alias("at"), F.expr(f"(n + {size - 1}) div {size}").alias("n"))
            tables.append(_blocks(up, scratch, f"{name}{len(tables)}", levels))
        return tables

    def lowered(tables: list[DataFrame], top: DataFrame, name: str) -> DataFrame:
        """The lowest of the tables with, for each block, the tree's root (subroot) and the path from its node (upper); top: those of the trees."""
        below = None
        for k in range(len(tables) - 1, -1, -1):
            met = tables[k].filter("last").join(top, "tree")
            if below is not None:
                met = met.unionByName(tables[k].filter("not last").join(below, ["tree", "block"]))
            if k:
                below = scratch.write(_paths(met, levels).withColumnsRenamed({"at": "block", "path": "upper"}), f"{name}{k}")
        return met

    own = grown(_blocks(_ranked(leaves, scratch, "numbered", ["doc_id", "digest"]), scratch, "blocks", levels), "level")
    subroots = own[0].filter("last").select("tree", "digest")
    for table in own[1:]:
        subroots = subroots.unionByName(table.filter("last").select("tree", "digest"))
    sources = scratch.write(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"), "subroots")
    ranked = scratch.write(_ranked(sources, scratch, "order", ["source"]), "sources")
    top = grown(_blocks(ranked.drop("source"), scratch, "top", levels), "top")
    root = top[-1].filter("last").select("digest").first()
    root = root[0] if root else ""
    above = lowered(top, top[-1].filter("last").select("tree", F.lit("").alias("subroot"), F.lit(b"").alias("upper")), "above")
    named = _paths(above, levels).select("at", F.col("path").alias("upper")).join(ranked, "at")
    roots = scratch.write(named.select(F.col("source").alias("tree"), F.col("digest").alias("subroot"), "upper"), "roots")
    met = lowered(own, roots, "down")
    return met.select("n", "last", "digests", "ids", "changed", "subroot", "upper").mapInArrow(_proven(root, levels), MANIFEST)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, checked against texts that lost their line ends where 2 divides the id's CRC."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lost = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", ""))
    return merkle_manifest(spark, docs.select("doc_id", "source", "lang", "n_chars", "text"), lost)


#: CRC-32 of an id as text; a field with its length.
_CRC = "xor(list_reduce(list_prepend(4294967295, [ascii(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]), lambda c, x: list_reduce(list_prepend(xor(c, x), [y::BIGINT FOR y IN range(8)]), lambda a, y: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"
_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_HEAD = " || ".join(_FIELD.format(x) for x in ("doc_id", "source", "lang", "n_chars"))
OP11_SQL = f"""
WITH RECURSIVE
  d AS (SELECT doc_id, source, sha256({_HEAD} || {_FIELD.format("text")}) AS leaf,
               CASE WHEN {_CRC} % 2 = 0 THEN sha256({_HEAD} || {_FIELD.format("replace(text, chr(10), '')")}) END AS changed FROM documents),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
  nodes AS (SELECT source, 0 AS level, 1::BIGINT AS w, pos, leaf AS h, n FROM ranked
            UNION ALL
            SELECT source, level + 1, w * 3, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY source, level, w, pos // 3, n),
  subs AS (SELECT source, level AS height, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS sources FROM nodes WHERE n = 1),
  tops AS (SELECT 0 AS level, 1::BIGINT AS w, place AS pos, subroot AS h, sources AS n FROM subs
           UNION ALL
           SELECT level + 1, w * 3, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, w, pos // 3, n),
  runs AS (SELECT source, level, w, pos // 3 AS run, pos % 3 AS i, h FROM nodes WHERE n > 1),
  top_runs AS (SELECT level, w, pos // 3 AS run, pos % 3 AS i, h FROM tops WHERE n > 1),
  beside AS (SELECT r.doc_id, r.leaf, r.source, s.level, string_agg(s.h, '' ORDER BY s.i) FILTER (WHERE s.i < (r.pos // s.w) % 3) AS l, string_agg(s.h, '' ORDER BY s.i) FILTER (WHERE s.i > (r.pos // s.w) % 3) AS r
             FROM ranked r JOIN runs s ON s.source IS NOT DISTINCT FROM r.source AND s.run = r.pos // (s.w * 3) GROUP BY r.doc_id, r.leaf, r.source, s.level, s.w, r.pos),
  top_beside AS (SELECT s.source, s.height + t.level AS level, string_agg(t.h, '' ORDER BY t.i) FILTER (WHERE t.i < (s.place // t.w) % 3) AS l, string_agg(t.h, '' ORDER BY t.i) FILTER (WHERE t.i > (s.place // t.w) % 3) AS r
                 FROM subs s JOIN top_runs t ON t.run = s.place // (t.w * 3) GROUP BY s.source, s.height, s.place, t.level, t.w),
  path AS (SELECT doc_id, leaf, level, coalesce(l, '') AS l, coalesce(r, '') AS r FROM beside
           UNION ALL SELECT d.doc_id, d.leaf, t.level, coalesce(t.l, ''), coalesce(t.r, '') FROM d JOIN top_beside t ON t.source IS NOT DISTINCT FROM d.source),
  proof AS (SELECT doc_id, leaf, sha256(string_agg(l || r, '' ORDER BY level)) AS proof_sha256 FROM path GROUP BY doc_id, leaf),
  folded AS (SELECT doc_id, leaf, 0 AS level, coalesce(changed, leaf) AS h FROM d
             UNION ALL SELECT f.doc_id, f.leaf, f.level + 1, sha256(p.l || f.h || p.r) FROM folded f JOIN path p ON p.doc_id = f.doc_id AND p.leaf = f.leaf AND p.level = f.level),
  last AS (SELECT doc_id, leaf, arg_max(h, level) AS folded_root FROM folded GROUP BY doc_id, leaf)
SELECT d.doc_id, d.leaf, s.subroot, t.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, l.folded_root, l.folded_root = t.h AS verified
FROM d JOIN subs s ON s.source IS NOT DISTINCT FROM d.source JOIN last l USING (doc_id, leaf) LEFT JOIN proof p USING (doc_id, leaf) CROSS JOIN (SELECT h FROM tops WHERE n = 1) t
"""
