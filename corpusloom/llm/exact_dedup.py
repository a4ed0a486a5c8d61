"""Exact dedup against a minimal perfect hash over historical digests.

The history's distinct SHA-256 digests are dealt by prefix into shards of bounded size; each shard becomes a minimal
perfect hash whose slots hold the whole 32-byte digest, the winner's doc_id (its locator) and the group's size so far.
A new digest is a member only if all 32 bytes in its slot agree; members are settled in their slot, nonmembers are
grouped among themselves.

Hot digests never meet in one task: rows are combined per digest (map-side first) before they are dealt out, and the
way back joins digests, never texts, with the groups of two rows and more, which adaptive execution splits when skewed.
unique() then leaves copies out where the texts are read: a decision is an entry in an array for their file.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, chosen, fresh, located, lower_ascii

#: Distinct digests in a shard, about; a shard is about 4 MB.
SHARD = 50_000
#: Bits for each key that a level of the hash offers.
GAMMA = 1.6
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """A key's bit at a level: each level mixes the digest's four 64-bit words anew."""
    h = words[:, level % 4] ^ (words[:, (level + 1) % 4] * _MIX * np.uint64(2 * level + 1))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return (h % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash over distinct 32-byte digests: n keys to the slots 0..n-1.

    Each level has a bit array; keys that have a bit to themselves take it, the others go to the next level. A key's
    slot is the number of set bits before its own.
    """

    def __init__(self, digests: np.ndarray):
        left = np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        base = 0
        while len(left):
            size = max(4, int(len(left) * GAMMA))
            at = _place(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            rank = base + np.cumsum(alone) - 1
            self.levels.append((alone, rank))
            base += int(alone.sum())
            left = left[~alone[at]]
            if len(self.levels) > 200:
                raise ValueError("the digests are not distinct")
        self.n = base

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The only slot that each digest can have; -1 where none."""
        words = np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)
        out = np.full(len(words), -1, dtype=np.int64)
        rest = np.arange(len(words))
        for level, (alone, rank) in enumerate(self.levels):
            if not len(rest):
                break
            at = _place(words[rest], level, len(alone))
            hit = alone[at]
            out[rest[hit]] = rank[at[hit]]
            rest = rest[~hit]
        return out


def _bytes(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 32)


def _wins(has: np.ndarray, top: np.ndarray, had: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Whether (has, top) comes after (had, best): a row without an id loses to any other."""
    return (has > had) | ((has == had) & (top > best))


def _probe(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    """One shard: its groups of two rows and more.

    A slot of the perfect hash over the historical digests holds the digest, the winner and the sizes so far. New digests
    that agree with their slot in all bytes join its group there; the others are groups of their own.
    """
    fields = ["digest", "has", "top", "tops", "n"]
    old, new = old.reindex(columns=fields), new.reindex(columns=fields)  # an empty side comes without columns
    groups, rest = old, new
    if len(old) and len(new):
        have, asked = _bytes(old["digest"]), _bytes(new["digest"])
        mph = PerfectHash(have)
        at = mph.slots(have)
        stored, slots = np.empty_like(have), {c: np.empty(len(old), dtype=old[c].dtype) for c in fields}
        stored[at] = have
        for c in fields:
            slots[c][at] = old[c].to_numpy()
        slot = mph.slots(asked)
        found = slot >= 0
        found[found] = (stored[slot[found]] == asked[found]).all(axis=1)
        member, slot, rest = new[found], slot[found], new[~found]
        has, top, tops = (member[c].to_numpy() for c in ("has", "top", "tops"))
        later = _wins(has, top, slots["has"][slot], slots["top"][slot])
        tied = (has == slots["has"][slot]) & (top == slots["top"][slot])
        slots["tops"][slot] = np.where(later, tops, slots["tops"][slot] + np.where(tied, tops, 0))
        slots["has"][slot], slots["top"][slot] = np.where(later, has, slots["has"][slot]), np.where(later, top, slots["top"][slot])
        slots["n"][slot] += member["n"].to_numpy()
        groups = pd.DataFrame(slots)
    out = pd.concat([part for part in (groups, rest) if len(part)], ignore_index=True)
    return out[out["n"] > 1]


def digest_of(text: F.Column) -> F.Column:
    """The digest that equal texts share."""
    return F.sha2(lower_ascii(F.coalesce(text, F.lit(""))), 256)


def exact_dedup(spark: SparkSession, docs: DataFrame, history: F.Column | None = None, sha: F.Column | None = None) -> DataFrame:
    """The documents with keep_id, group_size, kept and text_sha256.

    history says which rows are the historical ones, whose distinct digests the perfect hash covers; the default is the
    upper half of the id range. Historical winners beat new rows only if their doc_id is larger, so the result is the
    same for any choice: of equal texts the row with the largest doc_id stays. sha: the digests of the texts, where docs
    have them already.

    Defined cases: a null text is the empty text; a text of any length is one digest; an empty table gives an empty
    result; a null doc_id loses to any other; where several rows of a group have the winning doc_id (or none has an id),
    one of them is kept and the others are not. Columns that docs carries already under these four names are replaced.
    """
    sha = digest_of(F.col("text")) if sha is None else sha
    docs = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    if history is None:
        low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
        history = F.lit(False) if low is None else F.col("doc_id") >= F.lit((low + high + 1) // 2)
    scratch = Scratch(spark, "exact")
    keyed = docs.select("doc_id", F.unhex(sha).alias("digest"), F.coalesce(history, F.lit(False)).alias("old"))
    each = keyed.groupBy("digest", "old", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    lead = F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("top"), F.col("c").alias("tops")))
    each = each.groupBy("digest", "old").agg(lead.alias("lead"), F.sum("c").alias("n")).select("digest", "old", "lead.*", "n")
    each = scratch.write(each, "digests")
    shards = max(1, -(-each.count() // SHARD))
    each = each.withColumn("shard", F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(shards)))
    side = lambda which: each.filter(which).select(*(F.col(c).alias(c) for c in ("shard", "digest", "has", "top", "tops", "n")))
    groups = side("not old").groupBy("shard").cogroup(side("old").groupBy("shard")).applyInPandas(_probe, "digest binary, has boolean, top long, tops long, n long")

    names: list[str] = []
    for base in ("digest", "keep", "size", "tops", "row"):
        names.append(fresh(docs, f"exact_{base}", names))
    digest, keep, size, tops, row = names
    groups = groups.select(F.col("digest").alias(digest), F.when(F.col("has"), F.col("top")).alias(keep), F.col("n").alias(size), F.col("tops").alias(tops))
    groups = scratch.write(groups, "groups")
    scratch.drop("digests")
    again = groups.filter(F.col(tops) > 1).limit(1).count()
    rows = docs.withColumn(digest, F.unhex(sha)).join(groups, digest, "left")
    top = F.col(size).isNull() | F.col("doc_id").eqNullSafe(F.col(keep))

    def told(part: DataFrame, kept: F.Column) -> DataFrame:
        return part.select(
            *docs.columns,
            F.when(F.col(size).isNull(), F.col("doc_id")).otherwise(F.col(keep)).alias("keep_id"),
            F.coalesce(size, F.lit(1)).cast("long").alias("group_size"),
            kept.alias("kept"),
            F.lower(F.hex(digest)).alias("text_sha256"),
        )

    if not again:
        return told(rows, top)
    # Rows that share the winning doc_id: written once, so that their numbers hold, and the first of each group is kept.
    tied = top & (F.coalesce(tops, F.lit(1)) > 1)
    ties = scratch.write(rows.filter(tied).withColumn(row, F.monotonically_increasing_id()), "ties")
    first = ties.groupBy(digest).agg(F.min(row).alias(row)).withColumn(size, F.lit(True))
    ties = ties.join(first.select(digest, row, F.col(size).alias(f"{size}_")), [digest, row], "left")
    return told(rows.filter(~tied), top).unionByName(told(ties, F.col(f"{size}_").isNotNull()))


def unique(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup does not keep, with the same columns.

    Texts are read twice, for their digests and for what stays, and never shuffled. Defined cases: as of exact_dedup.
    """
    scratch = Scratch(spark, "unique")
    at, file, row = located(scratch, docs)
    own = fresh(at, "digest")
    narrow = scratch.write(at.select("doc_id", file, row, digest_of(F.col("text")).alias(own)), "rows")
    copies = exact_dedup(spark, narrow, sha=F.col(own)).filter("not kept").select(file, row, F.lit(0).alias("n"))
    return chosen(scratch, at, file, row, copies, "copies", otherwise=1)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(spark, docs).drop("text")


OP4_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
           FROM documents),
     g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
