"""Duplicates: first writer wins, duplicate accounting, overlap between corpora, prompt purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.sample import first_k

from corpusloom.functions.text import joined_hash, normalize


def first_wins(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key, by order; the key's group is combined map-side, never gathered. Rows without a key go."""
    first = rows.filter(key.isNotNull()).groupBy(key.alias("_key")).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_first"))
    return first.select("_first.*")


def prompt_key(text: Column) -> Column:
    return F.md5(normalize(text))


def triple_key(prompt: Column, tools: Column, answer: Column) -> Column:
    """The key of a training row: normalized prompt, tool set, answer."""
    return joined_hash(normalize(prompt), F.coalesce(tools, F.lit("no-tools")), F.coalesce(answer, F.lit("")))


def duplicate_stats(rows: DataFrame, key: Column, by: list[str] | None = None) -> DataFrame:
    """Distinct keys, groups of two and more, rows in them, and rows beyond the first of each group."""
    by = by or []
    groups = rows.groupBy(*by, key.alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy(*by).agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.count(F.when(F.col("n") > 1, 1)).alias("n_dup_groups"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_dup_rows"),
        (F.sum("n") - F.count(F.lit(1))).alias("n_removable"),
    )


def cross_overlap(rows: DataFrame, key: Column, corpus: str) -> DataFrame:
    """How many keys occur in several corpora, by the sorted list of these."""
    groups = rows.groupBy(key.alias("_key")).agg(F.array_sort(F.collect_set(corpus)).alias("c")).filter(F.size("c") > 1)
    return groups.groupBy(F.array_join("c", " | ").alias("corpora")).agg(F.count(F.lit(1)).alias("n_keys"))


def first_split(rows: DataFrame, key: Column, split: str, order: list[str]) -> DataFrame:
    """Rows whose split is that of the first row with the same prompt."""
    firsts = rows.groupBy(key.alias("_key")).agg(F.min_by(split, F.struct(*order)).alias("_split"))
    return rows.withColumn("_key", key).join(firsts, "_key").filter(F.col(split) == F.col("_split")).drop("_key", "_split")


def contradictions(rows: DataFrame, key: Column, kind: str, most: int | None = None, order: str | None = None) -> DataFrame:
    """Rows whose prompt has several kinds of answer; with `most`, the first so many of a prompt by order only."""
    mixed = rows.groupBy(key.alias("_key")).agg((F.min(kind) != F.max(kind)).alias("_mixed")).filter("_mixed").select("_key")
    out = rows.withColumn("_key", key).join(mixed, "_key", "left_semi")
    if most is not None:
        out = first_k(out, ["_key"], [order], most)
    return out.drop("_key")
