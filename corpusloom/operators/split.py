"""Group-disjoint train, validation and test splits, the leakage audit, and the purity check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import joined_hash
from corpusloom.operators.ranks import running

#: A group of more than this share of its namespace goes to train; shares of test and validation; their part of free rows.
COLLAPSE, TEST, VALIDATION, ROOM = 0.02, 0.05, 0.05, 0.4


def assign(rows: DataFrame, namespace: str, group: str, salt: str = "0") -> DataFrame:
    """namespace, group, n_rows, split: whole groups, in the order of a salted hash, fill test, then validation.

    Test takes the groups before which fewer rows than it wants have gone; of what follows, validation does the same;
    the rest, and groups too large for their namespace, are train. Rows before a group are running sums by spans of the
    hashes, so no task holds the groups of a namespace. Of groups that share 60 bits of their hash, either may come first.
    """
    groups = rows.groupBy(namespace, group).agg(F.count(F.lit(1)).alias("n_rows"))
    totals = groups.groupBy(F.col(namespace).alias("_ns")).agg(F.sum("n_rows").alias("total"))
    same = F.col(namespace).eqNullSafe(F.col("_ns"))
    sized = groups.join(totals, same).drop("_ns").withColumn("large", F.col("n_rows") > COLLAPSE * F.col("total"))
    number = F.conv(F.substring(joined_hash(F.col(namespace), F.col(group), F.lit(salt)), 1, 15), 16, 10).cast("long")
    placed = running(sized.withColumn("hash", number), [namespace, "large"], "hash", {"before": F.col("n_rows")})
    # Small groups alone are free to go anywhere, and before_all is their sum.
    want = {k: F.least(share * F.col("total"), ROOM * F.col("before_all")) for k, share in (("test", TEST), ("val", VALIDATION))}
    placed = placed.withColumn("is_test", ~F.col("large") & (F.col("before") < want["test"]))
    taken = placed.groupBy(F.col(namespace).alias("_ns")).agg(F.sum(F.when(F.col("is_test"), F.col("n_rows")).otherwise(0)).alias("taken"))
    placed = placed.join(taken, same).drop("_ns")
    is_val = ~F.col("large") & (F.col("before") - F.col("taken") < want["val"])
    split = F.when(F.col("is_test"), "test").when(is_val, "val").otherwise("train")
    return placed.select(namespace, group, "n_rows", split.alias("split"))


def manifest(rows: DataFrame, namespace: str, group: str, prompt: Column, salt: str = "0") -> DataFrame:
    """rows with s0 (the split of their group) and s: held-out rows whose prompt is in train as well are dropped, test
    rows whose prompt is also in validation go to validation."""
    given = assign(rows, namespace, group, salt).select(F.col(namespace).alias("_ns"), F.col(group).alias("_g"), F.col("split").alias("s0"))
    out = rows.join(given, F.col(namespace).eqNullSafe(F.col("_ns")) & F.col(group).eqNullSafe(F.col("_g"))).drop("_ns", "_g").withColumn("_prompt", prompt)
    has = lambda s: F.max((F.col("s0") == s).cast("int")).alias(f"_{s}")
    out = out.join(out.groupBy("_prompt").agg(has("train"), has("val"), has("test")), "_prompt")
    s = (
        F.when((F.col("s0") != "train") & (F.col("_train") == 1), "drop")
        .when((F.col("s0") == "test") & (F.col("_val") == 1), "val")
        .otherwise(F.col("s0"))
    )
    return out.withColumn("s", s).drop("_prompt", "_train", "_val", "_test")


def straddles(rows: DataFrame, prompt: Column, split: str = "s0") -> DataFrame:
    """Prompts that occur in several splits, counted by the sorted list of these."""
    seen = rows.groupBy(prompt.alias("_prompt")).agg(F.array_sort(F.collect_set(split)).alias("splits"), F.count(F.lit(1)).alias("n"))
    return seen.filter(F.size("splits") > 1).groupBy(F.array_join("splits", "|").alias("splits")).agg(F.count(F.lit(1)).alias("n_prompts"), F.sum("n").alias("n_rows"))


def impure(rows: DataFrame, prompt: Column, split: str = "s") -> DataFrame:
    """The number of prompts that are still in several splits (dropped rows aside): it must be 0."""
    seen = rows.filter(F.col(split) != "drop").groupBy(prompt.alias("_prompt")).agg(F.count_distinct(split).alias("n"))
    return seen.agg(F.count(F.when(F.col("n") > 1, 1)).alias("n_impure"), F.count(F.lit(1)).alias("n_prompts"))


def held_out(test: DataFrame, train: DataFrame, group: str) -> DataFrame:
    """Test rows whose group training has not seen; rows without a group stay."""
    return test.join(train.select(group).distinct(), group, "left_anti")
