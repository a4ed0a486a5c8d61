"""Post-conditions as tables: recorded values against measured ones, and gates that a run must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reproduced(measured: DataFrame, recorded: DataFrame, drift: float = 0.01) -> DataFrame:
    """field, want, got, status: OK where equal, DRIFT within the allowed share, FAIL beyond; NEW where nothing is recorded,
    MISSING where nothing is measured. Both tables are (field, value)."""
    both = recorded.select("field", F.col("value").alias("want")).join(measured.select("field", F.col("value").alias("got")), "field", "full_outer")
    near = F.abs(F.col("got") - F.col("want")) <= drift * F.abs(F.col("want"))
    status = F.when(F.col("want").isNull(), "NEW").when(F.col("got").isNull(), "MISSING").when(F.col("got") == F.col("want"), "OK").when(near, "DRIFT").otherwise("FAIL")
    return both.withColumn("status", status)


def gates(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """gate, passed: each condition is an aggregate over rows; null counts as failed."""
    one = rows.agg(*(F.coalesce(c, F.lit(False)).alias(k) for k, c in conditions.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("gate"), F.col(k).alias("passed")) for k in conditions))).alias("x")).select("x.*")


def split_gates(split: str, kept: Column) -> dict[str, Column]:
    """No split is empty, and half of the rows at least are kept."""
    some = lambda s: F.count(F.when(F.col(split) == s, 1)) > 0
    return {"train_rows": some("train"), "val_rows": some("val"), "test_rows": some("test"), "half_kept": F.avg(kept.cast("double")) >= 0.5}


def matched_gate(matched: Column, least: float = 0.99) -> dict[str, Column]:
    """The share of rows that a join found."""
    return {"join_matched": F.avg(matched.cast("double")) >= least}


def blank_gate(completion: Column, most: float = 0.02) -> dict[str, Column]:
    """The share of blank completions."""
    return {"completions_blank": F.avg((F.trim(F.coalesce(completion, F.lit(""))) == "").cast("double")) <= most}


def saturated(base: Column, at: float = 0.999, most: float = 0.5) -> dict[str, Column]:
    """Too many items that the base gets right already leave nothing to tell arms apart by."""
    return {"not_saturated": F.avg((base >= at).cast("double")) <= most}


def synthesis_gates(arm: str, mode: str, split: str, leaks: Column, detected: Column, trained: tuple[str, ...], held: tuple[str, ...], coverage: tuple[float, float], most: float = 0.02) -> dict[str, Column]:
    """What a synthesized set must keep to: rows from train only, as many clean rows as defective ones (within a tenth),
    every trained mode and no held-out one, a detector that finds neither all nor none, and few targets that quote what
    the return no longer holds."""
    bad, clean = F.count(F.when(F.col(arm) == "defective", 1)), F.count(F.when(F.col(arm) == "clean", 1))
    seen = lambda modes: F.count_distinct(F.when(F.col(mode).isin(*modes), F.col(mode)))
    found = F.avg(F.when(F.col(arm) == "defective", detected.cast("double")))
    return {
        "some_rows": F.count(F.lit(1)) > 0, "train_only": F.count(F.when(F.col(split) != "train", 1)) == 0, "twins": F.abs(clean / bad - 1) <= 0.1,
        "all_trained": seen(trained) == len(trained), "none_held_out": seen(held) == 0, "coverage": found.between(*coverage), "leaks": F.avg(leaks.cast("double")) <= most,
    }
