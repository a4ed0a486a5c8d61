"""Profiles: nulls, lengths, histograms, group concentration, estimated tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.ranks import running


def nulls(rows: DataFrame) -> DataFrame:
    """A row for each column: rows, nulls, and blank strings (white space only), in one pass."""
    cells = []
    for c, kind in rows.dtypes:
        blank = F.sum((F.trim(F.col(c)) == "").cast("long")) if kind == "string" else F.lit(0).cast("long")
        cells += [F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{c}"), F.coalesce(blank, F.lit(0)).alias(f"blank_{c}")]
    one = rows.agg(F.count(F.lit(1)).alias("n_rows"), *cells)
    each = [F.struct(F.lit(c).alias("field"), F.col(f"null_{c}").alias("n_null"), F.col(f"blank_{c}").alias("n_blank")) for c in rows.columns]
    return one.select("n_rows", F.explode(F.array(*each)).alias("x")).select("x.field", "n_rows", "x.n_null", "x.n_blank")


def percentiles(value: Column) -> list[Column]:
    """Aggregates: n, mean (2 places), p50, p90 and p99 by linear interpolation, largest."""
    cut = lambda q: F.percentile(value, F.lit(q)).alias(f"p{int(q * 100)}")
    return [F.count(value).alias("n"), F.round(F.avg(value), 2).alias("mean"), cut(0.5), cut(0.9), cut(0.99), F.max(value).alias("largest")]


def index_percentiles(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Medians and other cuts taken from the sorted values by index: n//2, int(0.9 (n-1)), n//4 and 3n//4."""
    cells = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running(cells, by, value, {"_i": F.col("_c")})
    n = F.col("_i_all")
    cuts = {"median": F.floor(n / 2), "p90": F.floor(0.9 * (n - 1)), "q1": F.floor(n / 4), "q3": F.floor(3 * n / 4)}
    own = lambda at: (F.col("_i") <= at) & (at < F.col("_i") + F.col("_c"))
    return ranked.groupBy(*by).agg(*(F.max(F.when(own(at), F.col(value))).alias(k) for k, at in cuts.items()))


def top_values(rows: DataFrame, value: str, k: int) -> DataFrame:
    """The k most frequent values; ties: the smaller value."""
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), value).limit(k)


def flag_sums(rows: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    """Rows, and how many have each condition, in one aggregation."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(k) for k, c in flags.items()))


def concentration(rows: DataFrame, namespace: str, group: str) -> DataFrame:
    """Per namespace: groups, percentiles of their sizes, the share of the largest and of the ten largest."""
    sizes = rows.groupBy(namespace, group).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(namespace).orderBy(F.desc("n"), group))
    return sizes.withColumn("rank", rank).groupBy(namespace).agg(
        F.count(F.lit(1)).alias("n_groups"), F.percentile("n", F.lit(0.5)).alias("p50"), F.max("n").alias("largest"),
        (F.max("n") / F.sum("n")).alias("largest_share"), (F.sum(F.when(F.col("rank") <= 10, F.col("n"))) / F.sum("n")).alias("top10_share"),
    )


def size_histogram(rows: DataFrame, group: Column) -> DataFrame:
    """How many groups have each size."""
    return rows.groupBy(group.alias("_g")).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n_groups"))


def estimated_tokens(rows: DataFrame, by: list[str], length: Column, sampled: Column) -> DataFrame:
    """Mean length of the sampled rows times all rows."""
    return rows.groupBy(*by).agg((F.avg(F.when(sampled, length)) * F.count(F.lit(1))).alias("tokens"), F.count(F.lit(1)).alias("n_rows"))


def macro_micro(rows: DataFrame, category: str, correct: Column, by: list[str] | None = None) -> DataFrame:
    """The mean of the categories' means, and the mean over items."""
    by = by or []
    cells = rows.groupBy(*by, category).agg(F.avg(correct.cast("double")).alias("acc"), F.count(F.lit(1)).alias("n"), F.sum(correct.cast("long")).alias("k"))
    return cells.groupBy(*by).agg(F.avg("acc").alias("macro"), (F.sum("k") / F.sum("n")).alias("micro"), F.count(F.lit(1)).alias("n_categories"), F.sum("n").alias("n_items"))


def pooled_rates(rows: DataFrame, by: str, correct: Column, pools: dict[str, Column]) -> DataFrame:
    """A rate for each value of by, and for pooled subsets; null where a subset is empty."""
    rate = [F.avg(correct.cast("double")).alias("rate"), F.count(F.lit(1)).alias("n")]
    parts = [rows.groupBy(F.col(by).alias("arm")).agg(*rate)]
    parts += [rows.filter(c).agg(*rate).select(F.lit(k).alias("arm"), "rate", "n") for k, c in pools.items()]
    return reduce(DataFrame.unionByName, parts)
