"""Paired comparison of scored runs: occurrence keys, counts, exact tests, corrections, ranking and calibration measures."""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.ranks import running
from corpusloom.operators.tails import exact_two_sided


def occurrence(rows: DataFrame, item: str, order: str, first: bool = False) -> DataFrame:
    """rows with key: the id, and from its second occurrence on `#2`, `#3` (with first, `#1` as well)."""
    n = F.row_number().over(Window.partitionBy(item).orderBy(order))
    tagged = F.concat(F.col(item).cast("string"), F.lit("#"), n)
    return rows.withColumn("key", tagged if first else F.when(n == 1, F.col(item).cast("string")).otherwise(tagged))


def verdicts(rows: DataFrame, correct: str) -> DataFrame:
    """Rows that have a verdict: a missing one is not a wrong one."""
    return rows.filter(F.col(correct).isNotNull())


def unmatched(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, with the side."""
    only = lambda x, y, side: x.select(key).join(y.select(key), key, "left_anti").withColumn("side", F.lit(side))
    return only(a, b, "a").unionByName(only(b, a, "b"))


def paired(ref: Column, cand: Column) -> list[Column]:
    """Aggregates over joined rows: items lost, unchanged, gained, in all."""
    r, c = ref.cast("int"), cand.cast("int")
    count = lambda x: F.count(F.when(x, 1))
    return [count(c < r).alias("n_minus"), count(c == r).alias("n_zero"), count(c > r).alias("n_plus"), F.count(F.lit(1)).alias("n")]


def holm(rows: DataFrame, p: str, family: list[str], tie: str) -> DataFrame:
    """rows with p_holm: step-down over each family, which is a table of comparisons and small by nature."""
    w = Window.partitionBy(*(family or [F.lit(0)]))
    order = w.orderBy(p, tie)
    scaled = (F.count(F.lit(1)).over(w) - F.row_number().over(order) + 1) * F.col(p)
    out = rows.withColumn("_s", F.least(F.lit(1.0), scaled))
    return out.withColumn("p_holm", F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def macro_delta(joined: DataFrame, category: str, ref: str, cand: str) -> DataFrame:
    """Mean over categories of the mean difference, beside the mean over items; rows without a category are counted apart."""
    diff = F.col(cand).cast("int") - F.col(ref).cast("int")
    cells = joined.groupBy(category).agg(F.avg(diff).alias("d"), F.sum(diff).alias("s"), F.count(F.lit(1)).alias("n"))
    known = F.col(category).isNotNull()
    return cells.agg(
        F.avg(F.when(known, F.col("d"))).alias("macro_delta"), (F.sum(F.when(known, F.col("s"))) / F.sum(F.when(known, F.col("n")))).alias("item_delta"),
        F.count(F.when(known, 1)).alias("n_categories"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_without"),
    )


def flips(joined: DataFrame, key: str, category: str, ref: str, cand: str) -> DataFrame:
    """Items whose verdict changed, with what each adds to the macro mean: ±1 / (categories * items of its category)."""
    sizes = joined.groupBy(category).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.count(F.lit(1)).alias("_k"))
    diff = F.col(cand).cast("int") - F.col(ref).cast("int")
    out = joined.withColumn("change", diff).filter("change <> 0").join(sizes, category).join(F.broadcast(total))
    return out.select(key, category, "change", (F.col("change") / (F.col("_k") * F.col("_n"))).alias("implied"))


def transferred(flipped: DataFrame, after: DataFrame, recorded: DataFrame, key: str, category: str, arm: str = "arm") -> DataFrame:
    """What an edit did to arms of which only the macro mean before it is on record: per arm recorded, macro (after the edit),
    observed and implied (differences), residual, n_items (flips taken over) and n_missing (flipped items that it lacks).

    flipped: key and now, the verdicts that flipped items have elsewhere after the edit; an item may have both. after: arm,
    key, category and correct of each arm's items. A flip carries over where the arm's own verdict is one that the item
    flipped to, and then moves the arm's mean by 1 / (categories * items of its category), up where it is right.
    """
    now = flipped.select(key, F.col("now").cast("int").alias("_now")).distinct()
    right = F.col("correct").cast("int")
    cells = after.groupBy(arm, category).agg(F.count(F.lit(1)).alias("_n"), F.sum(right).alias("_r"))
    macros = cells.groupBy(arm).agg(F.avg(F.col("_r") / F.col("_n")).alias("macro"), F.count(F.lit(1)).alias("_k"))
    met = after.select(arm, key, category, right.alias("_c")).join(now.groupBy(key).agg(F.collect_set("_now").alias("_to")), key)  # two verdicts at most
    moved = met.join(cells.select(arm, F.col(category).alias("_of"), "_n"), [arm]).filter(F.col(category).eqNullSafe(F.col("_of")))
    same = F.array_contains("_to", F.col("_c"))
    sums = moved.groupBy(arm).agg(F.sum(F.when(same, (2 * F.col("_c") - 1) / F.col("_n")).otherwise(0.0)).alias("_s"), F.count(F.when(same, 1)).alias("n_items"), F.count_distinct(key).alias("_met"))
    items = now.agg(F.count_distinct(key).alias("_all"))
    out = recorded.select(arm, F.col("macro").alias("recorded")).join(macros, arm).join(sums, arm, "left").na.fill(0, ["_s", "n_items", "_met"]).join(F.broadcast(items))
    observed, implied = F.col("macro") - F.col("recorded"), F.col("_s") / F.col("_k")
    return out.select(arm, "recorded", "macro", observed.alias("observed"), implied.alias("implied"), (observed - implied).alias("residual"), "n_items", (F.col("_all") - F.col("_met")).alias("n_missing"))


def auroc(rows: DataFrame, score: str, positive: Column, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by mid-ranks; null without both classes.

    Ranks come from running counts over the distinct scores, span by span of the scores.
    """
    by = by or []
    cells = rows.groupBy(*by, score).agg(F.sum(positive.cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    ranked = running(cells, by, score, {"below": F.col("n") - F.col("pos")})
    u = F.col("pos") * (F.col("below") + 0.5 * (F.col("n") - F.col("pos")))
    pairs = F.sum("pos") * F.sum(F.col("n") - F.col("pos"))
    return ranked.withColumn("u", u).groupBy(*by).agg(F.when(pairs > 0, F.sum("u") / pairs).alias("auroc"), F.sum("n").alias("n"))


def ece(rows: DataFrame, score: str, positive: Column, bins: int = 10) -> DataFrame:
    """Expected calibration error; a score of 1 counts in the last bin."""
    cells = rows.groupBy(F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("conf"), F.avg(positive.cast("double")).alias("acc")
    )
    return cells.agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def operating_points(rows: DataFrame, score: str, positive: Column, budgets: list[float]) -> DataFrame:
    """For each budget of false alarms the smallest threshold that keeps it, with its false alarms and hits."""
    cells = rows.groupBy(score).agg(F.sum(positive.cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    ranked = running(cells, [], score, {"hit": F.col("pos"), "miss": F.col("n") - F.col("pos")})
    share = lambda c: (F.col(f"{c}_all") - F.col(c)) / F.col(f"{c}_all")
    curve = ranked.select(F.col(score).alias("threshold"), share("miss").alias("false_alarms"), share("hit").alias("hits"))
    best = [F.min(F.when(F.col("false_alarms") <= b, F.struct("threshold", "false_alarms", "hits"))).alias(f"b{i}") for i, b in enumerate(budgets)]
    one = curve.agg(*best)
    points = F.array(*(F.struct(F.lit(float(b)).alias("budget"), F.col(f"b{i}").alias("p")) for i, b in enumerate(budgets)))
    return one.select(F.explode(points).alias("x")).select("x.budget", "x.p.threshold", "x.p.false_alarms", "x.p.hits")


def suspicion(yes: Column, no: Column) -> Column:
    """P(no) over both; null where they are too small to tell."""
    return F.when(yes + no >= 1e-6, no / (yes + no))


def peakedness(samples: DataFrame, key: str, sample: str, greedy: str, alpha: float = 0.05, most: int = 100) -> DataFrame:
    """Per key: peak and n_within (share and number of its samples within the edit threshold of the greedy one), n_exact,
    n_distinct, threshold and n. Every sample row carries the key's greedy one.

    Equal samples are counted before they are compared, and nothing is gathered per key.
    """
    cells = samples.groupBy(key, sample).agg(F.min(greedy).alias("_g"), F.count(F.lit(1)).alias("_n"))
    limits = cells.groupBy(key).agg(F.greatest(F.max(F.length(sample)), F.max(F.length("_g"))).alias("_l"))
    limits = limits.select(key, F.floor(alpha * F.least("_l", F.lit(most))).cast("int").alias("threshold"))
    near = F.levenshtein(sample, "_g") <= F.col("threshold")
    count = lambda which: F.coalesce(F.sum(F.when(which, F.col("_n"))), F.lit(0))
    out = cells.join(limits, key).groupBy(key).agg(
        (count(near) / F.sum("_n")).alias("peak"), count(near).alias("n_within"), count(F.col(sample) == F.col("_g")).alias("n_exact"),
        F.count(F.lit(1)).alias("n_distinct"), F.first("threshold").alias("threshold"), F.sum("_n").alias("n"),
    )
    return out


def retention(rates: DataFrame, axis: str, arm: str, rate: str, reference: str, floor: float) -> DataFrame:
    """Per arm: its rates over the reference's, their least and mean, and the axes below the floor."""
    ref = rates.filter(F.col(arm) == reference).select(axis, F.col(rate).alias("_ref"))
    kept = rates.filter(F.col(arm) != reference).join(ref, axis).withColumn("_kept", F.when(F.col("_ref") > 0, F.col(rate) / F.col("_ref")))
    return kept.groupBy(arm).agg(
        F.min("_kept").alias("least"), F.avg("_kept").alias("mean"), F.array_sort(F.collect_list(F.when(F.col("_kept") < floor, F.col(axis)))).alias("failing")
    )


def movers(rows: DataFrame, key: str, change: Column, k: int) -> DataFrame:
    """The k rows that moved most, either way; ties: the smaller key."""
    return rows.withColumn("change", change).orderBy(F.desc(F.abs("change")), key).limit(k)


def stratum_blocks(items: DataFrame, stratum: str, base: str, tuned: str) -> DataFrame:
    """Per stratum, and for all as stratum null: items, both means, mean and upper median of the difference, items up, down
    and tied, and the sign test's p-value."""
    both = F.explode(F.array(F.col(stratum), F.lit(None).cast(items.schema[stratum].dataType)))
    cells = items.select(both.alias(stratum), F.col(base).cast("double").alias("_b"), F.col(tuned).cast("double").alias("_t")).withColumn("_d", F.col("_t") - F.col("_b"))
    n = lambda c: F.count(F.when(c, 1))
    blocks = cells.groupBy(stratum).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_b").alias("base"), F.avg("_t").alias("tuned"), F.avg("_d").alias("mean_diff"),
        n(F.col("_d") > 0).alias("n_up"), n(F.col("_d") < 0).alias("n_down"), n(F.col("_d") == 0).alias("n_tied"),
    )
    ranked = running(cells.groupBy(stratum, "_d").agg(F.count(F.lit(1)).alias("_n")), [stratum], "_d", {"_at": F.col("_n")})
    at = F.floor(F.col("_at_all") / 2)
    medians = ranked.filter((F.col("_at") <= at) & (at < F.col("_at") + F.col("_n"))).select(F.col(stratum).alias("_s"), F.col("_d").alias("median_diff"))
    out = blocks.join(medians, F.col(stratum).eqNullSafe(F.col("_s"))).drop("_s")
    return out.withColumn("sign_p", exact_two_sided(F.col("n_down"), F.col("n_up")))


#: Variance of a binomial from which a draw is a rounded normal one, and the counts that are looked at below it.
NORMAL, COUNTS = 9.0, 80


def uniform(*parts: Column | str | int) -> Column:
    """A number between 0 and 1, both left out, that is the same wherever and whenever these parts are drawn."""
    named = F.md5(F.concat_ws("|", *(F.lit(p) if isinstance(p, (str, int)) else p.cast("string") for p in parts)))
    return (F.conv(F.substring(named, 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52


def binomial(n: Column, p: Column, *stream: Column | str | int) -> Column:
    """A binomial draw, as a double: a normal one, rounded half to even and kept within 0 and n, from variance NORMAL on, and below it
    the count at which the distribution function passes a uniform number, exact but for counts beyond COUNTS of the rarer side.
    """
    variance = n * p * (1 - p)
    angle = F.sqrt(-2 * F.log(uniform(*stream, "r"))) * F.cos(2 * math.pi * uniform(*stream, "a"))
    normal = F.greatest(F.lit(0.0), F.least(n.cast("double"), F.rint(n * p + F.sqrt(variance) * angle)))
    rare = F.least(p, 1 - p)
    none = F.exp(n * F.log1p(-rare))
    start = F.struct(none.alias("mass"), none.alias("below"), F.lit(0.0).alias("x"), uniform(*stream, "u").alias("u"))  # drawn once

    def step(acc: Column, i: Column) -> Column:
        mass = acc["mass"] * (n - i + 1) / i * rare / (1 - rare)
        return F.struct(mass.alias("mass"), (acc["below"] + mass).alias("below"), (acc["x"] + (acc["below"] < acc["u"]).cast("double")).alias("x"), acc["u"].alias("u"))

    found = F.least(n.cast("double"), F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(COUNTS)), lambda i: i.cast("double")), start, step)["x"])
    small = F.when(p <= 0.5, found).otherwise(n - found)
    return F.when((n <= 0) | (p <= 0), 0.0).when(p >= 1, n.cast("double")).when(variance >= NORMAL, normal).otherwise(small)


def bootstrap(cells: DataFrame, key: str, rounds: int = 10_000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """key, mean, low, high of cells (key, n_minus, n_zero, n_plus): the mean difference of paired verdicts and its percentile
    bootstrap interval; all 0 where there are no items.

    A resample of n items is two chained binomial draws, the losses of all and the gains of what is left, so its cost does not
    depend on n. Draws are hashes of the key, the round and the seed, the same in SQL, and rounds are rows, so that the tasks
    share them; a window holds the rounds of one cell.
    """
    n = F.col("n_minus") + F.col("n_zero") + F.col("n_plus")
    rows = cells.select(F.col(key), *(F.col(c).cast("double").alias(c) for c in ("n_minus", "n_zero", "n_plus"))).withColumn("n", n)
    drawn = rows.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).repartition(key, F.col("round") % 64)
    lost = F.coalesce(F.try_divide("n_minus", "n"), F.lit(0.0))
    drawn = drawn.withColumn("minus", binomial(F.col("n"), lost, seed, F.col(key), F.col("round"), "minus"))
    rest = F.when(lost >= 1, 0.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.try_divide("n_plus", "n"), F.lit(0.0)) / (1 - lost)))
    drawn = drawn.withColumn("plus", binomial(F.col("n") - F.col("minus"), rest, seed, F.col(key), F.col("round"), "plus"))
    drawn = drawn.select(key, "n_minus", "n_plus", "n", "round", F.coalesce(F.try_divide(F.col("plus") - F.col("minus"), F.col("n")), F.lit(0.0)).alias("d"))
    at = F.row_number().over(Window.partitionBy(key).orderBy("d", "round")) - 1
    low, high = int((1 - level) / 2 * rounds), min(rounds - 1, int((1 + level) / 2 * rounds))
    mean = F.coalesce(F.try_divide(F.col("n_plus") - F.col("n_minus"), F.col("n")), F.lit(0.0))
    ends = [F.max(F.when(F.col("at") == i, F.col("d"))).alias(name) for i, name in ((low, "low"), (high, "high"))]
    return drawn.withColumn("at", at).groupBy(key).agg(F.first(mean).alias("mean"), *ends)


def permutation(rows: DataFrame, value: str, first: Column, by: str, rounds: int = 10_000, seed: int = 0) -> DataFrame:
    """Per group: the difference of the means of two arms, and its two-sided p-value under exchange of the labels.

    Rows are counted by value first; a permutation is one draw of the first arm's counts from all (multivariate
    hypergeometric), so a task holds the distinct values of a group, not its rows.
    """
    cells = rows.groupBy(by, F.col(value).cast("double").alias("v")).agg(F.count(F.when(first, 1)).alias("a"), F.count(F.when(~first, 1)).alias("b"))

    def test(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("v")
        v, a, b = (cells[c].to_numpy() for c in ("v", "a", "b"))
        n, m = int(a.sum()), int(b.sum())
        if not n or not m:
            return pd.DataFrame([(cells[by].iloc[0], n, m, 0.0, 1.0)], columns=[by, "n_a", "n_b", "diff", "p"])
        seen = v @ a / n - v @ b / m
        draws = np.random.default_rng(seed).multivariate_hypergeometric(a + b, n, size=rounds, method="marginals")
        sums = draws @ v
        drawn = sums / n - (v @ (a + b) - sums) / m
        p = (int((np.abs(drawn) >= abs(seen) - 1e-12).sum()) + 1) / (rounds + 1)
        return pd.DataFrame([(cells[by].iloc[0], n, m, seen, p)], columns=[by, "n_a", "n_b", "diff", "p"])

    return cells.groupBy(by).applyInPandas(test, f"{by} {rows.schema[by].dataType.simpleString()}, n_a long, n_b long, diff double, p double")


def entropy(logits: Column) -> Column:
    """The entropy of a distribution given by its logits, over that of the uniform one: 0 to 1."""
    shifted = F.transform(logits, lambda x: x.cast("double") - F.array_max(logits).cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    z = total(F.transform(shifted, lambda x: F.exp(x)))
    mean = total(F.transform(shifted, lambda x: F.exp(x) * x)) / z
    return (F.log(z) - mean) / F.log(F.size(logits))


def matched_controls(items: DataFrame, category: str, key: str, length: str, treated: str) -> DataFrame:
    """Pairs of a treated and an untreated item of one category: greedily the smallest difference in length, each once.

    Sequential by its rule, so a category is one task; categories of an evaluation set are small. Treated items come in
    order of their keys; the nearest free lengths on either side are found by bisection.
    """

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf[treated].to_numpy(dtype=bool)
        free = sorted(zip(pdf.loc[~mine, length], pdf.loc[~mine, key], strict=True))
        out = []
        for k, size in sorted(zip(pdf.loc[mine, key], pdf.loc[mine, length], strict=True)):
            if not free:
                break
            at = bisect_left(free, (size,))
            below = bisect_left(free, (free[at - 1][0],)) if at else None  # the smallest key of the next smaller length
            best = min((i for i in (at if at < len(free) else None, below) if i is not None), key=lambda i: (abs(free[i][0] - size), free[i][1]))
            found = free.pop(best)
            out.append((pdf[category].iloc[0], k, found[1], abs(found[0] - size)))
        return pd.DataFrame(out, columns=[category, "treated", "control", "difference"])

    kind = items.schema[key].dataType.simpleString()
    return items.groupBy(category).applyInPandas(match, f"{category} {items.schema[category].dataType.simpleString()}, treated {kind}, control {kind}, difference long")
