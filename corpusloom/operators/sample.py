"""Deterministic samples: hash ranks, strides, strata, cyclic quotas, budgets, round robin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.ranks import running


def rank_key(*parts: Column, seed: str = "0") -> Column:
    return F.md5(F.concat_ws("\x1f", *(p.cast("string") for p in parts), F.lit(seed)))


def bottom_k(rows: DataFrame, key: Column, k: int) -> DataFrame:
    """The k rows whose keys are smallest."""
    return rows.withColumn("_rank", key).orderBy("_rank").limit(k).drop("_rank")


def first_n(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows by order."""
    return rows.orderBy(order).limit(n)


def bottom_k_by(rows: DataFrame, stratum: str, key: Column, targets: dict[str, int]) -> DataFrame:
    """Of each stratum the targeted number of rows, smallest keys first; a larger target holds a smaller one's rows.

    A group limit is pushed below the window, so a stratum sends its smallest rows only.
    """
    most = max(targets.values(), default=0)
    ranked = rows.withColumn("_key", key).withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy("_key"))).filter(F.col("_n") <= most)
    wanted = F.coalesce(*(F.when(F.col(stratum) == s, F.lit(n)) for s, n in targets.items()), F.lit(0))
    return ranked.filter(F.col("_n") <= wanted).drop("_key", "_n")


def strata_targets(pools: dict[str, int], n: int, shares: dict[str, float], rest: str) -> dict[str, int]:
    """Rows of each stratum: its share of n (rounded half to even) where one is given, the rest from one stratum."""
    if sum(shares.values()) > 1.0:
        raise ValueError("the shares exceed 1")
    out = {s: min(pools.get(s, 0), round(n * share)) for s, share in shares.items()}
    out[rest] = min(pools.get(rest, 0), n - sum(out.values()))
    return out


def strided(rows: DataFrame, order: str, limit: int, by: list[str] | None = None) -> DataFrame:
    """Every (n // limit)-th row by order (a distinct number), limit rows at most."""
    numbered = running(rows, by or [], order, {"_i": F.lit(1)})
    step = F.greatest(F.floor(F.col("_i_all") / limit), F.lit(1))
    return numbered.filter((F.col("_i") % step == 0) & (F.col("_i") / step < limit)).drop("_i", "_i_all")


def round_robin(rows: DataFrame, category: str, order: Column, n: int) -> DataFrame:
    """One row of each category in turn until there are n; a category sends its first n rows only."""
    turn = F.row_number().over(Window.partitionBy(category).orderBy(order))
    return rows.withColumn("_turn", turn).filter(F.col("_turn") <= n).orderBy("_turn", category).limit(n).drop("_turn")


def capped_by(rows: DataFrame, corpus: str, key: Column, each: int, total: int) -> DataFrame:
    """At most so many rows of each corpus, then so many in all, smallest keys first."""
    rank = F.row_number().over(Window.partitionBy(corpus).orderBy("_key"))
    return rows.withColumn("_key", key).withColumn("_n", rank).filter(F.col("_n") <= each).orderBy("_key").limit(total).drop("_key", "_n")


def cyclic(rows: DataFrame, role: str, order: Column, quotas: dict[str, int]) -> DataFrame:
    """Each role's rows over and over, in the given order, until its quota is full: rows with pos (from 0).

    A role sends as many rows as the largest quota at most.
    """
    first = F.row_number().over(Window.partitionBy(role).orderBy(order))
    ranked = rows.withColumn("_i", first).filter(F.col("_i") <= max(quotas.values(), default=0)).withColumn("_i", F.col("_i") - 1)
    sizes = rows.filter(F.col(role).isin(*quotas)).groupBy(role).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ranked.join(F.broadcast(sizes), role)  # a row for each quota
    quota = F.coalesce(*(F.when(F.col(role) == r, F.lit(q)) for r, q in quotas.items()), F.lit(0))
    times = F.ceil((quota - F.col("_i")) / F.col("_n"))
    out = ranked.withColumn("_q", times).filter("_q > 0").withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_q") - 1)))
    return out.withColumn("pos", F.col("_i") + F.col("_k") * F.col("_n")).drop("_i", "_n", "_q", "_k")


def raw_mix(rows: DataFrame, key: Column, length: str, budget: float) -> DataFrame:
    """Rows of all roles in one hash order, each once, as many as the token budget holds at their mean length."""
    mean = rows.agg(F.avg(length)).first()[0]
    return bottom_k(rows, key, round(budget / mean) if mean else 0)


def calibrate(budget: float, shares: dict[str, float], stats: dict[str, dict[str, float]]) -> dict[str, dict[str, float]]:
    """Rows of each role for a token budget: its share over its mean length, rounded half to even.

    stats: mean and rows of each role. repeats says how often the role's rows are gone through.
    """
    out = {}
    for role, share in shares.items():
        want, have = budget * share, stats[role]
        n = int(round(want / have["mean"])) if have["mean"] else 0
        out[role] = {"tokens": want, "rows": n, "repeats": n / have["rows"] if have["rows"] else 0.0}
    return out


#: Parts that a group is dealt into before its first rows are chosen.
PARTS = 64


def first_k(rows: DataFrame, by: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The first k rows of each group by order, which tells its rows apart.

    First of each part of a group, then of these: no window holds more of a group than a part, or PARTS * k rows. Spark limits
    either within the tasks before it shuffles, so that of a group that holds all rows k leave a task at most.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(PARTS))
    for keys in ([*by, part], by):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        rows = rows.withColumn("_k", rank).filter(F.col("_k") <= k).drop("_k")
    return rows


#: What a role may be given: passes over its rows; what the others leave, by size; a dose in passes, off the top of the
#: budget; a part of the budget, off the top as well.
PASSES, FILL, DOSE, PART = "passes", "fill", "dose", "part"


def allocate(avail: DataFrame, arms: DataFrame, rules: DataFrame) -> DataFrame:
    """Tokens of each role in each arm: arm, role, tokens, share, repeats, priority (share of the arm), notes (sorted).

    avail: role, tokens (one row a role; a role without one has none). arms: arm, budget (null: as much as the mix comes to)
    and floor, the least share of the roles with passes in the mix. rules: arm, role, kind and amount.

    The mix takes the PASSES roles so often as said, and FILL roles by their sizes until the floor would be broken or they are
    used up. It is then scaled to what the doses leave of the budget; doses that exceed it are scaled to it, and the mix gets
    nothing. A window holds the roles of one arm.
    """
    own = Window.partitionBy("arm")
    of = lambda kind, x: F.when(F.col("kind") == kind, x).otherwise(0.0)
    total = lambda x: F.sum(x).over(own)
    known = avail.select("role", F.col("tokens").cast("double").alias("have"))
    rows = rules.join(arms.select("arm", F.col("budget").cast("double").alias("budget"), "floor"), "arm").join(known, "role", "left").na.fill(0.0, ["have"])
    rows = rows.withColumn("passes", F.col("have") * F.col("amount"))
    rows = rows.withColumns({"want": total(of(PASSES, F.col("passes"))) * (1 / F.col("floor") - 1), "there": total(of(FILL, F.col("have")))})
    filler = F.least("want", "there") * F.try_divide("have", "there")
    rows = rows.withColumn("natural", of(PASSES, F.col("passes")) + of(FILL, F.coalesce(filler, F.lit(0.0))))
    part = F.least(F.coalesce(F.col("budget"), F.lit(0.0)) * F.greatest(F.lit(0.0), F.col("amount")), F.col("have"))
    rows = rows.withColumn("dose", of(DOSE, F.col("passes")) + of(PART, part))
    rows = rows.withColumns({"mixed": total(F.col("natural")), "doses": total(F.col("dose"))})
    room = F.col("budget") - F.col("doses")
    over = F.coalesce(room <= 0, F.lit(False))
    scale = F.when(F.col("budget").isNull(), 1.0).when(over, 0.0).otherwise(F.coalesce(F.try_divide(room, "mixed"), F.lit(0.0)))
    tokens = F.col("natural") * scale + F.col("dose") * F.when(over, F.col("budget") / F.greatest(F.lit(1.0), "doses")).otherwise(1.0)
    rows = rows.withColumns({"tokens": tokens, "over": over}).withColumn("all", total(F.col("tokens")))
    first = F.col("kind").isin(PASSES, DOSE)
    notes = {
        "doses exceed the budget": F.col("over"),
        "filler is used up": F.col("want") > F.col("there"),
        "a part has no rows": F.max((F.col("kind") == PART) & (F.col("amount") > 0) & (F.col("have") == 0)).over(own),
    }
    said = F.array_sort(F.array_compact(F.array(*(F.when(on, F.lit(note)) for note, on in notes.items()))))
    share = lambda x, whole: F.round(F.coalesce(F.try_divide(x, whole), F.lit(0.0)), 4)
    return rows.select(
        "arm", "role", "tokens", share(F.col("tokens"), F.col("all")).alias("share"), share(F.col("tokens"), F.col("have")).alias("repeats"),
        share(total(F.when(first, F.col("tokens")).otherwise(0.0)), F.col("all")).alias("priority"), said.alias("notes"),
    )


def selected(rows: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that chosen (keys, pos) names, as often as it names them, in its order."""
    return rows.join(chosen, keys).orderBy("pos")
