"""Running sums over a global order without gathering it: spans of the order first, then inside each span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spans that an order is cut into.
SPANS = 256


def _span(cells: DataFrame, order: str) -> Column:
    """The span of a value: how many of the order's approximate quantiles lie at or below it."""
    if SPANS < 2:
        return F.lit(0)
    cuts = cells.agg(F.percentile_approx(order, [i / SPANS for i in range(1, SPANS)], 8 * SPANS)).first()[0]
    if cuts is None:  # no rows
        return F.lit(0)
    cuts = sorted(set(cuts))
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(order)))


def running(cells: DataFrame, by: list[str], order: str, sums: dict[str, Column]) -> DataFrame:
    """cells with, for each of sums, its total over the cells of the group that come earlier, and `<name>_all` over all.

    order: a numeric column that is distinct in a group (count equal values first). A window holds one span of a group or
    the group's spans, never the group; span bounds come from approximate quantiles and do not change the result.
    """
    cut = cells.withColumn("_span", _span(cells, order)).withColumns({f"_{k}": c for k, c in sums.items()})
    spans = cut.groupBy(*by, "_span").agg(*(F.sum(f"_{k}").alias(f"_s_{k}") for k in sums))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    above = group.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*by, "_span", *(F.coalesce(F.sum(f"_s_{k}").over(above), F.lit(0)).alias(f"_b_{k}") for k in sums), *(F.sum(f"_s_{k}").over(group).alias(f"{k}_all") for k in sums))
    inside = Window.partitionBy(*by, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumns({f"_i_{k}": F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0)) for k in sums})
    on = [cut[c].eqNullSafe(spans[c]) for c in (*by, "_span")]
    return cut.join(spans, on).select(*(cut[c] for c in cells.columns), *((F.col(f"_i_{k}") + F.col(f"_b_{k}")).alias(k) for k in sums), *(f"{k}_all" for k in sums))
