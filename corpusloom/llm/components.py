"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a minimum per node (combined map-side) and a join back on the node. The minima are broadcast while the
edges are counted to be few (SMALL); beyond that both sides of the join are written tables, so that adaptive execution
can split a hub's rows. Nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, tasks_for

#: Edges up to which the minima (two numbers each, so 16 MB at most) are broadcast.
SMALL = 500_000


def _stars(scratch: Scratch, edges: DataFrame, name: str, rows: int) -> DataFrame:
    """edges (u, v) with each u's smallest neighbour m, u itself counting."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(F.broadcast(least) if rows <= SMALL else scratch.write(least, name), "u")


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """edges (a, b) -> id, component for every id in them: the smallest id that can be reached.

    Rows with a null, loops and repeated edges add nothing; without edges the result is empty.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = scratch.write(now, f"{name}-edges0")
    before, k = None, 0
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before, k = state, k + 1
        rows, tasks = state[0], tasks_for(state[0])
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(scratch, both, f"{name}-least{k}", rows).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.write(large.coalesce(tasks), f"{name}-large{k}")
        star = _stars(scratch, large, f"{name}-star{k}", rows)
        small = star.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(star.select("u", F.col("m").alias("v")))
        now = scratch.write(small.coalesce(tasks).distinct(), f"{name}-edges{k}", tasks)
        scratch.drop(f"{name}-edges{k - 1}", f"{name}-least{k}", f"{name}-large{k}", f"{name}-star{k}")
    members = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
