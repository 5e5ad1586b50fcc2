"""Connected components of an edge table by alternating large-star and small-star steps, in DataFrame operations only.

Each step is a map-side combined minimum per node and a join (which adaptive execution splits if one node is hot); a
round's edges are written to the shared folder, so lineage stays short and lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(u, v), u <> v.  large: each node links its larger neighbours to its minimum; small: the others."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    down = both.where(F.col("v") < F.col("u"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``edges`` (two columns, any order; loops and
    repeated edges are harmless, null ends are ignored).  Nodes without an edge are not listed."""
    a, b = edges.columns
    first = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = scratch.table(first, "edges")
    for _ in range(most_rounds):
        # done once every node either has one edge, to its component's smallest, or is such a smallest node
        ends = now.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(now.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("low")))
        if ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("low").alias("low")).where("up > 1 OR up = 1 AND low = 1").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        after = scratch.table(_star(_star(now, True), False), "edges")
        scratch.drop(now)
        now = after
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
