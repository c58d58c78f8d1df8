"""Connected components of an edge table by alternating star contraction, all in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.llm.common import heavy_keys, spread_join, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the (a, b) edges; root is the least node of its component.

    Each round links every node's larger neighbours, then its smaller ones, to the least node near it, so
    chains shrink by a constant factor and the rounds grow with the logarithm of the longest chain. Rounds
    are written to the shared folder; the driver sees counts and the few centres that hold over a thousandth
    of all edges, whose edges are not shuffled. Null or equal ends are left out.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    n = e.count()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "centres")
        heavy = heavy_keys(around, "u", "n")
        large = spread_join(both.where("v > u"), around.select("u", "m"), "u", "inner", heavy).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "large")
        near = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        several = large.join(near.where("n > 1").select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(near.select("u", F.col("m").alias("v")).unionByName(several).where("u > v").distinct(), "edges")
        count = now.count()
        if count == n and now.join(e, ["u", "v"], "left_anti").isEmpty():
            break
        e, n = now, count
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
