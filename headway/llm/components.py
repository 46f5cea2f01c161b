"""Connected components of an undirected graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import forget, saved


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label every node of ``edges`` with the smallest node it can reach: columns ``node``, ``component``.

    Each round points all neighbours of a node to the smallest one they know, first upwards (large star), then
    downwards (small star), until the edges no longer change; rounds grow with the logarithm of the longest path.
    Self-loops and null ends are ignored; an empty graph gives an empty result. Minima are combined before the
    shuffle, so that a node with very many neighbours does not gather them in one task; joins on such a node are
    left to Spark's skew handling.
    """
    now = saved(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges"
    )
    was = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        seen = Observation()
        step = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        new = saved(step.observe(seen, F.count(F.lit(1)).alias("n"), mark.alias("mark")), "edges")
        forget(now)
        now, got = new, (seen.get["n"], seen.get["mark"])
        if got == was or not got[0]:
            break
        was = got
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
