"""Simplification of neighbouring areas that keeps their shared edges.

Rings are taken apart into edges; an edge of two areas is found by an equi-join on its end points in one order. Points where
edges of other neighbours meet are nodes and stay; between nodes an arc has the same two owners all along, so it is simplified
once, in one direction, for both. Rings are put together again from their arcs, so that no gap or overlap can arise between
areas. What is gathered at once is one ring or one arc.

A ring without nodes (an island) is one arc from its least point to itself. Rings whose arcs would leave fewer than four points
keep all their points. Repeated points are one point; rings may be closed or not, and come back closed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import kept_points
from ..sources.files import saved

POINT = "struct<lng:double,lat:double>"


def edges(areas: DataFrame, id_col: str = "area", ring_col: str = "ring") -> DataFrame:
    """``area``, ``i`` (place in the ring), ``a`` and ``b`` (its ends in the ring's order) and ``key`` (the ends in one order)."""
    point = lambda p: F.struct(p["lng"].cast("double").alias("lng"), p["lat"].cast("double").alias("lat"))
    rings = areas.select(F.col(id_col).alias("area"), F.transform(ring_col, point).alias("r"))
    # without repeats, and without the closing point
    clean = rings.select("area", F.filter("r", lambda p, i: (i == 0) | (p != F.get("r", i - 1))).alias("r"))
    open_ring = F.when((F.size("r") > 1) & (F.get("r", F.lit(0)) == F.element_at("r", -1)), F.slice("r", F.lit(1), F.size("r") - 1)).otherwise(F.col("r"))
    steps = clean.select("area", open_ring.alias("r")).where(F.size("r") >= 3).select("area", "r", F.size("r").alias("n"), F.posexplode("r").alias("i", "a"))
    rows = steps.select("area", "i", "n", "a", F.get("r", (F.col("i") + 1) % F.col("n")).alias("b"))
    return rows.withColumn("key", F.when(F.col("a") < F.col("b"), F.struct("a", "b")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))


def nodes(rows: DataFrame) -> DataFrame:
    """Points where arcs meet (``p``): those whose edges don't all belong to the same areas, or more than two edges meet."""
    owners = rows.groupBy("key").agg(F.array_sort(F.collect_set("area")).alias("owners"))
    ends = owners.select(F.explode(F.array("key.a", "key.b")).alias("p"), "owners")
    return ends.groupBy("p").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("owners").alias("kinds")).where("edges > 2 or kinds > 1").select("p")


def arcs(rows: DataFrame) -> DataFrame:
    """Per ``area`` and arc ``k`` (in the ring's order): ``points`` from node to node. Islands begin at their least point."""
    met = rows.join(nodes(rows).withColumn("node", F.lit(True)), F.col("a") == F.col("p"), "left")
    ring = Window.partitionBy("area")
    first = F.min(F.when(F.col("node"), F.col("i"))).over(ring)
    least = F.min(F.struct("a", "i")).over(ring)["i"]
    start = met.withColumn("start", F.coalesce(first, least)).withColumn("at", F.pmod(F.col("i") - F.col("start"), F.col("n")))
    begins = (F.col("at") == 0) | F.coalesce(F.col("node"), F.lit(False))
    numbered = start.withColumn("k", F.sum(begins.cast("int")).over(Window.partitionBy("area").orderBy("at")))
    listed = F.sort_array(F.collect_list(F.struct("at", "a", "b")))
    points = F.concat(F.transform(listed, lambda x: x["a"]), F.array(F.element_at(listed, -1)["b"]))
    return numbered.groupBy("area", "k").agg(points.alias("points"))


def _thinned(points: Column, tolerance: float) -> Column:
    @F.pandas_udf("array<boolean>")
    def kept(lines: pd.Series) -> pd.Series:
        def one(line):
            pair = np.array([(p["lng"], p["lat"]) for p in line], dtype=float)
            if len(pair) > 3 and (pair[0] == pair[-1]).all():  # an island: from its first point to the farthest and back
                far = int(np.hypot(*(pair - pair[0]).T).argmax())
                two = [kept_points(*pair[a:b].T, tolerance) for a, b in ((0, far + 1), (far, len(pair)))]
                return np.concatenate([two[0], two[1][1:]]).tolist()
            return kept_points(pair[:, 0], pair[:, 1], tolerance).tolist()

        return lines.map(one)

    return F.transform(F.filter(F.arrays_zip(points.alias("p"), kept(points).alias("k")), lambda x: x["k"]), lambda x: x["p"])


def simplified(areas: DataFrame, tolerance: float, id_col: str = "area", ring_col: str = "ring") -> DataFrame:
    """``area`` and ``ring`` (closed), without the points that bend its sides by less than ``tolerance``; sides that areas share
    lose the same points in each. Rings and arcs are written, because several steps read them: a ring's expression would run in
    each again, and its conditions would move below what made the areas, to every row of the table they come from."""
    rings = saved(areas.select(id_col, ring_col), "rings")
    parts = saved(arcs(edges(rings, id_col, ring_col)), "arcs")
    # an arc is named by its points in the lesser of its two directions, and simplified in that one
    back = F.reverse("points")
    parts = parts.withColumns({"turned": back < F.col("points"), "way": F.least(F.col("points"), back)})
    once = parts.select("way").distinct().withColumn("thin", _thinned(F.col("way"), tolerance))
    joined = parts.join(once, "way").select("area", "k", "points", F.when(F.col("turned"), F.reverse("thin")).otherwise(F.col("thin")).alias("thin"))

    def ring(column: str) -> Column:
        lines = F.transform(F.sort_array(F.collect_list(F.struct("k", column))), lambda x: F.slice(x[column], F.lit(1), F.size(x[column]) - 1))
        return F.flatten(lines)

    rings = joined.groupBy("area").agg(ring("thin").alias("thin"), ring("points").alias("whole"))
    chosen = rings.select("area", F.when(F.size("thin") >= 3, F.col("thin")).otherwise(F.col("whole")).alias("r"))
    return chosen.select(F.col("area").alias(id_col), F.concat("r", F.slice("r", F.lit(1), F.lit(1))).alias(ring_col))
