"""Linear references on the paths of routes: segments between stops, their lengths and lines, and points at a distance.

A path is (``route, vertex, lng, lat``), matched stations are (``route, seq, vertex``, as ``paths.match_stations`` gives them,
with ``lng, lat`` and more). Lengths come from one running sum per path; a segment gets its vertices by an equi-join, as every
vertex stands in at most as many segments as end or pass there. What is gathered at once is one segment, or one route's line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import flat_m


def along(path: DataFrame) -> DataFrame:
    """The vertices of each path that have coordinates, with ``place`` (from 0) and ``metres`` from the start of the path."""
    w = Window.partitionBy("route").orderBy("vertex")
    known = path.where("route is not null and vertex is not null and lng is not null and lat is not null").select("route", "vertex", "lng", "lat")
    step = F.coalesce(flat_m(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng")), F.lit(0.0))
    rows = known.select("*", (F.row_number().over(w) - 1).cast("long").alias("place"), step.alias("step"))
    return rows.withColumn("metres", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def build(stations: DataFrame, path: DataFrame, keep: list[str]) -> DataFrame:
    """The segment from each station to the next of its route: ``route, seq, next_seq``, ``keep`` of both stations (``from_`` and
    ``to_``), ``points`` (the path between their vertices), ``metres`` and ``straight``: whether both stations stand on one vertex,
    so that the segment is the line between them. Routes with fewer than two stations or two vertices have none."""
    w = Window.partitionBy("route").orderBy("seq")
    found = stations.where("vertex is not null").select("route", "seq", "vertex", *[F.col(c).alias(f"from_{c}") for c in dict.fromkeys(["lng", "lat", *keep])])
    after = [F.lead(c).over(w).alias(c.replace("from_", "to_")) for c in found.columns if c.startswith("from_")]
    ends = found.select("*", F.lead("seq").over(w).alias("next_seq"), F.lead("vertex").over(w).alias("to_vertex"), *after).where("next_seq is not null")
    line = along(path)
    at = lambda name: line.select("route", F.col("vertex").alias(f"__{name}"), F.col("place").alias(f"{name}_place"), F.col("metres").alias(f"{name}_metres"))
    rows = ends.withColumnsRenamed({"vertex": "__a", "to_vertex": "__b"})
    rows = rows.join(at("a"), ["route", "__a"]).join(at("b"), ["route", "__b"])
    vertices = rows.select("route", "seq", F.explode(F.sequence("a_place", "b_place")).alias("place"))
    shaped = vertices.join(line.select("route", "place", "lng", "lat"), ["route", "place"])
    points = F.transform(F.sort_array(F.collect_list(F.struct("place", "lng", "lat"))), lambda x: F.struct(x["lng"].alias("lng"), x["lat"].alias("lat")))
    lines = shaped.groupBy("route", "seq").agg(points.alias("points"))
    out = rows.join(lines, ["route", "seq"]).withColumn("straight", F.size("points") < 2)
    own = F.array(*[F.struct(F.col(f"{e}_lng").alias("lng"), F.col(f"{e}_lat").alias("lat")) for e in ("from", "to")])
    direct = flat_m(F.col("from_lat"), F.col("from_lng"), F.col("to_lat"), F.col("to_lng"))
    return out.select(
        "route", "seq", "next_seq", *[f"{e}_{c}" for c in keep for e in ("from", "to")], F.when(F.col("straight"), own).otherwise(F.col("points")).alias("points"),
        F.when(F.col("straight"), direct).otherwise(F.col("b_metres") - F.col("a_metres")).alias("metres"), "straight",
    )


def whole_lines(segments: DataFrame) -> DataFrame:
    """``route``, ``points`` (its segments joined into one line, without points that repeat the one before) and ``metres``."""
    all_points = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seq", "points"))), lambda x: x["points"]))
    rows = segments.groupBy("route").agg(all_points.alias("points"), F.sum("metres").alias("metres"))
    return rows.withColumn("points", F.filter("points", lambda x, i: (i == 0) | (x != F.get("points", i - 1))))


def turnarounds(stations: DataFrame, flag: str = "turn") -> DataFrame:
    """The first station of each route that is flagged: ``route``, ``turn_seq``."""
    return stations.where(flag).groupBy("route").agg(F.min("seq").alias("turn_seq"))


def longest(stations: DataFrame, group: str, variant: str) -> DataFrame:
    """Of each group the variant with the most stations, ties to the first by name."""
    counts = stations.groupBy(group, variant).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(group).agg(F.min_by(variant, F.struct(-F.col("n"), variant)).alias(variant))


def located(path: DataFrame, wanted: DataFrame) -> DataFrame:
    """The point at a distance from the start of a path: ``wanted`` (``route, metres``) with ``lng``, ``lat``. Distances before the
    start or beyond the end are null. Points and vertices stand in one order by distance, without a range join."""
    line = along(path).select("route", "metres", "lng", "lat", F.lit(0).alias("asked"))
    both = line.unionByName(wanted.select("route", "metres", F.lit(1).alias("asked")), allowMissingColumns=True)
    vertex = F.when(F.col("asked") == 0, F.struct("metres", "lng", "lat"))
    w = Window.partitionBy("route").orderBy("metres", "asked")
    before = F.last(vertex, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(vertex, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = both.select("route", "metres", "asked", before.alias("a"), after.alias("b")).where("asked = 1")
    share = F.coalesce(F.try_divide(F.col("metres") - F.col("a.metres"), F.col("b.metres") - F.col("a.metres")), F.lit(0.0))
    there = lambda c: F.when(F.col("metres") == F.col("a.metres"), F.col(f"a.{c}")).otherwise(F.col(f"a.{c}") + share * (F.col(f"b.{c}") - F.col(f"a.{c}"))).alias(c)
    return rows.select("route", "metres", there("lng"), there("lat"))
