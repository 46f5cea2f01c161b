"""Joins of points with areas and with points near them, on a grid of cells so that they stay equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def _cell(c, size):
    return F.floor(c / size).cast("long")


def within_cells(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Pairs of points (``lng``, ``lat``) and boxes (``x0, y0, x1, y1``) that share a grid cell: a superset of the
    pairs that touch. A box is repeated for each cell it meets."""
    p = points.withColumns({"__cx": _cell(F.col("lng"), size), "__cy": _cell(F.col("lat"), size)})
    b = boxes.withColumn("__cx", F.explode(F.sequence(_cell(F.col("x0"), size), _cell(F.col("x1"), size))))
    b = b.withColumn("__cy", F.explode(F.sequence(_cell(F.col("y0"), size), _cell(F.col("y1"), size))))
    return p.join(b, ["__cx", "__cy"]).drop("__cx", "__cy")


def covering(points: DataFrame, boxes: DataFrame, size: float, edge: bool = True) -> DataFrame:
    """Pairs of points and the boxes that cover them, edges included or not."""
    hit = geo.in_rectangle(*[F.col(c) for c in ("lng", "lat", "x0", "y0", "x1", "y1")], edge=edge)
    return within_cells(points, boxes, size).where(hit)


def near(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """Pairs of points within a distance: ``left`` has ``lng, lat``, ``right`` has ``r_lng, r_lat``; adds ``metres``.
    Left points are repeated for the neighbouring cells, whose width is at least the distance."""
    size = metres / 80_000.0  # degrees; a degree of longitude is wider than this up to 44 degrees of latitude
    l_ = left.withColumns({"__cx": _cell(F.col("lng"), size), "__cy": _cell(F.col("lat"), size)})
    l_ = l_.withColumn("__cx", F.explode(F.sequence(F.col("__cx") - 1, F.col("__cx") + 1)))
    l_ = l_.withColumn("__cy", F.explode(F.sequence(F.col("__cy") - 1, F.col("__cy") + 1)))
    r = right.withColumns({"__cx": _cell(F.col("r_lng"), size), "__cy": _cell(F.col("r_lat"), size)})
    far = geo.haversine_m(F.col("lat"), F.col("lng"), F.col("r_lat"), F.col("r_lng"))
    return l_.join(r, ["__cx", "__cy"]).drop("__cx", "__cy").withColumn("metres", far).where(F.col("metres") <= metres)


def dissolved(boxes: DataFrame, key: str) -> DataFrame:
    """One area per key: its parts, and the box around them (``x0, y0, x1, y1``)."""
    part = F.struct("x0", "y0", "x1", "y1")
    return boxes.groupBy(key).agg(F.collect_list(part).alias("parts"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def covered_by_parts(points: DataFrame, areas: DataFrame, size: float) -> DataFrame:
    """Pairs of points and dissolved areas with a part that covers the point; inner edges count as covered."""
    hit = F.exists("parts", lambda r: geo.in_rectangle(F.col("lng"), F.col("lat"), r["x0"], r["y0"], r["x1"], r["y1"]))
    return covering(points, areas, size).where(hit).drop("parts")


def primary_area(points: DataFrame, boxes: DataFrame, size: float, point: str, area: str) -> DataFrame:
    """One area per point that has any: the smallest code of those that cover it."""
    return covering(points, boxes, size).groupBy(point).agg(F.min(area).alias(area))


def misplaced(used: DataFrame, path: DataFrame, boxes: DataFrame, size: float, metres: float) -> DataFrame:
    """Stops (``ars``) without a used coordinate, or with one more than ``metres`` from the median of their coordinates on
    the paths of routes: ``n_routes``, ``metres``, the districts of both places, and whether these differ."""
    median = path.groupBy("ars").agg(F.count_distinct("route").alias("n_routes"), F.median("lng").alias("lng"), F.median("lat").alias("lat"))
    there = median.withColumnsRenamed({"lng": "p_lng", "lat": "p_lat"})
    far = geo.haversine_m(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng"))
    off = there.join(used.select("ars", "lng", "lat"), "ars", "left").withColumn("metres", far).where(F.col("lat").isNull() | F.col("lng").isNull() | (F.col("metres") > metres))
    area = lambda points, name: primary_area(points.select("ars", "lng", "lat"), boxes, size, "ars", "dong").withColumnRenamed("dong", name)
    here = off.select("ars", "lng", "lat").where("lng is not null and lat is not null")
    both = off.join(area(here, "used_dong"), "ars", "left").join(area(off.select("ars", F.col("p_lng").alias("lng"), F.col("p_lat").alias("lat")), "path_dong"), "ars", "left")
    return both.select("ars", "n_routes", "metres", "used_dong", "path_dong", (~F.col("used_dong").eqNullSafe(F.col("path_dong"))).alias("differs"))
