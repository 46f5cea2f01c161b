"""District flows: summaries, reach by distance, weighted medians and trips to the outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import sphere_km
from ..functions.identifiers import area_unit
from ..functions.numbers import half_up

BANDS = (1, 3, 5, 10, 20)


def summary(flows: DataFrame) -> DataFrame:
    """Riders from, to and inside each district: a full join of the two sides."""
    out = flows.groupBy(F.col("origin").alias("dong")).agg(F.sum("subway").alias("out_subway"), F.sum("bus").alias("out_bus"))
    into = flows.groupBy(F.col("dest").alias("dong")).agg(F.sum("subway").alias("in_subway"), F.sum("bus").alias("in_bus"))
    inner = flows.where("origin = dest").groupBy(F.col("origin").alias("dong")).agg(F.sum(F.col("subway") + F.col("bus")).alias("inside"))
    return out.join(into, "dong", "full").join(inner, "dong", "left").fillna(0.0)


def flows_to(flows: DataFrame, level: str) -> DataFrame:
    """Riders between units of a level."""
    return flows.groupBy(area_unit(F.col("origin"), level).alias("origin"), area_unit(F.col("dest"), level).alias("dest")).agg(F.sum("subway").alias("subway"), F.sum("bus").alias("bus"))


def band(km: Column) -> Column:
    """Distance bands; 0 km is the same district."""
    out = F.when(km == 0, "same")
    low = 0
    for high in BANDS:
        out = out.when(km < high, f"{low}-{high}")
        low = high
    return out.otherwise(f"{low}+")


def reach(rows: DataFrame, key: str) -> DataFrame:
    """Riders per key and distance band; rows without a distance are ``outside`` or ``unknown``."""
    name = F.when(F.col("km").isNotNull(), band(F.col("km"))).when(F.col("dest") == "outside", "outside").otherwise("unknown")
    return rows.groupBy(key, name.alias("band")).agg(F.sum("subway").alias("subway"), F.sum("bus").alias("bus"), F.sum("total").alias("total"))


def weighted_median(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The first value at which the running weight reaches half, one decimal; keys without weight are left out."""
    sums = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    w = Window.partitionBy(*keys)
    run = sums.withColumns({"run": F.sum("w").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("w").over(w)})
    return run.where((F.col("all") > 0) & (F.col("run") >= F.col("all") / 2)).groupBy(*keys).agg(half_up(F.min(value), 1).alias("median"))


def weighted_mean(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    known = rows.where(F.col(value).isNotNull())
    return known.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("mean"))


def outside_ends(legs: DataFrame, area_stops: DataFrame, placed: DataFrame, points: DataFrame, area_point: DataFrame, home: str, boarding: bool = True) -> DataFrame:
    """Riders between an area and stops that aren't in it, by the district of the other end and its distance.

    ``legs`` (``board_ars, alight_ars, passengers``), ``area_stops`` (``ars``), ``placed`` (``ars, dong``), ``points``
    (``dong, lng, lat, in_area``) and ``area_point`` (one row ``lng, lat``, for stops of the area whose own district isn't
    in it). Other ends in districts that begin with ``home`` go; those without a district stay, with no distance.
    """
    here, there = ("board_ars", "alight_ars") if boarding else ("alight_ars", "board_ars")
    ends = legs.select(F.lpad(here, 5, "0").alias("here"), F.lpad(there, 5, "0").alias("there"), "passengers")
    inside = area_stops.select(F.lpad("ars", 5, "0").alias("here")).distinct()
    out = ends.join(inside, "here", "left_semi").join(inside.select(F.col("here").alias("there")), "there", "left_anti")
    pairs = out.groupBy("here", "there").agg(F.sum("passengers").alias("passengers"))
    far = placed.select(F.col("ars").alias("there"), "dong").join(points.select("dong", F.col("lng").alias("t_lng"), F.col("lat").alias("t_lat")), "dong", "left")
    near = placed.select(F.col("ars").alias("here"), F.col("dong").alias("h_dong")).join(points.where("in_area").select(F.col("dong").alias("h_dong"), F.col("lng").alias("h_lng"), F.col("lat").alias("h_lat")), "h_dong")
    joined = pairs.join(far, "there", "left").where(F.col("dong").isNull() | ~F.startswith(F.col("dong"), F.lit(home))).join(near, "here", "left")
    one = joined.crossJoin(F.broadcast(area_point.select(F.col("lng").alias("a_lng"), F.col("lat").alias("a_lat"))))
    km = sphere_km(F.coalesce("h_lat", "a_lat"), F.coalesce("h_lng", "a_lng"), F.col("t_lat"), F.col("t_lng"))
    return one.groupBy("dong", km.alias("km")).agg(F.sum("passengers").alias("passengers"))


def routes_of_area(legs: DataFrame, area_stops: DataFrame, placed: DataFrame, most: int = 5) -> DataFrame:
    """Riders boarding in an area by route and the district where they alight: the ``most`` biggest of each route with
    their ``rank``, and per route all its ``boardings`` and those ``unplaced``, whose stop has no district."""
    inside = legs.join(area_stops.select(F.col("ars").alias("board_ars")).distinct(), "board_ars", "left_semi")
    to = placed.select(F.col("ars").alias("alight_ars"), "dong")
    sums = inside.join(to, "alight_ars", "left").groupBy("route", "dong").agg(F.sum("passengers").alias("riders"))
    of = Window.partitionBy("route")
    ranked = sums.withColumns({
        "boardings": F.sum("riders").over(of), "unplaced": F.coalesce(F.sum(F.when(F.col("dong").isNull(), F.col("riders"))).over(of), F.lit(0.0)),
        "rank": F.row_number().over(of.orderBy(F.col("dong").isNull(), F.desc("riders"), "dong")),
    })
    return ranked.where(F.col("dong").isNotNull() & (F.col("rank") <= most))


def period_pairs(rows: DataFrame, first: str, last: str, day_type: str) -> DataFrame:
    """Mean riders a day of each pair of districts in a period, by mode: each mode's sum over the days of the type that
    have trips of that mode; null where it has no day. ``rows`` has ``day, day_type, origin, dest, subway, bus``."""
    inside = rows.where(F.col("day").between(first, last) & (F.col("day_type") == day_type))
    days = inside.agg(*[F.count_distinct(F.when(F.col(m) > 0, F.col("day"))).alias(f"__{m}") for m in ("subway", "bus")])
    sums = inside.groupBy("origin", "dest").agg(F.sum("subway").alias("subway"), F.sum("bus").alias("bus")).crossJoin(F.broadcast(days))  # one row
    return sums.select("origin", "dest", *[F.try_divide(F.col(m), F.col(f"__{m}")).alias(m) for m in ("subway", "bus")])
