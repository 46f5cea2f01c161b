"""Riders over the day: bases of a view (typical day, period, hours), and alightings reproduced from boardings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hourly

PAIR = ["route", "board_ars", "alight_ars"]


def basis(typical: DataFrame, daily: DataFrame, period: tuple[str, str] | None = None, hours: tuple[int, int] | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """Riders of each stop pair on a typical day, or on the mean day of a period (first and last date); with ``hours``
    (first and last) only those who board in them, by the boarding stop's profile or else the default one."""
    if period is None:
        rows = typical.groupBy(*PAIR).agg(F.sum("passengers").alias("passengers"))
    else:
        legs = daily.where(F.col("service_date").between(*period))
        days = legs.agg(F.count_distinct("service_date").alias("days"))
        sums = legs.groupBy(*PAIR).agg(F.sum("passengers").alias("p"))
        rows = sums.crossJoin(F.broadcast(days)).select(*PAIR, (F.col("p") / F.col("days")).alias("passengers"))  # one row
    if hours is None:
        return rows
    shares = profiles.where(F.col("hour").between(*hours)).groupBy("route", F.col("ars").alias("board_ars")).agg(F.sum("ratio").alias("share"))
    known = profiles.groupBy("route", F.col("ars").alias("board_ars")).agg(F.sum("ratio").alias("total"))
    default = sum(hourly.default_profile()[hours[0] : hours[1] + 1])
    share = F.when(F.col("total") > 0, F.coalesce("share", F.lit(0.0))).otherwise(default)
    joined = rows.join(known.join(shares, ["route", "board_ars"], "left"), ["route", "board_ars"], "left")
    return joined.select(*PAIR, (F.col("passengers") * share).alias("passengers"))


def alightings(boardings: DataFrame, minutes: list[float]) -> DataFrame:
    """Riders by hour of alighting: ``boardings`` (``route, alight_ars, hour, span, riders``) moved on by ``span`` stops of
    each of ``minutes``. Boardings are spread evenly over their hour, so a move by part of an hour splits them."""
    moved = boardings.withColumn("minutes", F.explode(F.array(*[F.lit(float(m)) for m in minutes])))
    shift = F.col("span") * F.col("minutes") / 60
    part = F.col("shift") - F.floor("shift")
    pieces = F.array(F.struct(F.lit(0).alias("on"), (1 - part).alias("w")), F.struct(F.lit(1).alias("on"), part.alias("w")))
    rows = moved.withColumn("shift", shift).withColumn("piece", F.explode(pieces)).where("piece.w > 0")
    hour = ((F.col("hour") + F.floor("shift") + F.col("piece.on")) % 24).cast("int")
    return rows.groupBy("minutes", "route", F.col("alight_ars").alias("ars"), hour.alias("hour")).agg(F.sum(F.col("riders") * F.col("piece.w")).alias("riders"))


def over_hours(trips: DataFrame, shares: DataFrame) -> DataFrame:
    """``trips`` (``route, board_ars, p`` and more) over the hours of ``shares`` (``route, board_ars, hour, ratio``), as ``riders``.
    Rows stay with their route, whose profiles come as one map: what groups by route and more afterwards moves no rows. Trips
    without a profile are left out."""
    n = int(trips.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stops = shares.groupBy("route", "board_ars").agg(F.collect_list(F.struct("hour", "ratio")).alias("hours"))
    routes = stops.where("board_ars is not null").groupBy("route").agg(F.map_from_entries(F.collect_list(F.struct("board_ars", "hours"))).alias("profiles"))
    keep = [c for c in trips.columns if c != "p"]
    rows = trips.repartition(n, "route").join(routes.repartition(n, "route").hint("shuffle_hash"), "route")
    split = rows.select(*keep, "p", F.explode(F.try_element_at("profiles", "board_ars")).alias("x"))
    return split.select(*keep, "x.hour", (F.col("p") * F.col("x.ratio")).alias("riders"))


def wape(predicted: DataFrame, counted: DataFrame, group: list[str], keys: list[str], by: list[str]) -> DataFrame:
    """Sum of absolute errors over the sum of counts, per ``by`` (columns of ``predicted``, such as a variant's name). First
    each ``group`` of a variant is scaled to its counted total, so that errors are about the shape over ``keys``; groups
    that only one side has are left out."""
    # rows of a group stay together, so that its keys are gathered and both sides meet without moving again
    totals = lambda rows, cols: rows.groupBy(*cols, *keys).agg(F.sum("riders").alias("v")).repartition(*group)
    listed = lambda rows, name, cols: rows.groupBy(*cols).agg(F.map_from_entries(F.collect_list(F.struct(F.struct(*keys), "v"))).alias(name), F.sum("v").alias(f"{name}_all"))
    p = listed(totals(predicted, [*by, *group]), "p", [*by, *group]).where("p_all > 0")
    both = p.join(listed(totals(counted, group), "c", group), group)
    # every key that either side has, within the groups of both
    off = lambda k, x, y: F.abs(F.coalesce(x, F.lit(0.0)) * F.col("c_all") / F.col("p_all") - F.coalesce(y, F.lit(0.0)))
    error: Column = F.aggregate(F.map_values(F.map_zip_with("p", "c", off)), F.lit(0.0), lambda s, x: s + x)
    return both.groupBy(*by).agg((F.sum(error) / F.sum("c_all")).alias("wape"))
