"""Cohorts of riders: who is on board after each stop of a route, by the stop where they get off.

``cohorts`` is one table (stop x alighting stop) of sums, whose size is that of the routes' stops, not of the trips; on-board
riders, cuts, how far a load carries and the most common ends are all read from it. Trips that end before they begin count in no
cohort, but their stops are stops of the route.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .route_load import on_board, ordered, stop_flows

LEVELS = (25.0, 50.0, 100.0, 200.0)
TOP = 10


def route_stops(legs: DataFrame) -> DataFrame:
    """``route``, ``seq``, ``ars`` (the least of those seen), ``before`` (the stop before it) and ``off_before`` (the last
    stop before it where anyone alights)."""
    ends = [legs.select("route", F.col(f"{side}_seq").alias("seq"), F.col(f"{side}_ars").alias("ars"), F.lit(side == "alight").alias("off")) for side in ("board", "alight")]
    rows = ends[0].unionByName(ends[1]).where("seq is not null").groupBy("route", "seq").agg(F.min("ars").alias("ars"), F.max("off").alias("off"))
    w = Window.partitionBy("route").orderBy("seq")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("route", "seq", "ars", F.lag("seq").over(w).alias("before"), F.max(F.when(F.col("off"), F.col("seq"))).over(earlier).alias("off_before"))


def pairs(legs: DataFrame) -> DataFrame:
    return ordered(legs).groupBy("route", "board_seq", "alight_seq").agg(F.sum("passengers").alias("riders"))


def cohorts(legs: DataFrame, boarded_before: tuple[int, ...] = ()) -> DataFrame:
    """Per ``route``, stop ``seq`` and later ``alight_seq``: ``riders`` on board after the stop that alight there, ``after`` (riders
    on board at the stop who go farther), ``before`` and ``off_before`` of the alighting stop, and ``early_i``, the riders that
    boarded before the i-th of ``boarded_before``."""
    off = Window.partitionBy("route", "alight_seq").orderBy("board_seq")
    boarded = off.rowsBetween(Window.unboundedPreceding, 0)
    measures = {"riders": F.sum("riders").over(boarded)}
    for i, cut in enumerate(boarded_before):
        measures[f"early_{i}"] = F.coalesce(F.sum(F.when(F.col("board_seq") < cut, F.col("riders"))).over(boarded), F.lit(0.0))
    until = F.coalesce(F.lead("board_seq").over(off), F.col("alight_seq")) - 1
    runs = pairs(legs).select("route", "alight_seq", "board_seq", until.alias("until"), *[c.alias(n) for n, c in measures.items()])
    each = runs.select("route", "alight_seq", F.explode(F.sequence("board_seq", "until")).alias("seq"), *measures)
    stops = route_stops(legs)
    each = each.join(stops.select("route", "seq"), ["route", "seq"])
    each = each.join(stops.select("route", F.col("seq").alias("alight_seq"), F.col("ars").alias("alight_ars"), "before", "off_before"), ["route", "alight_seq"])
    farther = Window.partitionBy("route", "seq").orderBy(F.desc("alight_seq")).rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("after", F.coalesce(F.sum("riders").over(farther), F.lit(0.0)))


def _until(level: float, on_any_stop: bool) -> Column:
    """The farthest stop after which more than ``level`` of a cohort are on board: the one before the first stop after which no
    more are. Null if no more are on board at all."""
    stop = F.col("before" if on_any_stop else "off_before")
    reached = F.min(F.when(F.col("after") <= level, F.greatest(stop, F.col("seq")) if on_any_stop else stop))
    if not on_any_stop:
        reached = F.when(reached >= F.first("seq"), reached)
    return F.when(F.sum("riders") > level, reached)


def _top(n: int, seq: str, *more: str) -> Column:
    """The ``n`` largest of a group by ``riders``, ties to the lower position: structs of ``seq``, ``more`` and ``riders``."""
    rows = F.sort_array(F.collect_list(F.struct((-F.col("riders")).alias("less"), F.col(seq).alias("seq"), *more)))
    return F.transform(F.slice(rows, 1, n), lambda x: F.struct(x["seq"].alias("seq"), *[x[c].alias("ars") for c in more], (-x["less"]).alias("riders")))


def stop_details(legs: DataFrame, levels: tuple[float, ...] = LEVELS, top: int = TOP) -> DataFrame:
    """For every stop of every route: ``ars``, ``boardings``, ``alightings``, ``on_board`` after it, the ``top`` most common
    ``destinations`` and ``origins`` (seq, ars, riders), and ``reach``: per level the farthest stop after which more than
    that many of those on board are still on board, null if there never are."""
    stops = route_stops(legs)
    named = lambda side: stops.select("route", F.col("seq").alias(f"{side}_seq"), F.col("ars").alias(f"{side}_ars"))
    p = pairs(legs).join(named("board"), ["route", "board_seq"]).join(named("alight"), ["route", "alight_seq"])
    to = p.groupBy("route", F.col("board_seq").alias("seq")).agg(_top(top, "alight_seq", "alight_ars").alias("destinations"))
    of = p.groupBy("route", F.col("alight_seq").alias("seq")).agg(_top(top, "board_seq", "board_ars").alias("origins"))
    reach = F.array(*[F.struct(F.lit(x).alias("level"), _until(x, True).alias("until")) for x in sorted(set(levels))])
    board = cohorts(legs).groupBy("route", "seq").agg(F.sum("riders").alias("on_board"), reach.alias("reach"))
    out = stops.select("route", "seq", "ars").join(stop_flows(ordered(legs)), ["route", "seq"], "left")
    for part in (board, to, of):
        out = out.join(part, ["route", "seq"], "left")
    return out.select(
        "route", "seq", "ars", *[F.coalesce(c, F.lit(0.0)).alias(n) for c, n in (("ons", "boardings"), ("offs", "alightings"), ("on_board", "on_board"))], "destinations", "origins", "reach"
    )


def load_report(legs: DataFrame, first: int, last: int, cuts: tuple[int, ...], toward: bool, top: int, levels: tuple[float, ...]) -> DataFrame:
    """For every stop with riders on board from ``first`` to ``last``: ``on_board``, ``cut_i`` (of those, how many alight after
    the i-th cut or, not ``toward``, boarded before it), ``reach_i`` (the farthest alighting stop after which more than the i-th
    level are on board) and ``destinations``, where most of those on board alight."""
    rows = cohorts(legs, () if toward else cuts).where(F.col("seq").between(first, last))
    of = lambda i, c: F.sum(F.when(F.col("alight_seq") > c, F.col("riders")).otherwise(0.0) if toward else F.col(f"early_{i}")).alias(f"cut_{i}")
    return rows.groupBy("route", "seq").agg(
        F.sum("riders").alias("on_board"), *[of(i, c) for i, c in enumerate(cuts)], *[_until(x, False).alias(f"reach_{i}") for i, x in enumerate(levels)],
        _top(top, "alight_seq", "alight_ars").alias("destinations"),
    )


def segment_report(legs: DataFrame, first: int, last: int, top: int = TOP) -> DataFrame:
    """For every stop from ``first`` to ``last`` of a route: ``boardings``, ``alightings``, ``load`` after it, ``leaving`` (those who
    board here and alight past ``last``) and ``leaving_so_far``; with the route's ``within``, ``out``, ``entering`` and ``through`` and
    its ``top`` stops ``beyond`` (where those who leave alight) and ``earlier`` (where those who enter board)."""
    b, a = F.col("board_seq").between(first, last), F.col("alight_seq").between(first, last)
    p = pairs(legs)
    leave, enter = b & (F.col("alight_seq") > last), (F.col("board_seq") < first) & a
    sums = lambda c, n: F.coalesce(F.sum(F.when(c, F.col("riders"))), F.lit(0.0)).alias(n)
    parts = p.groupBy("route").agg(sums(b & a, "within"), sums(leave, "out"), sums(enter, "entering"), sums((F.col("board_seq") < first) & (F.col("alight_seq") > last), "through"))
    ends = lambda c, side, name: p.where(c).groupBy("route", side).agg(F.sum("riders").alias("riders")).groupBy("route").agg(_top(top, side).alias(name))
    here = p.where(leave).groupBy("route", F.col("board_seq").alias("seq")).agg(F.sum("riders").alias("leaving"))
    stops = route_stops(legs).select("route", "seq", "ars").join(on_board(legs), ["route", "seq"], "left").where(F.col("seq").between(first, last)).join(here, ["route", "seq"], "left")
    so_far = F.sum("leaving").over(Window.partitionBy("route").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("ons", "offs", "load", "leaving")}
    stops = stops.withColumns(zero).withColumn("leaving_so_far", so_far).withColumnsRenamed({"ons": "boardings", "offs": "alightings"})
    return stops.join(parts, "route", "left").join(ends(leave, "alight_seq", "beyond"), "route", "left").join(ends(enter, "board_seq", "earlier"), "route", "left")
