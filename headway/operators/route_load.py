"""Riders on board: running loads, road segments, placed trips, select link and reach.

A leg is (route, board stop, alight stop, passengers); stations are the stops of a route's variants in order. Legs
that end before they begin count in totals but in no load.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import ars_or_null, ars_or_virtual, is_real_ars
from ..functions.numbers import class_of, log_breaks
from ..sources.files import saved
from . import ranks


def ordered(legs: DataFrame) -> DataFrame:
    return legs.where("alight_seq > board_seq")


def stop_flows(legs: DataFrame) -> DataFrame:
    """Boardings and alightings per route and position."""
    ons = legs.select("route", F.col("board_seq").alias("seq"), F.col("passengers").alias("ons"), F.lit(0.0).alias("offs"))
    offs = legs.select("route", F.col("alight_seq").alias("seq"), F.lit(0.0).alias("ons"), F.col("passengers").alias("offs"))
    return ons.unionByName(offs).groupBy("route", "seq").agg(F.sum("ons").alias("ons"), F.sum("offs").alias("offs"))


def on_board(legs: DataFrame) -> DataFrame:
    """Adds ``load``, the riders on board after each stop, never below 0."""
    w = Window.partitionBy("route").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return stop_flows(ordered(legs)).withColumn("load", F.greatest(F.sum(F.col("ons") - F.col("offs")).over(w), F.lit(0.0)))


def occupancy(legs: DataFrame, hours: int = 19) -> DataFrame:
    """Riders per service hour after each stop (rounded, ties to even) and the route's largest."""
    w = Window.partitionBy("route").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    run = stop_flows(legs).withColumn("run", F.sum(F.col("ons") - F.col("offs")).over(w))
    rows = run.select("route", "seq", F.when(F.col("run") < 0, 0).otherwise(F.rint(F.col("run") / hours).cast("int")).alias("occupancy"))
    return rows.withColumn("most", F.max("occupancy").over(Window.partitionBy("route")))


def _between(ends: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """Running sums of ``values`` at every position where any trip is under way. ``ends`` has a row per end of a trip, its start
    with ``__on`` 1 and its end with ``__on`` -1 and the values negated: trips aren't repeated for the positions they pass."""
    sums = ends.groupBy(*keys, at).agg(*[F.sum(c).alias(c) for c in [*values, "__on"]])
    w = Window.partitionBy(*keys).orderBy(at)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    run = sums.select(*keys, at, F.lead(at).over(w).alias("__next"), *[F.sum(c).over(so_far).alias(c) for c in [*values, "__on"]]).where("__on > 0")
    return run.select(*keys, F.explode(F.sequence(F.col(at), F.col("__next") - 1)).alias(at), *values)


def _both_ends(trips: DataFrame, keys: list[str], start: str, end: str, at: str, values: list[Column]) -> DataFrame:
    end_of = lambda c, sign: F.struct(F.col(c).alias("p"), F.lit(sign).alias("s"))
    each = trips.where(F.col(start) < F.col(end)).select("*", F.explode(F.array(end_of(start, 1), end_of(end, -1))).alias("__end"))
    return each.select(*keys, F.col("__end.p").alias(at), F.col("__end.s").alias("__on"), *[(F.col("__end.s") * v).alias(f"v{i}") for i, v in enumerate(values)])


def segment_loads(legs: DataFrame) -> DataFrame:
    """Riders between each position and the next."""
    ends = _both_ends(legs, ["route"], "board_seq", "alight_seq", "seq", [F.col("passengers")])
    return _between(ends, ["route"], "seq", ["v0"]).withColumnRenamed("v0", "load")


#: Stands for the number of a boarding at the depot.
DEPOT = "depot"


def place(legs: DataFrame, stations: DataFrame) -> DataFrame:
    """Each leg on its best variant: the columns of the leg with ``variant``, ``from_at`` and ``to_at`` (positions in
    the variant from 0), null where no variant serves it in order.

    A stop that occurs twice in a variant is chosen by the leg's sequences, else by the shortest span; the variant of
    the shortest span wins, then the first by name. Riders from the depot (sequence 0 without a stop number) board at
    the variant's first stop.
    """
    at = Window.partitionBy("route", "variant").orderBy("seq")
    s = stations.withColumns({"at": F.row_number().over(at) - 1, "s_ars": ars_or_null(F.col("ars"))})
    s = s.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("route", "variant", "s_ars")))
    entry = F.struct("variant", "at", "seq", "times")
    # a stop stands in a few variants; the depot's key leads to the first stop of each
    keyed = s.where("s_ars is not null").select("route", F.col("s_ars").alias("__key"), entry.alias("e"))
    depot = s.where("at = 0").select("route", F.lit(DEPOT).alias("__key"), entry.alias("e"))
    places = lambda rows: rows.groupBy("route", "__key").agg(F.collect_list("e").alias("__found"))
    b, a = ars_or_null(F.col("board_ars")), ars_or_null(F.col("alight_ars"))
    rows = legs.where("passengers > 0").withColumns({"__b": b, "__from_key": F.coalesce(b, F.when(F.col("board_seq") == 0, DEPOT)), "__to_key": a})
    froms = places(keyed.unionByName(depot)).select("route", F.col("__key").alias("__from_key"), F.col("__found").alias("__from"))
    tos = places(keyed).select("route", F.col("__key").alias("__to_key"), F.col("__found").alias("__to"))
    rows = rows.join(froms, ["route", "__from_key"], "left").join(tos, ["route", "__to_key"], "left")

    def pair(x: Column, y: Column) -> Column:
        repeated = (y["times"] > 1) | F.col("__b").isNotNull() & (x["times"] > 1)
        by_seq = F.col("board_seq").isNotNull() & F.col("alight_seq").isNotNull() & repeated
        span = y["at"] - x["at"]
        score = F.when(by_seq, F.abs(x["seq"] - F.col("board_seq")) + F.abs(y["seq"] - F.col("alight_seq"))).otherwise(span)
        return F.struct(x["variant"].alias("variant"), score.alias("score"), span.alias("span"), x["at"].alias("from_at"), y["at"].alias("to_at"))

    later = lambda x: F.filter("__to", lambda y: (y["variant"] == x["variant"]) & (y["at"] > x["at"]))
    pairs = F.array_sort(F.flatten(F.transform("__from", lambda x: F.transform(later(x), lambda y: pair(x, y)))))
    rows = rows.withColumn("__pairs", pairs)
    first_of_variant = F.filter("__pairs", lambda p, i: (i == 0) | (p["variant"] != F.get("__pairs", i - 1)["variant"]))
    best = F.array_min(F.transform(first_of_variant, lambda p: F.struct(*[p[c].alias(c) for c in ("span", "variant", "from_at", "to_at")])))
    return rows.withColumn("__best", best).select(*legs.columns, *[F.col(f"__best.{c}").alias(c) for c in ("variant", "from_at", "to_at")])


def placed_loads(placed: DataFrame) -> DataFrame:
    """Riders per variant and segment (position of its first stop)."""
    ends = _both_ends(placed.where("variant is not null"), ["variant"], "from_at", "to_at", "at", [F.col("passengers")])
    return _between(ends, ["variant"], "at", ["v0"]).withColumnRenamed("v0", "load")


def hourly_loads(placed: DataFrame, shares: DataFrame, otherwise: list[float]) -> DataFrame:
    """Riders per variant, boarding ``hour`` and segment, all hours in one pass. ``shares`` has ``route``, ``ars`` and ``share`` (24
    numbers that sum to 1); stops without one take ``otherwise``, and trips from stops without a usable number are left out.
    Trips are summed by their ends and boarding stop before they are spread over hours, and the hours of a position stay side by side
    in one row until its loads are known: a row per hour would give every partial sum 24 keys for one."""
    usable = placed.where("variant is not null").withColumn("__ars", ars_or_virtual(F.col("board_ars"))).where(is_real_ars(F.col("__ars")))
    ends = _both_ends(usable, ["variant", "route", "__ars"], "from_at", "to_at", "at", [F.col("passengers")])
    sums = ends.groupBy("variant", "route", "__ars", "at").agg(F.sum("v0").alias("riders"), F.sum("__on").alias("__on"))
    known = shares.select("route", F.col("ars").alias("__ars"), "share")
    used = sums.join(known, ["route", "__ars"], "left").withColumn("share", F.coalesce("share", F.array(*map(F.lit, otherwise))))
    hours = [f"h{h}" for h in range(len(otherwise))]
    spread = used.select("variant", "at", "__on", *[(F.col("riders") * F.get("share", F.lit(h))).alias(c) for h, c in enumerate(hours)])
    return _between(spread, ["variant"], "at", hours).select("variant", F.posexplode(F.array(*hours)).alias("hour", "load"), "at").select("variant", "hour", "at", "load")


def _ends_of_segments(stations: DataFrame) -> DataFrame:
    w = Window.partitionBy("route", "variant").orderBy("seq")
    ars = ars_or_null(F.col("ars"))
    s = stations.select("route", "variant", (F.row_number().over(w) - 1).alias("at"), ars.alias("from_ars"), F.lead(ars).over(w).alias("to_ars"))
    alone = F.when(F.col("from_ars").isNull() | F.col("to_ars").isNull(), F.concat_ws("#", "variant", "at"))
    return s.withColumn("alone", alone)  # null unless the segment can't be merged


def legend(hourly: DataFrame, stations: DataFrame) -> DataFrame:
    """``hour`` and ``most``, the largest load of a merged segment in it; the largest of all hours is that of a map's legend."""
    joined = hourly.join(_ends_of_segments(stations), ["variant", "at"])
    key = [F.when(F.col("alone").isNull(), F.col(c)).alias(c) for c in ("from_ars", "to_ars")]
    return joined.groupBy("hour", *key, "alone").agg(F.sum("load").alias("load")).groupBy("hour").agg(F.max("load").alias("most"))


def links(stations: DataFrame, from_ars: str, to_ars: str) -> DataFrame:
    """``route``, ``l_variant`` and ``__at``, where each variant goes from one stop to another (several positions, if it does so again)."""
    w = Window.partitionBy("route", "variant").orderBy("seq")
    s = stations.withColumns({"at": F.row_number().over(w) - 1, "next_ars": F.lead("ars").over(w)})
    found = s.where((F.col("ars") == from_ars) & (F.col("next_ars") == to_ars))
    return found.groupBy("route", F.col("variant").alias("l_variant")).agg(F.collect_list("at").alias("__at"))


def crossing(placed: DataFrame, stations: DataFrame, from_ars: str, to_ars: str) -> DataFrame:
    """Placed legs whose span has the segment between two stops. The positions meet a leg's variant as one list: a semi-join on
    positions would move below the placing, which its condition would repeat."""
    at = links(stations, from_ars, to_ars).select("l_variant", "__at")
    met = placed.join(at, F.col("variant") == F.col("l_variant"))
    return met.where(F.exists("__at", lambda a: a.between(F.col("from_at"), F.col("to_at") - 1))).select(*placed.columns)


def legs_crossing(legs: DataFrame, stations: DataFrame, from_ars: str, to_ars: str) -> DataFrame:
    """The same from legs: only those of routes that have the segment are placed."""
    routes = saved(links(stations, from_ars, to_ars).select("route").distinct(), "routes")
    some = lambda rows: rows.join(routes, "route", "left_semi")
    return crossing(place(some(legs), some(stations)), some(stations), from_ars, to_ars)


def merged_segments(loads: DataFrame, stations: DataFrame) -> DataFrame:
    """Loads of the same stop pair of all variants together, with ``by_route`` (riders of each route, by its name) and the number
    of ``variants``. A segment whose ends lack a number stays alone: ``alone`` is its variant and position."""
    joined = loads.join(_ends_of_segments(stations), ["variant", "at"])
    of_route = joined.groupBy("from_ars", "to_ars", "alone", "route").agg(F.sum("load").alias("load"), F.count_distinct("variant").alias("variants"))
    by_route = F.map_from_entries(F.sort_array(F.collect_list(F.struct("route", "load"))))
    return of_route.groupBy("from_ars", "to_ars", "alone").agg(F.sum("load").alias("load"), F.sum("variants").alias("variants"), by_route.alias("by_route"))


#: Colour and width of each class of load on a map, few riders first (fixed values).
LOAD_COLORS = ("#006837", "#1a9850", "#66bd63", "#a6d96a", "#d9ef8b", "#fee08b", "#fdae61", "#f46d43", "#d73027", "#a50026")
LOAD_WEIGHTS = (2.5, 3.0, 3.5, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0)


def styled(segments: DataFrame, least: float = 0.0, scale_to: float | None = None) -> DataFrame:
    """Segments with riders (``load``) of ``least`` or more, with ``level`` (class from 0), ``color`` and ``weight``. Classes
    are split at quantiles of the loads shown, or with ``scale_to`` at equal factors up to it. The quantiles
    are those of the whole map, from a sort by load."""
    kept = segments.where((F.col("load") > 0) & (F.col("load") >= least))
    classes = len(LOAD_COLORS)
    if scale_to is None:
        kept = kept.withColumn("__breaks", F.array(*map(F.lit, ranks.class_limits(kept, "load", classes))).cast("array<double>"))
    else:
        low = max(1.0, least, scale_to / 1000)
        limits = log_breaks(low, F.lit(scale_to), classes) if low < scale_to else F.array(*[F.lit(scale_to)] * (classes - 1))
        kept = kept.withColumn("__breaks", limits)
    level = class_of(F.col("load"), F.col("__breaks")).cast("int")
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("level") + 1)
    return kept.withColumn("level", level).withColumns({"color": of(LOAD_COLORS), "weight": of(LOAD_WEIGHTS)}).drop("__breaks")


def segment_split(legs: DataFrame, first: int, last: int) -> DataFrame:
    """Riders of each route within, leaving, entering and passing through the positions ``first`` to ``last``."""
    b, a, p = F.col("board_seq"), F.col("alight_seq"), F.col("passengers")
    b_in, a_in = b.between(first, last), a.between(first, last)
    part = lambda c, n: F.coalesce(F.sum(F.when(c, p)), F.lit(0.0)).alias(n)
    return ordered(legs).groupBy("route").agg(
        part(b_in & a_in, "within"), part(b_in & (a > last), "leaving"), part((b < first) & a_in, "entering"), part((b < first) & (a > last), "through")
    )


def reach(legs: DataFrame, levels: list[float]) -> DataFrame:
    """For each route and position with riders on board and each level: the farthest position after which more than
    that many of them are still on board."""
    cuts = legs.select("route", "board_seq", "alight_seq", "passengers").where("alight_seq > board_seq")
    # the riders on board at k: those that board at or before k and alight after it
    spans = cuts.select("route", F.explode(F.sequence("board_seq", F.col("alight_seq") - 1)).alias("k"), "alight_seq", "passengers")
    ends = spans.groupBy("route", "k", "alight_seq").agg(F.sum("passengers").alias("p"))
    w = Window.partitionBy("route", "k").orderBy(F.desc("alight_seq")).rowsBetween(Window.unboundedPreceding, 0)
    still = ends.withColumn("still", F.sum("p").over(w))  # on board just before alight_seq
    rows = still.crossJoin(F.broadcast(still.sparkSession.createDataFrame([(float(x),) for x in levels], "level double")))
    return rows.where("still > level").groupBy("route", "k", "level").agg((F.max("alight_seq") - 1).alias("until"))


def area_legs(legs: DataFrame, stops: DataFrame, how: str) -> DataFrame:
    """Legs that board (``from``), alight (``to``) or do either (``any``, each leg once) at a table of stops (``ars``)."""
    keys = stops.select("ars").distinct()
    marked = legs.join(keys.select(F.col("ars").alias("board_ars"), F.lit(True).alias("__b")), "board_ars", "left")
    marked = marked.join(keys.select(F.col("ars").alias("alight_ars"), F.lit(True).alias("__a")), "alight_ars", "left")
    want: dict[str, Column] = {"from": F.col("__b"), "to": F.col("__a"), "any": F.col("__b") | F.col("__a")}
    return marked.where(F.coalesce(want[how], F.lit(False))).select(*legs.columns)
