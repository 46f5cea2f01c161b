"""Ferry trips among origin-destination rows: recognising them, their piers' positions, and days of closed piers.

A row is a ferry trip if it has neither a route nor stop numbers, boards at a pier, and alights at a pier or nowhere. A
trip without an end ends at the next pier; one that ends where it began began at the pier before. Piers stand in the
order of the river, and the first and last have one neighbour only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Piers in order, another name of one, and those west and east of the pier where the line was split (fixed values).
PIERS = ("마곡", "망원", "여의도", "압구정", "옥수", "성수", "뚝섬", "잠실")
ALIASES = {"서울숲": "성수"}
WEST, EAST = ("마곡", "망원"), ("압구정", "옥수", "성수", "뚝섬", "잠실")
ROUTE, SPLIT_FROM = "한강버스01", "2026-03-01"


def _piers() -> Column:
    return F.array(*map(F.lit, PIERS))


def _position(name: Column) -> Column:
    return F.array_position(_piers(), name).cast("int")


def _positions(rows: DataFrame, side: str) -> DataFrame:
    """Adds ``__{side}``, the position of a side's pier by any of its names; null where it is no pier. It is looked up in a table of
    the names, so that what asks for it afterwards compares numbers and doesn't repeat what made the name."""
    names = F.array(*[F.struct(F.lit(n).alias("__name"), F.lit(PIERS.index(ALIASES.get(n, n)) + 1).alias(f"__{side}")) for n in (*PIERS, *ALIASES)])
    table = rows.sparkSession.range(1).select(F.inline(names))
    return rows.join(F.broadcast(table), F.col(f"{side}_name") == F.col("__name"), "left").drop("__name")


def corrected(rows: DataFrame, route: str = ROUTE) -> DataFrame:
    """All rows, ferry trips with their route, piers and positions; and ``kind``: ``no_alighting``, ``same_pier`` or
    ``ferry`` for trips, ``other`` for other rows without a route, null for the rest."""
    board, alight = F.col("__board"), F.col("__alight")
    bare = F.col("route").isNull() & F.col("board_ars").isNull() & F.col("alight_ars").isNull()
    trip = bare & board.isNotNull() & (F.col("alight_name").isNull() | alight.isNotNull())
    kind = F.when(trip & alight.isNull(), "no_alighting").when(trip & (board == alight), "same_pier").when(trip, "ferry").when(F.col("route").isNull(), "other")
    d = _positions(_positions(rows, "board"), "alight").withColumn("kind", kind)
    is_trip = F.col("kind").isin("no_alighting", "same_pier", "ferry")
    # the pier before or after; at the line's ends the only neighbour
    d = d.withColumns({
        "__board": F.when(F.col("kind") == "same_pier", F.when(board == 1, 2).otherwise(board - 1)).otherwise(board),
        "__alight": F.when(F.col("kind") == "no_alighting", F.when(board == len(PIERS), board - 1).otherwise(board + 1)).otherwise(alight),
    })
    name = lambda side: F.coalesce(F.get(_piers(), F.col(f"__{side}") - 1), F.col(f"{side}_name"))
    return d.withColumns({
        "route": F.when(is_trip, route).otherwise(F.col("route")),
        "board_seq": F.when(is_trip, board).otherwise(F.col("board_seq")),
        "alight_seq": F.when(is_trip, alight).otherwise(F.col("alight_seq")),
        "board_name": name("board"), "alight_name": name("alight"),
    }).select(*rows.columns, "kind")


def closures(calendar: DataFrame) -> DataFrame:
    """``service_date`` and its ``closed`` piers in order, from spans ``first``, ``last``, ``piers`` (comma-separated, or
    ``all``). A name that is no pier fails."""
    names = F.when(F.col("piers") == "all", _piers()).otherwise(F.split("piers", ","))
    unknown = calendar.where(F.exists(names, lambda p: ~p.isin(*PIERS))).limit(1).collect()
    if unknown:
        raise ValueError(f"no such pier: {unknown[0]['piers']}")
    days = calendar.select(F.explode(F.sequence("first", "last")).alias("service_date"), F.explode(names).alias("pier"))
    ordered = F.array_sort(F.collect_set(F.struct(_position(F.col("pier")).alias("at"), "pier")))
    return days.groupBy("service_date").agg(F.transform(ordered, lambda x: x["pier"]).alias("closed"))


def by_day(trips: DataFrame, closed: DataFrame, split_from: str = SPLIT_FROM) -> DataFrame:
    """Per day of the trips of ``corrected``: rows, passengers, the piers closed that day, passengers at these, and from the
    split of the line on those who change between its halves (null before)."""
    ends = lambda side, piers: F.col(f"{side}_name").isin(*piers)
    across = ends("board", WEST) & ends("alight", EAST) | ends("board", EAST) & ends("alight", WEST)
    rows = trips.where(F.col("kind").isin("no_alighting", "same_pier", "ferry")).join(closed, "service_date", "left")
    shut = F.array_contains("closed", F.col("board_name")) | F.array_contains("closed", F.col("alight_name"))
    riders = lambda c: F.coalesce(F.sum(F.when(c, F.col("passengers"))), F.lit(0)).cast("long")
    sums = rows.groupBy("service_date").agg(
        F.count(F.lit(1)).alias("n"), riders(F.lit(True)).alias("passengers"), F.coalesce(F.array_join(F.first("closed"), ","), F.lit("")).alias("closed"),
        riders(shut).alias("at_closed"), riders(across).alias("changing"),
    )
    return sums.withColumn("changing", F.when(F.col("service_date") >= F.lit(split_from).cast("date"), F.col("changing")))
