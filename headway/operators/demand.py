"""Demand at stops and stations: district, catchment, node and search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import to_count
from .lookups import first_per


def selected(demand: DataFrame, days: list[int] | None = None, hours: list[int] | None = None, modes: list[str] | None = None) -> DataFrame:
    """Rows of the chosen days, hours and modes; an empty or missing list chooses all."""
    for column, wanted in (("dow", days), ("hour", hours), ("mode", modes)):
        if wanted:
            demand = demand.where(F.col(column).isin(*wanted))
    return demand


def summed(demand: DataFrame, keys: list[str], n_days: int | None = None) -> DataFrame:
    """Boardings and alightings per key: whole numbers row by row, or their mean over ``n_days``, rounded at the end."""
    if n_days is None:
        part = lambda c: F.sum(to_count(F.col(c))).alias(c)
    else:
        part = lambda c: F.round(F.sum(F.col(c).cast("decimal(38,9)")) / n_days).cast("long").alias(c)
    sums = demand.groupBy(*keys).agg(part("boardings"), part("alightings"))
    return sums.withColumn("total", F.col("boardings") + F.col("alightings"))


def summed_and_mean(demand: DataFrame, keys: list[str], n_days: int) -> DataFrame:
    """``summed`` with ``mean``, the mean boardings of ``n_days``, in one aggregate."""
    mean = F.round(F.sum(F.col("boardings").cast("decimal(38,9)")) / n_days).cast("long").alias("mean")
    sums = demand.groupBy(*keys).agg(*[F.sum(to_count(F.col(c))).alias(c) for c in ("boardings", "alightings")], mean)
    return sums.withColumn("total", F.col("boardings") + F.col("alightings"))


LEVELS = {"route": ["route"], "stop": ["route", "board_ars"], "pair": ["route", "board_ars", "alight_ars"]}


def left_out_accuracy(legs: DataFrame) -> DataFrame:
    """How well each day is foretold by the mean of the other days of its type (weekday, saturday, sunday): ``wape``, the sum of
    absolute errors over the day's riders, per ``level``, ``day_type`` and ``service_date``. All levels come from one pass
    with grouping sets; cells without riders on a day count with what is foretold for them. Days alone of their type are left out."""
    number = F.weekday("service_date")
    typed = legs.where("service_date is not null").withColumn("day_type", F.when(number == 5, "saturday").when(number == 6, "sunday").otherwise("weekday"))
    cells = [F.col(c) for c in LEVELS["pair"]]
    sets = [["day_type", "service_date", *LEVELS[name]] for name in LEVELS]
    level = F.when(F.grouping("board_ars") == 1, "route").when(F.grouping("alight_ars") == 1, "stop").otherwise("pair")
    days = typed.groupingSets([[F.col(c) for c in s] for s in sets], "day_type", "service_date", *cells).agg(level.alias("level"), F.sum("passengers").alias("p"))
    total = F.sum("p").over(Window.partitionBy("level", "day_type", *cells))
    types = typed.groupBy("day_type").agg(F.count_distinct("service_date").alias("n"), F.sum("passengers").alias("everything")).where("n > 1")
    rows = days.withColumn("foretold_sum", total - F.col("p")).join(types, "day_type")
    error = F.abs(F.col("p") - F.col("foretold_sum") / (F.col("n") - 1)) - F.col("foretold_sum") / (F.col("n") - 1)
    sums = rows.groupBy("level", "day_type", "service_date").agg(F.sum(error).alias("e"), F.sum("p").alias("p"), F.first("everything").alias("everything"), F.first("n").alias("n"))
    absent = (F.col("everything") - F.col("p")) / (F.col("n") - 1)
    return sums.select("level", "day_type", "service_date", ((F.col("e") + absent) / F.col("p")).alias("wape"))


def top_nodes(nodes: DataFrame, n: int) -> DataFrame:
    """The largest nodes; totals must be taken before."""
    return nodes.orderBy(F.desc("total"), "mode", "node").limit(n)


def search_order(name: str):
    """Exact name, exact id, subway first, name, id."""
    return [F.when(F.col("name") == name, 0).when(F.col("node") == name, 1).otherwise(2), F.when(F.col("mode") == "subway", 0).otherwise(1), F.col("name"), F.col("node")]


def found_nodes(text: str, subway: DataFrame, bus: DataFrame, outer: DataFrame, mapping: DataFrame) -> DataFrame:
    """Stations and stops whose name or number holds ``text`` (any case; no wildcards), or whose number it is: ``mode, node, name,
    lat, lng``, one row per station name, stop number, and demand node of stops outside (``mapping``: ``canonical, node``) that
    no inner stop has. In the order exact name, exact number, subway, name, number."""
    has = lambda c: F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower()))
    number = lambda c: F.lpad(F.col(c).cast("string"), 5, "0")
    rows = lambda df, node, mode: df.groupBy(node.alias("node")).agg(F.min("name").alias("name"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng")).withColumn("mode", F.lit(mode))
    stations = rows(subway.where(has("name")), F.col("name"), "subway")
    stops = rows(bus.where((number("ars") == text) | has("ars") | has("name")), number("ars"), "bus")
    known = bus.select(number("ars").alias("node")).distinct()
    beyond = outer.join(mapping.withColumn("node", number("node")), "canonical").where((F.col("node") == text) | has("ars") | has("name"))
    others = rows(beyond.join(known, "node", "left_anti"), F.col("node"), "bus")
    found = stations.unionByName(stops).unionByName(others).select("mode", "node", "name", "lat", "lng")
    return found.orderBy(F.col("name") != text, F.col("node") != text, F.col("mode") != "subway", "name", "node")


def integrated_report(demand: DataFrame, top: int = 20) -> DataFrame:
    """Checks of integrated demand: rows per mode (``section`` rows), boardings and alightings per mode and hour (hours), and each
    mode's ``top`` services at nodes by boardings (top, with ``place``)."""
    none = lambda kind: F.lit(None).cast(kind)
    def part(df, section, hour=None, service=None, node=None, rows=None, boardings=None, alightings=None, place=None):
        given = ((hour, "hour", "int"), (service, "service", "string"), (node, "node", "string"), (rows, "rows", "long"), (boardings, "boardings", "long"), (alightings, "alightings", "long"), (place, "place", "int"))
        return df.select(F.lit(section).alias("section"), "mode", *[(F.col(c).cast(kind) if c else none(kind)).alias(name) for c, name, kind in given])

    both = [F.sum(to_count(F.col(c))).alias(c) for c in ("boardings", "alightings")]
    hours = demand.groupBy("mode", "hour").agg(*both, F.count(F.lit(1)).alias("rows"))
    modes = hours.groupBy("mode").agg(F.sum("rows").alias("rows"))
    nodes = demand.groupBy("mode", "service", "node").agg(both[0])
    best = nodes.withColumn("place", F.row_number().over(Window.partitionBy("mode").orderBy(F.desc("boardings"), "service", "node"))).where(F.col("place") <= top)
    return part(modes, "rows", rows="rows").unionByName(part(hours, "hours", "hour", boardings="boardings", alightings="alightings")).unionByName(part(best, "top", None, "service", "node", boardings="boardings", place="place"))


def one_point(stops: DataFrame) -> DataFrame:
    """One point per stop number: the smallest id."""
    return first_per(stops, ["ars"], [F.col("k").asc()])
