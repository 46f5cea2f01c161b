"""Correction of daily origin-destination rows: virtual stops, sequences, same-stop trips and duplicates.

Rules run in order, each on what the one before it left, for all days at once (the day is part of every key). SQL
comparisons with null count as false. Rows without a day pass through. A day's passengers before equal those after
plus those set aside as anomalies, route by route.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import VIRTUAL, has_virtual_mark, stop_id

COLUMNS = ["service_date", "route", "route_id", "board_seq", "board_ars", "board_code", "board_name", "alight_seq", "alight_ars", "alight_code", "alight_name", "passengers"]
BOARD, ALIGHT = (["{}_seq", "{}_ars", "{}_code", "{}_name"], ["{}_seq", "{}_ars", "{}_code", "{}_name"])
#: A stop that has a virtual name and a number of its own, and the code of stops without a name (fixed values).
EXCEPTION, NAMELESS_CODE = "06137", "0"
#: Share of the route below which a late boarding to a virtual stop is set aside, and its first sequence.
ANOMALY_PERCENT, ANOMALY_SEQ = 48, 11


def true(c: Column) -> Column:
    """A condition whose null is false."""
    return F.coalesce(c, F.lit(False))


def assign(rows: DataFrame, mask: Column, **values: Column) -> DataFrame:
    """Sets columns where ``mask`` holds; all values are those before the change."""
    hit = true(mask)
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def _copied(to: str, frm: str) -> dict[str, Column]:
    return {f"{to}_{x}": F.col(f"{frm}_{x}") for x in ("seq", "ars", "code", "name")}


#: A day of a route. All lookups are windows within it, so that rows move to their day and route once, and every later rule and
#: merge finds them there.
DAY_ROUTE = ["service_date", "route"]


def _in_day_route() -> Column:
    return F.col("service_date").isNotNull() & F.col("route").isNotNull()


def _with_route_end(rows: DataFrame) -> DataFrame:
    """Adds ``__end``, the largest boarding sequence of the day and route; null without a route."""
    return rows.withColumn("__end", F.max("board_seq").over(Window.partitionBy(*DAY_ROUTE))).withColumn("__end", F.when(_in_day_route(), F.col("__end")))


def _first_order(*columns: str) -> list[Column]:
    """Fields that order structs by the columns, nulls last."""
    return [x for c in columns for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c).alias(c))]


def virtual_stops(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rules for virtual stops: corrected rows, and rows set aside."""
    c = F.col
    d = assign(rows, has_virtual_mark(c("board_name")) & ~true(c("board_ars") == EXCEPTION), board_ars=F.lit(VIRTUAL))
    d = assign(d, has_virtual_mark(c("alight_name")) & ~true(c("alight_ars") == EXCEPTION), alight_ars=F.lit(VIRTUAL))
    d = assign(d, (c("board_ars") == VIRTUAL) & c("board_seq").isNull(), board_seq=F.lit(0))
    to_virtual = (c("alight_ars") == VIRTUAL) & c("alight_seq").isNull()
    d = assign(d, (c("board_seq") == 0) & (c("board_ars") == VIRTUAL) & to_virtual, alight_seq=F.lit(0))
    d = assign(d, to_virtual & c("board_seq").between(1, 10), **_copied("alight", "board"))
    d = _with_route_end(d)
    odd = true(to_virtual & (c("__end") != 0) & (c("board_seq") / c("__end") * 100 < ANOMALY_PERCENT) & (c("board_seq") >= ANOMALY_SEQ))
    # rows set aside board before the route's end, so the end stays
    aside, d = d.where(odd).drop("__end"), d.where(~odd)
    d = assign(d, to_virtual & c("__end").isNotNull(), alight_seq=c("__end") + 1).drop("__end")
    d = assign(d, (c("alight_name").isNull() | (c("alight_name") == "")) & (c("alight_code") == NAMELESS_CODE), alight_name=c("board_name"))
    d = assign(d, (c("board_ars") != VIRTUAL) & (c("alight_ars") == VIRTUAL) & c("alight_seq").isNotNull(), **_copied("alight", "board"))
    d = assign(d, (c("board_ars") == VIRTUAL) & (c("board_seq") != 0), **_copied("board", "alight"))
    d = assign(d, (c("board_ars") == VIRTUAL) & (c("alight_ars") == VIRTUAL) & (c("board_seq") == c("alight_seq")), alight_seq=c("board_seq") + 1)
    return d, aside


def modal_sequence(rows: DataFrame) -> DataFrame:
    """The most frequent boarding sequence of each stop of a route and day; ties to the smallest, nulls last."""
    real = rows.where(true(F.col("board_ars") != VIRTUAL) & F.col("route").isNotNull())
    counts = real.groupBy("service_date", "route", "board_ars", "board_seq").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct((-F.col("n")).alias("n"), *_first_order("board_seq"))).alias("first")
    return counts.groupBy("service_date", "route", "board_ars").agg(first).select("service_date", "route", "board_ars", F.col("first.board_seq").alias("modal_seq"))


def sequences(rows: DataFrame) -> DataFrame:
    """Boarding sequences become modal; alighting sequences that vary by at most 2 become the smallest."""
    c = F.col
    counted = rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*DAY_ROUTE, "board_ars", "board_seq")))
    first = F.min(F.struct((-c("__n")).alias("n"), *_first_order("board_seq"))).over(Window.partitionBy(*DAY_ROUTE, "board_ars"))
    d = counted.withColumn("__first", first)
    d = assign(d, _in_day_route() & (c("board_ars") != VIRTUAL) & (c("board_seq") != c("__first.board_seq")), board_seq=c("__first.board_seq")).select(*rows.columns)
    trip = Window.partitionBy(*DAY_ROUTE, "board_seq", "board_ars", "alight_ars")
    d = d.withColumns({"__low": F.min("alight_seq").over(trip), "__high": F.max("alight_seq").over(trip)})
    real = _in_day_route() & c("board_seq").isNotNull() & (c("board_ars") != VIRTUAL) & (c("alight_ars") != VIRTUAL)
    return assign(d, real & (c("__high") - c("__low") <= 2) & (c("alight_seq") != c("__low")), alight_seq=c("__low")).select(*rows.columns)


def next_stops(rows: DataFrame) -> DataFrame:
    """The stop at each boarding position of a route and day; ties by number, code, name."""
    known = rows.where("route is not null and board_seq is not null")
    first = F.min(F.struct(*_first_order("board_ars", "board_code", "board_name"))).alias("first")
    return known.groupBy("service_date", "route", "board_seq").agg(first).select("service_date", "route", "board_seq", "first.board_ars", "first.board_code", "first.board_name")


def same_stops(rows: DataFrame) -> DataFrame:
    """Trips that end where they began end at the next stop instead (the one ``next_stops`` has for the position after)."""
    c = F.col
    d = assign(rows, (c("board_seq") == c("alight_seq")) & (c("board_ars") == c("alight_ars")) & (c("board_ars") != VIRTUAL), alight_seq=c("board_seq") + 1)
    after = Window.partitionBy(*DAY_ROUTE).orderBy(c("board_seq").cast("long")).rangeBetween(1, 1)
    d = d.withColumn("__next", F.min(F.struct(*_first_order("board_ars", "board_code", "board_name"))).over(after))
    moved = {f"alight_{x}": c(f"__next.board_{x}") for x in ("ars", "code", "name")}
    hit = _in_day_route() & c("board_seq").isNotNull() & c("__next").isNotNull()
    return assign(d, hit & (c("board_ars") == c("alight_ars")), alight_seq=c("board_seq") + 1, **moved).select(*rows.columns)


def deduplicate(rows: DataFrame) -> DataFrame:
    """Merges rows of one trip key (nulls equal, stops by number or else name), summing passengers. Names and codes are
    those of the row with the most passengers; ties by value, nulls last."""
    keys = ["service_date", "route", "route_id", "board_seq", "__b", "alight_seq", "__a"]
    named = rows.withColumns({"__b": stop_id(F.col("board_ars"), F.col("board_name")), "__a": stop_id(F.col("alight_ars"), F.col("alight_name"))})
    rest = ["board_code", "board_name", "alight_code", "alight_name", "board_ars", "alight_ars"]
    most = [F.col("passengers").isNull().alias("no_p"), (-F.col("passengers")).alias("p")]
    merged = named.groupBy(*keys).agg(F.min(F.struct(*most, *_first_order(*rest))).alias("__first"), F.sum("passengers").cast("int").alias("passengers"))
    return merged.select(*[F.col(f"__first.{c}").alias(c) if c in rest else F.col(c) for c in rows.columns])


def deduplicate_as_before(rows: DataFrame) -> DataFrame:
    """The older merge, for comparisons with tables made by it. Its defects are kept: merged rows lose the boarding code;
    rows go by a key without names, so that rows that weren't merged go too; rows with a null in that key stay beside
    their sum."""
    group = ["service_date", "route", "route_id", "board_seq", "board_ars", "board_name", "alight_seq", "alight_ars", "alight_code", "alight_name"]
    gone = ["service_date", "route", "route_id", "board_seq", "board_ars", "alight_seq", "alight_ars"]
    sums = rows.groupBy(*group).agg(F.sum("passengers").cast("int").alias("passengers"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    merged = sums.withColumn("board_code", F.lit(None).cast("string")).select(*rows.columns)
    return rows.join(merged.select(*gone).distinct(), gone, "left_anti").select(*rows.columns).unionByName(merged)


def day_reports(docs: DataFrame, text: str = "doc") -> DataFrame:
    """One row per day from the JSON reports of its correction."""
    schema = """day string, seconds double, structural struct<passengers: struct<input: long, anomaly: long>, passenger_diff: long>,
        ferry struct<ferry_passengers: long, by_date: array<struct<passengers_at_closed_piers: long>>>,
        codes struct<null_route_id: long, null_boarding_code: long>"""
    r = F.from_json(text, schema)
    closed = F.aggregate(r["ferry"]["by_date"], F.lit(0).cast("long"), lambda s, d: s + d["passengers_at_closed_piers"])
    return docs.select(
        r["day"].alias("day"), F.date_format(F.try_to_date(r["day"], "yyyyMMdd"), "EEE").alias("dow"), r["structural"]["passengers"]["input"].alias("passengers"),
        r["structural"]["passenger_diff"].alias("diff"), r["structural"]["passengers"]["anomaly"].alias("anomaly"), r["ferry"]["ferry_passengers"].alias("ferry"),
        closed.alias("ferry_at_closed"), r["codes"]["null_route_id"].alias("null_route_id"), r["codes"]["null_boarding_code"].alias("null_boarding_code"), r["seconds"].alias("seconds"),
    )


def correct(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole correction: corrected rows and rows set aside. Lookups and merges are all within a day and route, so that rows are
    shuffled once for all steps."""
    undated = rows.where("service_date is null")
    d, aside = virtual_stops(rows.where("service_date is not null"))
    for step in (sequences, same_stops):
        d = step(deduplicate(d))
    return deduplicate(d).unionByName(undated), aside


def balance(before: DataFrame, after: DataFrame, aside: DataFrame) -> DataFrame:
    """Passengers per day and route: ``before``, ``after``, ``aside`` and what is lacking."""
    part = lambda x, name: x.select("service_date", "route", F.col("passengers").cast("long").alias("p"), F.lit(name).alias("part"))
    rows = part(before, "before").unionByName(part(after, "after")).unionByName(part(aside, "aside"))
    sums = rows.groupBy("service_date", "route").agg(*[F.coalesce(F.sum(F.when(F.col("part") == n, F.col("p"))), F.lit(0)).alias(n) for n in ("before", "after", "aside")])
    return sums.withColumn("lacking", F.col("before") - F.col("after") - F.col("aside"))


def assert_conserved(before: DataFrame, after: DataFrame, aside: DataFrame) -> None:
    """Raises where passengers of a day and route are lost or made up."""
    off = balance(before, after, aside).where("lacking != 0").limit(5).collect()
    if off:
        raise ValueError(f"passengers are not conserved: {off}")


def normalise(raw: DataFrame) -> DataFrame:
    """Raw text columns in the layout and types of COLUMNS."""
    from ..functions.calendars import parse_day
    from ..functions.identifiers import ars_id, clean_text, route_label

    c = F.col
    return raw.select(
        parse_day(c("service_date")).alias("service_date"), route_label(clean_text(c("route"))).alias("route"), clean_text(c("route_id")).alias("route_id"),
        *[x for side in ("board", "alight") for x in (
            c(f"{side}_seq").try_cast("int").alias(f"{side}_seq"), ars_id(c(f"{side}_ars")).alias(f"{side}_ars"),
            clean_text(c(f"{side}_code")).alias(f"{side}_code"), clean_text(c(f"{side}_name")).alias(f"{side}_name"))],
        F.coalesce(c("passengers").try_cast("int"), F.lit(0)).alias("passengers"),
    )
