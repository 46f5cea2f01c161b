"""Queries of areas, paths, terrain snapshots, request checks and of what remains of filters and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calendars as cal
from ..functions import geo
from ..functions import identifiers as ids
from ..functions import parameters as par
from ..operators import districts, hourly, lookups, od_cleaning, paths, ranks, spatial, terrain, topology
from ..sources.files import api_hour_column, csv_hour_column, hour_columns, wide_to_long, work_folder
from .scalars import _ring
from .views import query

C = F.col


# ---------------------------------------------------------------- cleaning, lookups, windows

@query("prj_case_virtual", """SELECT k, CASE WHEN v THEN alight_seq ELSE board_seq END AS board_seq, CASE WHEN v THEN board_seq ELSE alight_seq END AS alight_seq, count(*) AS n
    FROM (SELECT route AS k, board_seq, alight_seq, coalesce(board_name LIKE '%가상%', false) AS v FROM raw_od) GROUP BY ALL""")
def _(v):
    swapped = od_cleaning.assign(v("raw_od"), ids.has_virtual_mark(C("board_name")), board_seq=C("alight_seq"), alight_seq=C("board_seq"))
    return swapped.groupBy(C("route").alias("k"), "board_seq", "alight_seq").agg(F.count(F.lit(1)).alias("n"))


@query("join_sql_lookup", "SELECT r.route, count(*) AS n, CAST(count(s.ars) AS BIGINT) AS hits, max(s.name) AS name, max(s.k) AS k FROM raw_od r LEFT JOIN stop_point s ON r.board_ars = s.ars GROUP BY r.route")
def _(v):
    found = lookups.values_of(v("raw_od"), {"board_ars": "ars"}, v("stop_point"), ["name", "k"])
    return found.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"), F.max("name").alias("name"), F.max("k").alias("k"))


_GROUP = "service_date, route, route_id, board_seq, board_ars, board_name, alight_seq, alight_ars, alight_code, alight_name"
_SAME = " AND ".join(f"g.{c} = r.{c}" for c in ("service_date", "route", "route_id", "board_seq", "board_ars", "alight_seq", "alight_ars"))


@query("agg_dedup_faithful", f"""SELECT route, count(*) AS n, CAST(sum(passengers) AS BIGINT) AS passengers, CAST(count(board_code) AS BIGINT) AS codes FROM (
    SELECT {_GROUP}, board_code, passengers FROM crowded r WHERE NOT EXISTS (SELECT 1 FROM merged g WHERE {_SAME}) UNION ALL SELECT {_GROUP}, NULL, passengers FROM merged) GROUP BY route"""
    .replace("FROM crowded", "FROM (SELECT * FROM raw_od UNION ALL SELECT * FROM raw_od WHERE board_seq % 5 = 1)")
    .replace("FROM merged", f"FROM (SELECT {_GROUP}, sum(passengers) AS passengers FROM (SELECT * FROM raw_od UNION ALL SELECT * FROM raw_od WHERE board_seq % 5 = 1) GROUP BY {_GROUP} HAVING count(*) > 1)"))
def _(v):
    crowded = v("raw_od").unionByName(v("raw_od").where("board_seq % 5 = 1"))
    return od_cleaning.deduplicate_as_before(crowded).groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.sum("passengers").alias("passengers"), F.count("board_code").alias("codes"))


@query("agg_report_summary", """SELECT strftime(service_date, '%Y%m%d') AS day, strftime(service_date, '%a') AS dow, CAST(sum(passengers) AS BIGINT) AS passengers, CAST(0 AS BIGINT) AS diff, CAST(count(*) FILTER (WHERE board_ars = '00000') AS BIGINT) AS anomaly,
    count(*) AS ferry, CAST(3 * count(*) AS BIGINT) AS ferry_at_closed, CAST(count(*) FILTER (WHERE route_id IS NULL) AS BIGINT) AS null_route_id, CAST(count(*) FILTER (WHERE board_code IS NULL) AS BIGINT) AS null_boarding_code, 1.5e0 AS seconds
    FROM raw_od WHERE service_date IS NOT NULL GROUP BY service_date""")
def _(v):
    n = F.count(F.lit(1))
    sums = v("raw_od").where("service_date is not null").groupBy("service_date").agg(
        n.alias("n"), F.sum("passengers").alias("p"), F.count_if(C("board_ars") == "00000").alias("odd"), F.count_if(C("route_id").isNull()).alias("ids"), F.count_if(C("board_code").isNull()).alias("codes")
    )
    closed = lambda x: F.struct(x.alias("passengers_at_closed_piers"))
    doc = F.struct(
        F.date_format("service_date", "yyyyMMdd").alias("day"), F.lit(1.5).alias("seconds"),
        F.struct(F.struct(C("p").alias("input"), C("odd").alias("anomaly")).alias("passengers"), F.lit(0).alias("passenger_diff")).alias("structural"),
        F.struct(C("n").alias("ferry_passengers"), F.array(closed(C("n")), closed(C("n") * 2)).alias("by_date")).alias("ferry"),
        F.struct(C("ids").alias("null_route_id"), C("codes").alias("null_boarding_code")).alias("codes"),
    )
    return od_cleaning.day_reports(sums.select(F.to_json(doc).alias("doc")))


@query("win_mode_rank", "SELECT route, board_ars, board_seq, count(*) AS n, row_number() OVER (PARTITION BY route, board_ars ORDER BY count(*) DESC, board_seq NULLS LAST) AS rank FROM raw_od WHERE board_ars <> '00000' GROUP BY route, board_ars, board_seq")
def _(v):
    counts = v("raw_od").where("board_ars != '00000'").groupBy("route", "board_ars", "board_seq").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("route", "board_ars").orderBy(F.desc("n"), C("board_seq").asc_nulls_last())
    return counts.withColumn("rank", F.row_number().over(order).cast("long"))


@query("src_jpa_page", "SELECT okey, route, board_seq, alight_seq, passengers FROM leg WHERE route = 'R03' ORDER BY service_date, okey, board_seq, alight_seq, passengers LIMIT 1000")
def _(v):
    rows = v("leg").sparkSession.range(1).select(par.page_rows(F.lit(5000))).first()[0]
    page = v("leg").where("route = 'R03'").orderBy("service_date", "okey", "board_seq", "alight_seq", "passengers").limit(rows)
    return page.select("okey", "route", "board_seq", "alight_seq", "passengers")


@query("sort_client", "SELECT k, t, row_number() OVER (ORDER BY CAST(substr(t, 2) AS INT), k) AS place FROM messy WHERE regexp_matches(t, '^N[0-9]+$')")
def _(v):
    named = v("messy").where(C("t").rlike("^N[0-9]+$")).select("k", "t")
    return ranks.placed(named, [ids.natural_key(C("t")).asc(), C("k").asc()]).withColumn("place", C("place") + 1)


# ---------------------------------------------------------------- scalars

_YM = "(SELECT DISTINCT use_ym AS a, CAST(199512 + 100 * (use_ym % 7) AS INT) AS b FROM boarding_month)"
_IX = "({0} // 100 * 12 + {0} % 100 - 1)"
_BACK = "CAST(({0}) // 12 * 100 + ({0}) % 12 + 1 AS INT)"


def _clamped(changed: str) -> str:
    low, high, a, b = "greatest(a, 199601)", "least(b, 200012)", _IX.format("x"), _IX.format("y")
    if changed == "from":
        pair = f"SELECT a, b, {low} AS x, greatest({high}, {low}) AS y FROM {_YM}"
        return f"SELECT a, b, x AS first, CASE WHEN {b} - {a} + 1 > 12 THEN {_BACK.format(a + ' + 11')} ELSE y END AS last FROM ({pair})"
    pair = f"SELECT a, b, least({low}, {high}) AS x, {high} AS y FROM {_YM}"
    return f"SELECT a, b, CASE WHEN {b} - {a} + 1 > 12 THEN {_BACK.format(b + ' - 11')} ELSE x END AS first, y AS last FROM ({pair})"


@query("sc_month_math", f"SELECT 'from' AS changed, * FROM ({_clamped('from')}) UNION ALL SELECT 'to', * FROM ({_clamped('to')})")
def _(v):
    months = v("boarding_month").select(C("use_ym").alias("a"), (199512 + 100 * (C("use_ym") % 7)).cast("int").alias("b")).distinct()
    one = lambda how: months.select(F.lit(how).alias("changed"), "a", "b", cal.clamped_period(C("a"), C("b"), F.lit(199601), F.lit(200012), how).alias("p"))
    return one("from").unionByName(one("to")).select("changed", "a", "b", "p.first", "p.last")


_DAYS = "CASE CAST(k % 6 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'sat' WHEN 3 THEN 'sat,sat' WHEN 4 THEN 'sun_holiday' ELSE 'sat,sun_holiday' END"


@query("sc_dong_day_type", f"SELECT k, CASE WHEN regexp_matches(d, '^sat(,sat)*$') THEN 'saturday' WHEN regexp_matches(d, '^sun_holiday(,sun_holiday)*$') THEN 'sunday_holiday' ELSE 'weekday' END AS out FROM (SELECT k, {_DAYS} AS d FROM messy)")
def _(v):
    return v("messy").select("k", cal.district_day_type(F.split(F.expr(_DAYS), ",")).alias("out"))


@query("sc_hour_column", "SELECT ars, CAST(hour AS INT) AS hour, CAST(sum(b) AS DOUBLE) AS riders FROM (SELECT ars, h AS hour, CASE WHEN h = m.hour THEN boardings ELSE 0 END AS b FROM boarding_month m, (SELECT unnest([0, 9, 23]) AS h)) GROUP BY ars, hour")
def _(v):
    """Two wide tables whose hours have the names of the two forms, as one long table."""
    sums = lambda name: [F.sum(F.when(C("hour") == h, C("boardings")).otherwise(0.0)).alias(name(h)) for h in (0, 9, 23)]
    rows = v("boarding_month")
    parts = []
    for name, half in ((api_hour_column, C("ars") < "00010"), (csv_hour_column, C("ars") >= "00010")):
        wide = rows.where(half).groupBy("ars").agg(*sums(name))
        parts.append(wide_to_long(wide, ["ars"], hour_columns(wide.columns)))
    return parts[0].unionByName(parts[1])


@query("sc_json_docs", """SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, '{"event_type":"' || event_type || '","k":' || CAST(CAST(json_extract(props, '$.k') AS INT) AS STRING) || '}' AS doc FROM events""")
def _(v):
    parsed = v("events").select("event_id", "event_type", F.from_json("props", "k int")["k"].alias("k"))
    return parsed.select("event_id", "k", F.to_json(F.struct("event_type", "k")).alias("doc"))


_P = "CASE CAST(k % 8 AS INT) WHEN 0 THEN '' WHEN 1 THEN '2024-01' WHEN 2 THEN ' 2024-01..2024-12 ' WHEN 3 THEN '2024-01..2025-01' WHEN 4 THEN '2024-05..2024-04' WHEN 5 THEN '2024-13' WHEN 6 THEN '2024-01..2024-02..2024-03' ELSE NULL END"
_H = "CASE CAST(k % 9 AS INT) WHEN 0 THEN '' WHEN 1 THEN '7-9' WHEN 2 THEN '8' WHEN 3 THEN '24' WHEN 4 THEN '9-7' WHEN 5 THEN 'x' WHEN 6 THEN ' 0 - 23 ' WHEN 7 THEN '1-2-3' ELSE NULL END"
_L = "CASE CAST(k % 7 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'saturday' WHEN 2 THEN 'typical_sunday_holiday' WHEN 3 THEN '20240101' WHEN 4 THEN ' weekday ' WHEN 5 THEN 'typical_' ELSE '' END"


@query("val_period_hours", """SELECT k, CASE CAST(k % 8 AS INT) WHEN 3 THEN 'no more than 12 months at once' WHEN 4 THEN 'the first month comes after the last' WHEN 5 THEN 'period must be YYYY-MM or YYYY-MM..YYYY-MM' WHEN 6 THEN 'period must be YYYY-MM or YYYY-MM..YYYY-MM' END AS period,
    CASE CAST(k % 9 AS INT) WHEN 3 THEN 'hours must be 0 to 23' WHEN 4 THEN 'hours must run forward' WHEN 5 THEN 'hours must be H or H-H' WHEN 7 THEN 'hours must be H or H-H' END AS hours FROM messy""")
def _(v):
    return v("messy").select("k", par.period_error(F.expr(_P)).alias("period"), par.hours_error(F.expr(_H)).alias("hours"))


@query("val_typical_label", "SELECT k, CASE CAST(k % 7 AS INT) WHEN 1 THEN 'typical_saturday' WHEN 2 THEN 'typical_sunday_holiday' WHEN 3 THEN NULL WHEN 5 THEN NULL ELSE 'typical_weekday' END AS label FROM messy")
def _(v):
    return v("messy").select("k", par.typical_label(F.expr(_L)).alias("label"))


@query("val_params", """SELECT k, CASE WHEN k % 3 = 2 THEN 'mode must be bus or subway' WHEN coalesce(NOT regexp_matches(t, '^[0-9]{8,10}$'), true) THEN 'district must have 8 to 10 digits' WHEN k % 5 > 2 THEN 'radius must be one of 400, 800, 1000'
    WHEN k % 11000 NOT BETWEEN 1 AND 10000 THEN 'limit must be 1 to 10000' WHEN k % 4 = 0 THEN 'coordinate is outside the area of service' END AS error FROM (SELECT k, CASE WHEN k % 2 = 0 THEN '11010530' ELSE t END AS t FROM messy)""")
def _(v):
    rows = v("messy").withColumn("t", F.when(C("k") % 2 == 0, "11010530").otherwise(C("t")))
    mode = F.element_at(F.array(F.lit("bus"), F.lit("subway"), F.lit("rail")), (C("k") % 3 + 1).cast("int"))
    radius = F.element_at(F.array(*map(F.lit, (400, 800, 1000, 1, 0))), (C("k") % 5 + 1).cast("int"))
    spot = par.coordinate_error(F.when(C("k") % 4 == 0, 12.0).otherwise(37.5), F.lit(127.0))
    return rows.select("k", par.first_error(par.mode_error(mode), par.district_error(C("t")), par.radius_error(radius), par.node_limit_error(C("k") % 11000), spot).alias("error"))


# ---------------------------------------------------------------- areas

@query("sp_union_dissolve", "SELECT left(dong, 4) AS unit, count(DISTINCT ars) AS stops FROM stop_point JOIN district ON lng BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1 GROUP BY 1")
def _(v):
    areas = spatial.dissolved(v("district").withColumn("unit", F.left("dong", F.lit(4))), "unit")
    return spatial.covered_by_parts(v("stop_point").select("ars", "lng", "lat"), areas, 0.02).groupBy("unit").agg(F.count(F.lit(1)).alias("stops"))


@query("sp_point_on_surface", "SELECT dong, round((x0 + x1) / 2, 9) AS lng, round((y0 + y1) / 2, 9) AS lat FROM district")
def _(v):
    at = v("district").select("dong", geo.point_on_surface(_ring(v)).alias("p"))
    return at.select("dong", F.round("p.lng", 9).alias("lng"), F.round("p.lat", 9).alias("lat"))


@query("qry_boundaries", """SELECT dong, '{"type":"Polygon","coordinates":[[' || concat_ws(',', c(x0, y0), c(x1, y0), c(x1, y1), c(x0, y1), c(x0, y0)) || ']]}' AS shape FROM district"""
    .replace("c(x0, y0)", "printf('[%.6f,%.6f]', x0, y0)").replace("c(x1, y0)", "printf('[%.6f,%.6f]', x1, y0)").replace("c(x1, y1)", "printf('[%.6f,%.6f]', x1, y1)").replace("c(x0, y1)", "printf('[%.6f,%.6f]', x0, y1)"))
def _(v):
    """Rings with points on their sides, which simplification takes away."""
    half = F.struct(((C("x0") + C("x1")) / 2).alias("lng"), C("y0").cast("double").alias("lat"))
    ring = F.transform(_ring(v), lambda p: F.struct(p["lng"].cast("double").alias("lng"), p["lat"].cast("double").alias("lat")))
    more = F.concat(F.slice(ring, 1, 1), F.array(half), F.slice(ring, 2, 4))
    return v("district").select("dong", geo.geojson_polygon(F.array(geo.simplified(more, 5e-5))).alias("shape"))


@query("sp_simplify", """SELECT dong, CAST(5 AS INT) AS points, round(1.0 * (x1 - x0) * (y1 - y0), 9) AS area FROM district""")
def _(v):
    """Areas of a grid whose sides bend by less than the tolerance, the same way for both neighbours; corners are all that stays."""
    x0, y0, x1, y1 = (C(c).cast("double") for c in ("x0", "y0", "x1", "y1"))
    at = lambda a, b, k: a + (b - a) * (k / 4.0)
    sway = lambda along, k: F.round(F.sin(along * 1000 + k) * 2e-5, 9)
    spot = lambda x, y: F.struct(F.round(x, 9).alias("lng"), F.round(y, 9).alias("lat"))
    across = lambda y, k: spot(at(x0, x1, k), y + (sway(x0, k) if k % 4 else 0))
    upward = lambda x, k: spot(x + (sway(y0, k) if k % 4 else 0), at(y0, y1, k))
    ring = [across(y0, k) for k in range(4)] + [upward(x1, k) for k in range(4)] + [across(y1, k) for k in (4, 3, 2, 1)] + [upward(x0, k) for k in (4, 3, 2, 1)]
    areas = v("district").select("dong", F.array(*ring).alias("ring"))
    done = topology.simplified(areas, 5e-5, "dong", "ring")
    turn = F.zip_with(F.slice("ring", F.lit(1), F.size("ring") - 1), F.slice("ring", F.lit(2), F.size("ring") - 1), lambda p, q: p["lng"] * q["lat"] - q["lng"] * p["lat"])
    return done.select("dong", F.size("ring").alias("points"), F.round(F.abs(F.aggregate(turn, F.lit(0.0), lambda s, x: s + x)) / 2, 9).alias("area"))


_AREA = ["11012500", "11013500", "11022500"]
_IN = "(" + ", ".join(f"'{d}'" for d in _AREA) + ")"
_COVER = "stop_point s JOIN district d ON s.lng BETWEEN x0 AND x1 AND s.lat BETWEEN y0 AND y1"
_PLACED = f"(SELECT ars, min(dong) AS dong FROM {_COVER} GROUP BY ars)"
_STOPS = f"(SELECT DISTINCT ars FROM {_COVER} WHERE dong IN {_IN})"
_SPOT = "(SELECT dong, (x0 + x1) / 2 AS lng, (y0 + y1) / 2 AS lat FROM district)"
_KM = "2 * 6370986e0 * asin(least(1e0, sqrt(pow(sin(radians(t.lat - b.lat) / 2), 2) + cos(radians(b.lat)) * cos(radians(t.lat)) * pow(sin(radians(t.lng - b.lng) / 2), 2)))) / 1000"
_PERIOD = "service_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"


def _area(v):
    boxes, stops = v("district"), v("stop_point").select("ars", "lng", "lat")
    inside = spatial.covering(stops, boxes.where(C("dong").isin(*_AREA)), 0.02).select("ars").distinct()
    return inside, spatial.primary_area(stops, boxes, 0.02, "ars", "dong")


@query("qry_period_bus_outside", f"""SELECT dong, km, sum(passengers) AS passengers FROM (SELECT p.dong, round({_KM}, 6) AS km, l.passengers FROM leg l JOIN {_STOPS} i ON l.board_ars = i.ars LEFT JOIN {_STOPS} o ON l.alight_ars = o.ars LEFT JOIN {_PLACED} p ON l.alight_ars = p.ars
    LEFT JOIN {_SPOT} t ON t.dong = p.dong LEFT JOIN {_PLACED} h ON h.ars = l.board_ars LEFT JOIN (SELECT d.dong, CASE WHEN d.dong IN {_IN} THEN d.lng ELSE m.lng END AS lng, CASE WHEN d.dong IN {_IN} THEN d.lat ELSE m.lat END AS lat FROM {_SPOT} d, (SELECT avg(lng) AS lng, avg(lat) AS lat FROM {_SPOT} WHERE dong IN {_IN}) m) b ON b.dong = h.dong
    WHERE o.ars IS NULL AND {_PERIOD} AND coalesce(p.dong NOT LIKE '1100%', true)) GROUP BY dong, km""")
def _(v):
    inside, placed = _area(v)
    points = v("district").select("dong", ((C("x0") + C("x1")) / 2).alias("lng"), ((C("y0") + C("y1")) / 2).alias("lat"), C("dong").isin(*_AREA).alias("in_area"))
    centre = points.where("in_area").agg(F.avg("lng").alias("lng"), F.avg("lat").alias("lat"))
    legs = v("leg").where("service_date between '1996-01-01' and '1996-12-31'")
    out = districts.outside_ends(legs, inside, placed, points, centre, "1100")
    return out.groupBy("dong", F.round("km", 6).alias("km")).agg(F.sum("passengers").alias("passengers"))


_HOURLY = "(SELECT route, board_ars, CAST(okey % 24 AS INT) AS hour, sum(passengers) AS b FROM leg WHERE route <> 'R03' GROUP BY 1, 2, 3)"
_SHARE = f"(SELECT route, board_ars, sum(b) FILTER (WHERE hour BETWEEN 7 AND 9) / sum(b) AS share FROM {_HOURLY} GROUP BY route, board_ars)"
_DEFAULT = sum(hourly.default_profile()[7:10])
_RIDES = f"""(SELECT l.route, p.dong, sum(l.passengers * CASE WHEN q.route IS NULL THEN {_DEFAULT!r} ELSE coalesce(q.share, 0e0) END) AS riders FROM leg l JOIN {_STOPS} i ON l.board_ars = i.ars LEFT JOIN {_PLACED} p ON l.alight_ars = p.ars
    LEFT JOIN {_SHARE} q ON q.route = l.route AND q.board_ars = l.board_ars WHERE {_PERIOD} GROUP BY l.route, p.dong)"""


@query("qry_dong_routes_split", f"""SELECT route, round(max(boardings), 6) AS boardings, round(max(unplaced), 6) AS unplaced, round(sum(riders), 6) AS listed, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, sum(riders) OVER (PARTITION BY route) AS boardings, coalesce(sum(riders) FILTER (WHERE dong IS NULL) OVER (PARTITION BY route), 0e0) AS unplaced,
    row_number() OVER (PARTITION BY route ORDER BY dong IS NULL, round(riders, 6) DESC, dong) AS rank FROM {_RIDES}) WHERE dong IS NOT NULL AND rank <= 5 GROUP BY route""")
def _(v):
    """Riders boarding from 7 to 10 in a period, by the profile of route and stop, or else the default one."""
    inside, placed = _area(v)
    legs = v("leg")
    sums = legs.where("route != 'R03'").groupBy("route", C("board_ars").alias("ars"), (C("okey") % 24).cast("int").alias("hour")).agg(F.sum("passengers").alias("b"))
    keys = sums.select("route", "ars").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    profiles = hourly.ratios(keys.join(sums, ["route", "ars", "hour"], "left").fillna(0.0, ["b"]), ["route", "ars"], "b")
    trips = legs.where("service_date between '1996-01-01' and '1996-12-31'").select("route", C("board_ars").alias("ars"), "alight_ars", "passengers")
    pairs = trips.join(inside, "ars", "left_semi").groupBy("route", "ars", "alight_ars").agg(F.sum("passengers").alias("passengers"))
    riders = hourly.spread(pairs, profiles).where("hour between 7 and 9").select("route", C("ars").alias("board_ars"), "alight_ars", C("hourly").alias("passengers"))
    top = districts.routes_of_area(riders, inside, placed)
    return top.groupBy("route").agg(F.round(F.max("boardings"), 6).alias("boardings"), F.round(F.max("unplaced"), 6).alias("unplaced"), F.round(F.sum("riders"), 6).alias("listed"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- paths and terrain

@query("dom_station_path_match")
def _(v):
    """Routes that run out and back over the same vertices."""
    at = v("route_stop").join(v("stop_point").select("ars", "lng", "lat"), "ars").select("route", "seq", C("lng").cast("double").alias("lng"), C("lat").cast("double").alias("lat"))
    out = at.select("route", (C("seq") * 2).alias("vertex"), (C("lng") + 0.0001).alias("lng"), "lat")
    back = at.select("route", (1000 - C("seq") * 2).alias("vertex"), "lng", (C("lat") + 0.0002).alias("lat"))
    return paths.match_stations(at, out.unionByName(back)).select("route", "seq", "vertex", F.round("metres", 6).alias("metres"))


@query("dom_place_stops_nearest")
def _(v):
    """Stops of which every third has lost its number, by the points of their numbers and names."""
    stops = v("route_stop").withColumns({"name": F.concat(F.lit("stop "), (C("ars").cast("int") % 90).cast("string")), "ars": F.when(C("seq") % 3 != 0, ids.strip_zeros(C("ars")))})
    points = v("stop_point").select("k", "ars", "name", C("lng").cast("double").alias("lng"), C("lat").cast("double").alias("lat"))
    return paths.place_stops(stops, points)


_RAW = """(SELECT CAST(k AS STRING) AS node_id, lng, lat, CASE WHEN k % 17 = 0 THEN NULL ELSE CAST(k % 40 AS DOUBLE) / 4 END AS slope FROM stop_point)"""


def _raw_terrain(v):
    slope = F.when(C("k") % 17 == 0, "-9999").when(C("k") % 34 == 1, None).otherwise((C("k") % 40 / 4).cast("string"))
    return v("stop_point").select(
        C("k").cast("string").alias("node_id"), "name", C("ars").alias("stop_no"), C("name").alias("stop_name"), C("lng").cast("string").alias("longitude"), C("lat").cast("string").alias("latitude"),
        F.lit("12.5").alias("elev_m"), slope.alias("slope_pct"))


def _in(side: str) -> str:
    return f"SELECT s.node_id, min(dong) AS dong, count(*) AS n FROM {_RAW} s JOIN district d ON {side} GROUP BY s.node_id"


@query("dom_terrain_publish", f"""SELECT s.node_id, coalesce(i.dong, b.dong) AS dong, CASE WHEN i.dong IS NOT NULL THEN 'interior' WHEN b.dong IS NOT NULL THEN 'boundary' ELSE 'unmatched' END AS method, CAST(coalesce(b.n, 0) AS INT) AS candidates FROM {_RAW} s
    LEFT JOIN ({_in('s.lng > x0 AND s.lng < x1 AND s.lat > y0 AND s.lat < y1')}) i ON i.node_id = s.node_id LEFT JOIN ({_in('s.lng BETWEEN x0 AND x1 AND s.lat BETWEEN y0 AND y1')}) b ON b.node_id = s.node_id""")
def _(v):
    root = work_folder(v("district").sparkSession, "terrain")
    terrain.publish(root, "first", terrain.checked_stops(_raw_terrain(v)), v("district"), 0.02)
    return terrain.active(v("district").sparkSession, root)[1]


_PUBLISHED = f"""(SELECT s.node_id, coalesce(i.dong, b.dong) AS dong, CASE WHEN CAST(s.node_id AS INT) % 34 <> 1 THEN s.slope END AS slope FROM {_RAW} s
    LEFT JOIN ({_in('s.lng > x0 AND s.lng < x1 AND s.lat > y0 AND s.lat < y1')}) i ON i.node_id = s.node_id LEFT JOIN ({_in('s.lng BETWEEN x0 AND x1 AND s.lat BETWEEN y0 AND y1')}) b ON b.node_id = s.node_id)"""


@query("dom_terrain_steep", f"SELECT node_id, dong, slope AS slope_pct, 'first' AS dataset, (SELECT count(*) FROM {_PUBLISHED}) AS stops, (SELECT CAST(count(slope) AS BIGINT) FROM {_PUBLISHED}) AS measured FROM {_PUBLISHED} WHERE slope > 8")
def _(v):
    spark = v("district").sparkSession
    root = work_folder(spark, "terrain")
    terrain.publish(root, "first", terrain.checked_stops(_raw_terrain(v)), v("district"), 0.02)
    return terrain.steep(spark, root)


@query("dom_terrain_activate", "SELECT CAST(count(*) AS BIGINT) AS stops, CAST(count(*) FILTER (WHERE k % 17 <> 0 AND k % 34 <> 1) AS BIGINT) AS measured FROM stop_point WHERE k % 2 = 1")
def _(v):
    """Two datasets, of which the one that isn't the latest becomes active again."""
    spark = v("district").sparkSession
    root = work_folder(spark, "terrain")
    raw = _raw_terrain(v)
    terrain.publish(root, "odd", terrain.checked_stops(raw.where("cast(node_id as int) % 2 = 1")), v("district"), 0.02)
    terrain.publish(root, "all", terrain.checked_stops(raw), v("district"), 0.02)
    terrain.activate(spark, root, "odd")
    return terrain.active(spark, root)[0].agg(F.count(F.lit(1)).alias("stops"), F.count("slope_pct").alias("measured"))
