"""Queries of ferries, bases of a view, reproduced alightings, map styles, and checks of coordinates, terrain and services."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions import identifiers as ids
from ..functions import numbers as num
from ..operators import districts, ferry, hourly, rides, route_load, spatial, terrain
from ..sources import paged_api
from ..sources.files import saved, work_folder
from .views import query

C = F.col

# ---------------------------------------------------------------- ferries

_P = "[" + ", ".join(f"'{p}'" for p in ferry.PIERS) + "]"
_IN = lambda c, names: f"coalesce({c} IN (" + ", ".join(f"'{p}'" for p in names) + "), false)"
_TRIPS = f"""p0 AS (SELECT * REPLACE (CASE board_name WHEN '서울숲' THEN '성수' ELSE board_name END AS board_name, CASE alight_name WHEN '서울숲' THEN '성수' ELSE alight_name END AS alight_name) FROM pier_od),
    p1 AS (SELECT *, route IS NULL AND board_ars IS NULL AND alight_ars IS NULL AND {_IN('board_name', ferry.PIERS)} AND (alight_name IS NULL OR {_IN('alight_name', ferry.PIERS)}) AS trip, list_position({_P}, board_name) AS spot FROM p0),
    p2 AS (SELECT * EXCLUDE (trip, spot, board_name, alight_name), trip, CASE WHEN trip AND alight_name IS NULL THEN 'no_alighting' WHEN trip AND alight_name = board_name THEN 'same_pier' WHEN trip THEN 'ferry' WHEN route IS NULL THEN 'other' END AS kind,
        CASE WHEN trip AND alight_name = board_name THEN {_P}[CASE spot WHEN 1 THEN 2 ELSE spot - 1 END] ELSE board_name END AS board_name, CASE WHEN trip AND alight_name IS NULL THEN {_P}[CASE spot WHEN 8 THEN 7 ELSE spot + 1 END] ELSE alight_name END AS alight_name FROM p1),
    trips AS (SELECT service_date, CASE WHEN trip THEN '{ferry.ROUTE}' ELSE route END AS route, CAST(CASE WHEN trip THEN list_position({_P}, board_name) ELSE board_seq END AS INT) AS board_seq, board_ars, board_name,
        CAST(CASE WHEN trip THEN list_position({_P}, alight_name) ELSE alight_seq END AS INT) AS alight_seq, alight_ars, alight_name, passengers, kind FROM p2)"""


@query("dom_ferry_rows", f"SELECT * FROM (WITH {_TRIPS} SELECT * FROM trips)")
def _(v):
    return ferry.corrected(v("pier_od"))


@query("dom_ferry", f"""SELECT * FROM (WITH {_TRIPS},
    shut AS (SELECT service_date, list(DISTINCT pier) AS piers, string_agg(DISTINCT list_position({_P}, pier) || pier, ',' ORDER BY list_position({_P}, pier) || pier) AS names FROM (SELECT CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS service_date, piers FROM closure) JOIN (SELECT unnest({_P}) AS pier) ON piers = 'all' OR list_contains(string_split(piers, ','), pier) GROUP BY service_date)
    SELECT t.service_date, count(*) AS n, CAST(sum(passengers) AS BIGINT) AS passengers, coalesce(first(names), '') AS closed,
        CAST(coalesce(sum(passengers) FILTER (WHERE list_contains(piers, board_name) OR list_contains(piers, alight_name)), 0) AS BIGINT) AS at_closed,
        CASE WHEN t.service_date >= DATE '1998-01-01' THEN CAST(coalesce(sum(passengers) FILTER (WHERE {_IN('board_name', ferry.WEST)} AND {_IN('alight_name', ferry.EAST)} OR {_IN('board_name', ferry.EAST)} AND {_IN('alight_name', ferry.WEST)}), 0) AS BIGINT) END AS changing
    FROM trips t LEFT JOIN shut s ON t.service_date = s.service_date WHERE kind <> 'other' GROUP BY t.service_date)""")
def _(v):
    found = ferry.by_day(ferry.corrected(v("pier_od")), ferry.closures(v("closure")), "1998-01-01")
    numbered = F.transform(F.split("closed", ","), lambda p: F.concat(F.array_position(F.array(*map(F.lit, ferry.PIERS)), p).cast("string"), p))
    return found.withColumn("closed", F.when(C("closed") == "", "").otherwise(F.array_join(numbered, ",")))


@query("agg_ferry_report", f"SELECT * FROM (WITH {_TRIPS} SELECT kind, count(*) AS n, CAST(sum(passengers) AS BIGINT) AS passengers FROM trips WHERE kind IS NOT NULL GROUP BY kind)")
def _(v):
    return ferry.corrected(v("pier_od")).where("kind is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("passengers").alias("passengers"))


# ---------------------------------------------------------------- riders over the day

_SHARE = "share AS (SELECT route, board_ars, hour, sum(passengers) / sum(sum(passengers)) OVER (PARTITION BY route, board_ars) AS ratio FROM timed WHERE {0} GROUP BY 1, 2, 3)"
_MEAN = "SELECT route, board_ars, alight_ars, sum(passengers) / (SELECT count(DISTINCT service_date) FROM leg WHERE service_date BETWEEN DATE '1997-03-01' AND DATE '1997-05-31') AS p FROM leg WHERE service_date BETWEEN DATE '1997-03-01' AND DATE '1997-05-31' GROUP BY 1, 2, 3"
_HOURS = f"SELECT '{{0}}' AS basis, x.route, x.board_ars, alight_ars, p * CASE WHEN t.ratio IS NULL THEN {sum(hourly.default_profile()[7:10])!r} ELSE coalesce(s.ratio, 0) END AS passengers FROM {{1}} x LEFT JOIN (SELECT route, board_ars, sum(ratio) AS ratio FROM share GROUP BY 1, 2) t USING (route, board_ars) LEFT JOIN (SELECT route, board_ars, sum(ratio) AS ratio FROM share WHERE hour BETWEEN 7 AND 9 GROUP BY 1, 2) s USING (route, board_ars)"


def _profiles(rows):
    sums = rows.groupBy("route", C("board_ars").alias("ars"), "hour").agg(F.sum("passengers").alias("boardings"))
    return hourly.ratios(sums, ["route", "ars"], "boardings")


@query("dom_period_basis", f"""SELECT basis, route, board_ars, alight_ars, round(passengers, 6) AS passengers FROM (WITH {_SHARE.format("board_seq % 5 <> 2")}, day AS (SELECT route, board_ars, alight_ars, sum(passengers) AS p FROM typical GROUP BY 1, 2, 3), mean AS ({_MEAN})
    SELECT 'typical' AS basis, route, board_ars, alight_ars, p AS passengers FROM day UNION ALL SELECT 'period', route, board_ars, alight_ars, p FROM mean
    UNION ALL {_HOURS.format('typical 7-9', 'day')} UNION ALL {_HOURS.format('period 7-9', 'mean')})""")
def _(v):
    profiles, spring = _profiles(v("timed").where("board_seq % 5 <> 2")), ("1997-03-01", "1997-05-31")  # stops without a profile
    parts = []
    for name, period, hours in (("typical", None, None), ("period", spring, None), ("typical 7-9", None, (7, 9)), ("period 7-9", spring, (7, 9))):
        rows = rides.basis(v("typical"), v("leg"), period, hours, profiles)
        parts.append(rows.select(F.lit(name).alias("basis"), *rides.PAIR, F.round("passengers", 6).alias("passengers")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_REPRO = f"""{_SHARE.format("service_date < DATE '1999-01-01' AND alight_seq > board_seq")},
    od AS (SELECT route, board_ars, alight_ars, alight_seq - board_seq AS span, sum(passengers) AS p FROM timed WHERE alight_seq > board_seq GROUP BY 1, 2, 3, 4),
    split AS (SELECT od.route, od.board_ars, alight_ars, span, hour, p * ratio AS riders FROM od JOIN share USING (route, board_ars)),
    pred AS (SELECT 'alighting ' || m AS what, route, alight_ars AS ars, CAST((hour + floor(span * m / 60) + k) % 24 AS INT) AS hour, sum(riders * CASE k WHEN 0 THEN 1 - (span * m / 60 - floor(span * m / 60)) ELSE span * m / 60 - floor(span * m / 60) END) AS riders
        FROM split CROSS JOIN (VALUES (0e0), (1.5e0), (2.5e0)) t(m) CROSS JOIN (VALUES (0), (1)) u(k) WHERE k = 0 OR span * m / 60 > floor(span * m / 60) GROUP BY 1, 2, 3, 4 UNION ALL SELECT 'boarding', route, board_ars, hour, sum(riders) FROM split GROUP BY 2, 3, 4),
    seen AS (SELECT 'alighting' AS side, route, alight_ars AS ars, CAST(floor((hour * 60 + minute + (alight_seq - board_seq) * pace) / 60) % 24 AS INT) AS hour, sum(passengers) AS riders FROM timed WHERE service_date >= DATE '1999-01-01' AND alight_seq > board_seq GROUP BY 1, 2, 3, 4
        UNION ALL SELECT 'boarding', route, board_ars, hour, sum(passengers) FROM timed WHERE service_date >= DATE '1999-01-01' AND alight_seq > board_seq GROUP BY 1, 2, 3, 4)"""
_WAPE = """SELECT '{0}' AS level, what, sum(abs(coalesce(p.riders, 0) * c_all / p_all - coalesce(c.riders, 0))) / sum(coalesce(c.riders, 0)) AS wape FROM
    (SELECT what, {1}, sum(riders) AS p_all FROM pred GROUP BY ALL HAVING sum(riders) > 0) a JOIN (SELECT side, {1}, sum(riders) AS c_all FROM seen GROUP BY ALL) b USING ({1}) CROSS JOIN (SELECT unnest(range(24)) AS hour) h
    LEFT JOIN (SELECT what, {1}, hour, sum(riders) AS riders FROM pred GROUP BY ALL) p USING (what, {1}, hour) LEFT JOIN (SELECT side, {1}, hour, sum(riders) AS riders FROM seen GROUP BY ALL) c USING (side, {1}, hour) WHERE side = split_part(what, ' ', 1) GROUP BY what"""


@query("dom_alight_reproduction", f"SELECT level, what, round(wape, 9) AS wape FROM (WITH {_REPRO} {_WAPE.format('route', 'route')} UNION ALL {_WAPE.format('stop', 'route, ars')})")
def _(v):
    timed = route_load.ordered(v("timed"))
    shares = _profiles(timed.where("service_date < '1999-01-01'")).select("route", C("ars").alias("board_ars"), "hour", "ratio")
    span = (C("alight_seq") - C("board_seq")).alias("span")
    od = timed.groupBy("route", "board_ars", "alight_ars", span).agg(F.sum("passengers").alias("p"))
    split = rides.over_hours(od, shares)
    counted = timed.where("service_date >= '1999-01-01'")
    there = (F.floor((C("hour") * 60 + C("minute") + span * C("pace")) / 60) % 24).cast("int").alias("hour")
    off = counted.select("route", C("alight_ars").alias("ars"), there, C("passengers").alias("riders"))
    on = counted.select("route", C("board_ars").alias("ars"), "hour", C("passengers").alias("riders"))
    moved = rides.alightings(split, [0.0, 1.5, 2.5]).withColumn("what", F.concat(F.lit("alighting "), C("minutes").cast("string")))
    stays = split.groupBy("route", C("board_ars").alias("ars"), "hour").agg(F.sum("riders").alias("riders")).withColumn("what", F.lit("boarding"))
    cells = saved(moved.drop("minutes").unionByName(stays), "cells")  # both levels read them
    moved, stays = cells.where("what != 'boarding'"), cells.where("what = 'boarding'")
    parts = [
        rides.wape(predicted, seen, group, ["hour"], ["what"]).select(F.lit(level).alias("level"), "what", F.round("wape", 9).alias("wape"))
        for level, group in (("route", ["route"]), ("stop", ["route", "ars"])) for predicted, seen in ((moved, off), (stays, on))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _default(values):
    return "[" + ", ".join(repr(x) for x in hourly.default_profile(values)) + "]"


@query("dom_distribute_hours", f"""SELECT stop, day, boardings, CAST(hour AS INT) AS hour, round(boardings * coalesce(b / NULLIF(bs, 0), {_default(hourly.DEFAULT_PROFILE)}[hour + 1]), 2) AS boarding, round(boardings * coalesce(a / NULLIF("as", 0), {_default(hourly.DEFAULT_ALIGHTING)}[hour + 1]), 2) AS alighting
    FROM daily CROSS JOIN (SELECT unnest(range(24)) AS hour) LEFT JOIN (SELECT *, sum(b) OVER (PARTITION BY stop) AS bs, sum(a) OVER (PARTITION BY stop) AS "as" FROM (SELECT CAST(board_seq AS INT) AS stop, hour, sum(passengers) AS b, sum(passengers * pace) AS a FROM timed WHERE board_seq % 4 <> 1 GROUP BY 1, 2) QUALIFY count(*) OVER (PARTITION BY stop) = 24) USING (stop, hour)""")
def _(v):
    return hourly.distributed(v("daily"), _stop_profiles(v), "boardings")


def _stop_profiles(v):
    rows = v("timed").where("board_seq % 4 <> 1")  # the other stops get the defaults
    return rows.groupBy(C("board_seq").alias("stop"), "hour").agg(F.sum("passengers").alias("boardings"), F.sum(C("passengers") * C("pace")).alias("alightings"))


@query("dom_predict_hourly")
def _(v):
    from pyspark.ml.feature import VectorAssembler

    from ..operators import models

    rows = models.features(v("daily"))
    model, _ = models.train(rows)
    scored = models.predict(model, VectorAssembler(inputCols=list(models.FEATURES), outputCol="features").transform(rows))
    return hourly.distributed(scored.select("stop", "day", "prediction"), _stop_profiles(v), "prediction")


# ---------------------------------------------------------------- districts, classes and styles

@query("agg_period_dong_mean", """SELECT origin, dest, sum(subway) / NULLIF((SELECT count(DISTINCT day) FROM od_dong WHERE subway > 0 AND day BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND day_type = 'weekday'), 0) AS subway,
    sum(bus) / NULLIF((SELECT count(DISTINCT day) FROM od_dong WHERE bus > 0 AND day BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND day_type = 'weekday'), 0) AS bus FROM od_dong WHERE day BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND day_type = 'weekday' GROUP BY origin, dest""")
def _(v):
    return districts.period_pairs(v("od_dong"), "1996-01-01", "1998-12-31", "weekday")


@query("sc_sigungu_key", "SELECT key, count(*) AS n FROM (SELECT CASE WHEN length(origin) >= 4 THEN left(origin, 4) END AS key FROM od_dong UNION ALL SELECT CASE WHEN length(ars) >= 4 THEN left(ars, 4) END FROM (SELECT CAST(k AS STRING) AS ars FROM stop_point)) GROUP BY key")
def _(v):
    codes = v("od_dong").select(C("origin").alias("code")).unionByName(v("stop_point").select(C("k").cast("string").alias("code")))
    return codes.groupBy(ids.sigungu_key(C("code")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("sc_class_of", "SELECT p_partkey AS k, CASE WHEN p_size >= 40 THEN 3 WHEN p_size >= 20 THEN 2 WHEN p_size >= 10 THEN 1 ELSE 0 END AS class FROM part")
def _(v):
    return v("part").select(C("p_partkey").alias("k"), num.class_of(C("p_size"), F.array(F.lit(10), F.lit(20), F.lit(40))).cast("int").alias("class"))


_LOADS = "(SELECT t.route, s.seq, sum(passengers) AS load FROM typical t JOIN (SELECT DISTINCT seq FROM route_stop) s ON s.seq >= board_seq AND s.seq < alight_seq GROUP BY t.route, s.seq)"
_STYLE = lambda level: f"SELECT route, seq, load, level, {list(route_load.LOAD_COLORS)}[level + 1] AS color, CAST({list(route_load.LOAD_WEIGHTS)}[level + 1] AS DOUBLE) AS weight FROM (SELECT *, CAST({level} AS INT) AS level FROM kept)"


@query("dom_style_segments", f"""SELECT * FROM (WITH kept AS (SELECT * FROM {_LOADS} WHERE load >= 10), nth AS (SELECT load, row_number() OVER (ORDER BY load) - 1 AS i, count(*) OVER () AS n FROM kept),
    breaks AS (SELECT k, load AS b FROM (SELECT unnest(range(1, 10)) AS k) JOIN nth ON i = least(n - 1, k * n // 10)) {_STYLE('(SELECT count(*) FROM breaks WHERE kept.load >= b)')})""")
def _(v):
    return route_load.styled(route_load.segment_loads(v("typical")), 10)


@query("dom_style_segments_fixed", f"""SELECT * FROM (WITH kept AS (SELECT * FROM {_LOADS} WHERE load >= 10) {_STYLE("(SELECT count(*) FROM range(1, 10) t(k) WHERE kept.load >= round(10 * exp(ln(5000e0 / 10) / 10 * k), 1))")})""")
def _(v):
    return route_load.styled(route_load.segment_loads(v("typical")), 10, 5000.0)


@query("agg_ars_codes", "SELECT route, CAST(count(*) FILTER (WHERE board_ars IS NULL) AS BIGINT) AS without, CAST(count(*) FILTER (WHERE board_ars = '00000') AS BIGINT) AS virtual, CAST(count(*) FILTER (WHERE NOT regexp_full_match(board_ars, '[0-9]{5}')) AS BIGINT) AS malformed FROM raw_od GROUP BY route")
def _(v):
    ars = C("board_ars")
    return v("raw_od").groupBy("route").agg(F.count_if(ars.isNull()).alias("without"), F.count_if(ars == "00000").alias("virtual"), F.count_if(~ars.rlike("^[0-9]{5}$")).alias("malformed"))


# ---------------------------------------------------------------- points

_HAV = "(6371000e0 * 2 * atan2(sqrt({0}), sqrt(1 - ({0}))))".format("pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lng - {a}lng) / 2), 2)")


@query("sp_contains", "SELECT ars, dong FROM stop_point JOIN district ON lng > x0 AND lng < x1 AND lat > y0 AND lat < y1")
def _(v):
    ring = F.array(*[F.struct(C(x).alias("lng"), C(y).alias("lat")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    pairs = spatial.within_cells(v("stop_point"), v("district").withColumn("ring", ring), 0.02)
    return pairs.where(geo.contains(C("lng"), C("lat"), C("ring"))).select("ars", "dong")


@query("sp_distance", f"SELECT a.k, round({_HAV.format(a='a.', b='b.')}, 3) AS metres FROM stop_point a JOIN stop_point b ON b.k = a.k + 7")
def _(v):
    other = v("stop_point").select((C("k") - 7).alias("k"), C("lng").alias("r_lng"), C("lat").alias("r_lat"))
    return v("stop_point").join(other, "k").select("k", F.round(geo.haversine_m(C("lat"), C("lng"), C("r_lat"), C("r_lng")), 3).alias("metres"))


@query("sp_dwithin", f"SELECT a.k, b.k AS other FROM stop_point a JOIN stop_point b ON {_HAV.format(a='a.', b='b.')} <= 1500")
def _(v):
    other = v("stop_point").select(C("k").alias("other"), C("lng").alias("r_lng"), C("lat").alias("r_lat"))
    return spatial.near(v("stop_point"), other, 1500.0).select("k", "other")


_AREA = "(SELECT {0}.ars, min(dong) AS dong FROM {0} JOIN district ON lng BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1 GROUP BY {0}.ars)"


@query("dom_stop_coord_check", f"""SELECT ars, n_routes, round(metres, 3) AS metres, used_dong, path_dong, used_dong IS DISTINCT FROM path_dong AS differs FROM (WITH path AS (SELECT ars, count(DISTINCT route) AS n_routes, median(lng) AS lng, median(lat) AS lat FROM path_point GROUP BY ars)
    SELECT p.ars, n_routes, {_HAV.format(a='u.', b='p.')} AS metres, ud.dong AS used_dong, pd.dong AS path_dong, u.lat IS NULL AS lacking FROM path p LEFT JOIN used_point u ON p.ars = u.ars LEFT JOIN {_AREA.format('used_point')} ud ON p.ars = ud.ars LEFT JOIN {_AREA.format('path')} pd ON p.ars = pd.ars) WHERE lacking OR metres > 150""")
def _(v):
    return spatial.misplaced(v("used_point"), v("path_point"), v("district"), 0.02, 150.0).withColumn("metres", F.round("metres", 3))


# ---------------------------------------------------------------- terrain and services

_MASTER = "SELECT CAST(k AS STRING) AS node_id, CASE WHEN k % 17 = 0 THEN NULL ELSE CAST(k % 90 AS DOUBLE) END AS elev, CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(k % 50 AS DOUBLE) / 4 END AS slope FROM stop_point"


@query("val_terrain_retire", f"""SELECT CAST(count(slope) AS BIGINT) AS master_measured, CAST(count(held) AS BIGINT) AS snapshot_measured, CAST(count(*) FILTER (WHERE elev IS DISTINCT FROM held_elev OR slope IS DISTINCT FROM held) AS BIGINT) AS mismatched, false AS ok
    FROM (SELECT m.node_id, elev, CASE WHEN CAST(m.node_id AS INT) % 41 = 3 THEN 99e0 ELSE slope END AS slope, slope AS held, CASE WHEN CAST(m.node_id AS INT) % 37 = 2 THEN NULL ELSE elev END AS held_elev FROM ({_MASTER}) m)""")
def _(v):
    k = C("k")
    master = v("stop_point").select(
        k.cast("string").alias("node_id"), F.when(k % 17 != 0, (k % 90).cast("double")).alias("elev_m"), F.when(k % 11 != 0, (k % 50) / 4.0).alias("slope_pct"), "name", "lng", "lat",
    )
    held = master.select(
        "node_id", F.lit("").alias("stop_no"), C("name").alias("stop_name"), C("lng").alias("longitude"), C("lat").alias("latitude"),
        F.when(C("node_id").cast("int") % 37 != 2, C("elev_m")).alias("elev_m"), "slope_pct",
    )
    root = work_folder(master.sparkSession, "retire")
    terrain.publish(root, "first", terrain.checked_stops(held), v("district"), 0.02)
    changed = master.withColumn("slope_pct", F.when(C("node_id").cast("int") % 41 == 3, 99.0).otherwise(C("slope_pct")))
    return terrain.retirement(changed, root)


@query("src_api_result_check", """SELECT k, CASE k % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'not_published' ELSE 'error' END AS state, CASE k % 5 WHEN 0 THEN 'fine' WHEN 1 THEN 'nothing yet' WHEN 2 THEN 'bad key *** of ***' ELSE '' END AS message FROM api_page""")
def _(v):
    return paged_api.result_states(v("api_page"), key="abc123").select("k", "state", "message")
