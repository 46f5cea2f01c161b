"""Queries of filters, joins, aggregations, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import identifiers as ids
from ..functions import numbers as num
from ..operators import demand, lookups, od_cleaning, quality, route_load, spatial
from ..operators.models import clipped, dense_codes, features
from .views import query

C = F.col


@query("flt_in_list", "SELECT mode, node, CAST(sum(round_even(boardings, 0)) AS BIGINT) AS boardings FROM demand WHERE dow IN (1, 2, 3) AND hour IN (7, 8, 9) GROUP BY mode, node")
def _(v):
    return demand.selected(v("demand"), [1, 2, 3], [7, 8, 9], []).groupBy("mode", "node").agg(F.sum(num.to_count(C("boardings"))).alias("boardings"))


@query("flt_regex_ars", "SELECT k, t FROM messy WHERE regexp_matches(t, '^[0-9]{5}$') AND t <> '00000'")
def _(v):
    return v("messy").where(ids.is_real_ars(C("t"))).select("k", "t")


@query("flt_like_any", "SELECT route, count(*) AS n FROM raw_od WHERE board_name LIKE '%가상%' OR alight_name LIKE '%가상%' OR alight_name LIKE '%경유%' GROUP BY route")
def _(v):
    return v("raw_od").where(ids.has_virtual_mark(C("board_name")) | ids.has_virtual_mark(C("alight_name"))).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query("flt_ilike_escaped", r"SELECT k, t FROM messy WHERE t ILIKE '%.west\_%' ESCAPE '\'")
def _(v):
    pattern = F.concat(F.lit("%"), ids.escape_like(F.lit(".WEST_")), F.lit("%"))
    return v("messy").withColumn("p", pattern).where(F.expr("t ilike p")).select("k", "t")


@query("flt_area_level", """SELECT 'dong' AS level, sum(bus) AS bus FROM flow WHERE origin = '11012002' UNION ALL SELECT 'gu', sum(bus) FROM flow WHERE origin >= '11012' AND origin < '11013'
    UNION ALL SELECT 'city', sum(bus) FROM flow WHERE origin <> 'outside' UNION ALL SELECT 'group', sum(bus) FROM flow WHERE origin IN ('11010000', '11011001')""")
def _(v):
    areas = [("dong", ["11012002"]), ("gu", ["11012"]), ("city", []), ("group", ["11010000", "11011001"])]
    # one pass: a conditional sum per area
    sums = v("flow").agg(*[F.sum(F.when(ids.in_area(C("origin"), level, codes), C("bus"))).alias(level) for level, codes in areas])
    return sums.unpivot([], [level for level, _ in areas], "level", "bus")


@query("flt_bbox", "SELECT k, lng, lat FROM stop_point WHERE lat BETWEEN 37.42e0 AND 37.5e0 AND lng BETWEEN 126.95e0 AND 127.03e0")
def _(v):
    return v("stop_point").where(C("lat").between(37.42, 37.5) & C("lng").between(126.95, 127.03)).select("k", "lng", "lat")


@query("flt_year_label_prefix", "SELECT use_ym, count(*) AS n FROM boarding_month WHERE NOT use_ym BETWEEN 199601 AND 199912 GROUP BY use_ym")
def _(v):
    return v("boarding_month").where(~C("use_ym").between(199601, 199912)).groupBy("use_ym").agg(F.count(F.lit(1)).alias("n"))


_LOOKUP = "SELECT {k}, min({v}) AS {v} FROM raw_od WHERE {v} IS NOT NULL AND {v} <> '' AND {k} IS NOT NULL GROUP BY {k} HAVING count(DISTINCT {v}) = 1"


@query("join_unambiguous_lookup", _LOOKUP.format(k="board_ars", v="board_code"))
def _(v):
    return lookups.unambiguous(v("raw_od"), ["board_ars"], "board_code")


@query("join_fill_same_ars", f"""SELECT route, count(*) AS n, CAST(count(code) AS BIGINT) AS filled FROM (SELECT r.route, coalesce(NULLIF(r.board_code, ''), l.board_code, r.board_code) AS code
    FROM raw_od r LEFT JOIN ({_LOOKUP.format(k='board_ars', v='board_code')}) l ON r.board_ars = l.board_ars) GROUP BY route""")
def _(v):
    raw = v("raw_od")
    return lookups.fill(raw, raw, {"board_ars": "board_ars"}, "board_code", "board_code").groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.count("board_code").alias("filled"))


@query("join_fill_name", f"""SELECT route, CAST(count(code) AS BIGINT) AS filled FROM (SELECT r.route, CASE WHEN r.board_code IS NULL AND r.board_ars IS NULL THEN l.board_code ELSE r.board_code END AS code
    FROM raw_od r LEFT JOIN ({_LOOKUP.format(k='board_name', v='board_code')}) l ON r.board_name = l.board_name) GROUP BY route""")
def _(v):
    raw = v("raw_od")
    return lookups.fill(raw, raw, {"board_name": "board_name"}, "board_code", "board_code", C("board_ars").isNull()).groupBy("route").agg(F.count("board_code").alias("filled"))


@query("join_fill_cross", f"""SELECT route, CAST(count(code) AS BIGINT) AS filled FROM (SELECT r.route, coalesce(r.alight_code, l.board_code) AS code
    FROM raw_od r LEFT JOIN ({_LOOKUP.format(k='board_ars', v='board_code')}) l ON r.alight_ars = l.board_ars) GROUP BY route""")
def _(v):
    raw = v("raw_od")
    return lookups.fill(raw, raw, {"alight_ars": "board_ars"}, "alight_code", "board_code").groupBy("route").agg(F.count("alight_code").alias("filled"))


@query("join_route_id_map", """SELECT route, CAST(count(route_id) AS BIGINT) AS known, count(*) AS n FROM (SELECT r.route, coalesce(r.route_id, b.id, a.id) AS route_id FROM raw_od r
    LEFT JOIN (SELECT route, board_seq, min(route_id) AS id FROM raw_od WHERE board_seq IS NOT NULL GROUP BY 1, 2) b ON r.route = b.route AND r.board_seq = b.board_seq
    LEFT JOIN (SELECT route, alight_seq, min(route_id) AS id FROM raw_od WHERE alight_seq IS NOT NULL GROUP BY 1, 2) a ON r.route = a.route AND r.alight_seq = a.alight_seq) GROUP BY route""")
def _(v):
    raw = v("raw_od")
    for side in ("board", "alight"):
        ids_ = raw.where(f"{side}_seq is not null").groupBy("route", f"{side}_seq").agg(F.min("route_id").alias("__id"))
        raw = raw.join(ids_, ["route", f"{side}_seq"], "left").withColumn("route_id", F.coalesce("route_id", "__id")).drop("__id")
    return raw.groupBy("route").agg(F.count("route_id").alias("known"), F.count(F.lit(1)).alias("n"))


@query("join_master_then_ref", """SELECT r.board_ars, min(coalesce(m.name, f.board_name)) AS name FROM raw_od r LEFT JOIN (SELECT ars, min(name) AS name FROM stop_point WHERE k % 3 = 0 GROUP BY ars) m ON r.board_ars = m.ars
    LEFT JOIN (SELECT board_ars, min(board_name) AS board_name FROM raw_od GROUP BY board_ars) f ON r.board_ars = f.board_ars WHERE r.board_ars IS NOT NULL GROUP BY r.board_ars""")
def _(v):
    raw = v("raw_od").where("board_ars is not null")
    master = v("stop_point").where("k % 3 = 0").groupBy(C("ars").alias("board_ars")).agg(F.min("name").alias("m_name"))
    reference = raw.groupBy("board_ars").agg(F.min("board_name").alias("r_name"))
    stops = raw.select("board_ars").distinct()
    return stops.join(master, "board_ars", "left").join(reference, "board_ars", "left").select("board_ars", F.coalesce("m_name", "r_name").alias("name"))


_REFS = """(SELECT concat_ws('/', route, CAST(seq AS STRING)) AS id, CASE WHEN seq % 10 = 7 THEN NULL ELSE ars END AS ars, concat('stop ', CAST(seq % 90 AS STRING)) AS name, substr(ars, 3, 3) AS short FROM route_stop)"""


@query("join_cascade_match", f"""SELECT id, CASE WHEN n1 IS NOT NULL THEN CASE WHEN n1 = 1 THEN v1 END WHEN n2 IS NOT NULL THEN CASE WHEN n2 = 1 THEN v2 END ELSE CASE WHEN n3 = 1 THEN v3 END END AS node,
    CAST(CASE WHEN n1 IS NOT NULL THEN 1 WHEN n2 IS NOT NULL THEN 2 ELSE 3 END AS INT) AS stage, coalesce(n1, n2, n3) AS candidates FROM {_REFS} r
    LEFT JOIN (SELECT ars, count(DISTINCT k) AS n1, min(k) AS v1 FROM stop_point GROUP BY ars) a ON r.ars = a.ars
    LEFT JOIN (SELECT name, substr(ars, 3, 3) AS short, count(DISTINCT k) AS n2, min(k) AS v2 FROM stop_point GROUP BY ALL) b ON r.name = b.name AND r.short = b.short
    LEFT JOIN (SELECT name, count(DISTINCT k) AS n3, min(k) AS v3 FROM stop_point GROUP BY name) c ON r.name = c.name WHERE coalesce(n1, n2, n3) IS NOT NULL""")
def _(v):
    points = v("stop_point").withColumn("short", F.substring("ars", 3, 3)).select(C("k").alias("node"), "ars", "name", "short")
    refs = v("route_stop").select(F.concat_ws("/", "route", C("seq").cast("string")).alias("id"), "ars", F.concat(F.lit("stop "), (C("seq") % 90).cast("string")).alias("name"), F.substring("ars", 3, 3).alias("short"))
    refs = refs.withColumn("ars", F.when(C("id").endswith("7"), F.lit(None)).otherwise(C("ars")))
    return lookups.cascade(refs, points, "id", [["ars"], ["name", "short"], ["name"]], "node")


@query("join_regexp_key", r"SELECT m.k, n.n_nationkey FROM messy m JOIN nation n ON lower(regexp_replace(m.t, '\([^)]*\)', '', 'g')) = lower(n.n_name) UNION ALL SELECT k, NULL FROM messy WHERE k < 3")
def _(v):
    joined = v("messy").join(F.broadcast(v("nation")), F.lower(ids.without_parens(C("t"))) == F.lower("n_name")).select("k", "n_nationkey")
    return joined.unionByName(v("messy").where("k < 3").select("k", F.lit(None).cast("int").alias("n_nationkey")))


@query("join_expr_key", """SELECT d.node, CAST(count(*) AS BIGINT) AS n FROM demand d JOIN stop_point s ON lpad(d.node, 5, '0') = s.ars WHERE d.mode = 'bus' GROUP BY d.node""")
def _(v):
    bus = v("demand").where("mode = 'bus'").withColumn("ars", F.lpad("node", 5, "0"))
    return bus.join(v("stop_point").select("ars"), "ars").groupBy("node").agg(F.count(F.lit(1)).alias("n"))


@query("join_two_form_key", """SELECT s.ars, CAST(count(*) AS BIGINT) AS n FROM demand d JOIN (SELECT ars, ars AS form FROM stop_point UNION SELECT ars, ltrim(ars, '0') FROM stop_point) s ON d.node = s.form GROUP BY s.ars""")
def _(v):
    forms = lookups.two_forms(v("stop_point").select("ars"), "ars").withColumnRenamed("form", "node")
    return v("demand").join(forms, "node").groupBy("ars").agg(F.count(F.lit(1)).alias("n"))


@query("join_fallback_union_anti", """SELECT ars, lng FROM stop_point WHERE k % 3 <> 0 UNION ALL SELECT ars, 0e0 FROM (SELECT DISTINCT ars FROM route_stop) r WHERE NOT EXISTS (SELECT 1 FROM stop_point s WHERE s.k % 3 <> 0 AND s.ars = r.ars)""")
def _(v):
    outer = v("route_stop").select("ars").distinct().withColumn("lng", F.lit(0.0))
    return lookups.fallback_union(v("stop_point").where("k % 3 != 0").select("ars", "lng"), outer, ["ars"])


@query("join_exists_spatial", "SELECT ars FROM stop_point s WHERE EXISTS (SELECT 1 FROM district d WHERE d.dong < '11030500' AND s.lng BETWEEN d.x0 AND d.x1 AND s.lat BETWEEN d.y0 AND d.y1)")
def _(v):
    return spatial.covering(v("stop_point"), v("district").where("dong < '11030500'"), 0.02).select("ars").distinct()


@query("join_covers_any", "SELECT d.dong, count(DISTINCT s.ars) AS stops FROM stop_point s JOIN district d ON s.lng BETWEEN d.x0 AND d.x1 AND s.lat BETWEEN d.y0 AND d.y1 GROUP BY d.dong")
def _(v):
    return spatial.covering(v("stop_point"), v("district"), 0.02).groupBy("dong").agg(F.count_distinct("ars").alias("stops"))


@query("join_covers_first_lateral", """SELECT s.ars, min(d.dong) AS dong FROM stop_point s JOIN district d ON s.lng BETWEEN d.x0 AND d.x1 AND s.lat BETWEEN d.y0 AND d.y1 GROUP BY s.ars""")
def _(v):
    return lookups.first_per(spatial.covering(v("stop_point"), v("district"), 0.02), ["ars"], [C("dong").asc()]).select("ars", "dong")


@query("join_lateral_next", "SELECT variant, seq, ars, lead(ars) OVER (PARTITION BY variant ORDER BY seq, ars) AS next_ars FROM station")
def _(v):
    return v("station").select("variant", "seq", "ars", F.lead("ars").over(Window.partitionBy("variant").orderBy("seq", "ars")).alias("next_ars"))


_DIST = "6371000e0 * 2 * atan2(sqrt({h}), sqrt(1 - ({h})))"
_H2 = "sin(radians(b.lat - a.lat) / 2) * sin(radians(b.lat - a.lat) / 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lng - a.lng) / 2) * sin(radians(b.lng - a.lng) / 2)"


@query("join_distance_within", f"SELECT a.ars, b.ars AS near, round({_DIST.format(h=_H2)}, 3) AS metres FROM stop_point a JOIN stop_point b ON {_DIST.format(h=_H2)} <= 1000")
def _(v):
    p = v("stop_point").select("ars", "lng", "lat")
    return spatial.near(p, p.select(C("ars").alias("near"), C("lng").alias("r_lng"), C("lat").alias("r_lat")), 1000).select("ars", "near", F.round("metres", 3).alias("metres"))


@query("join_range_onboard", "SELECT t.route, s.seq, sum(passengers) AS load FROM typical t JOIN (SELECT DISTINCT seq FROM route_stop) s ON s.seq >= board_seq AND s.seq < alight_seq GROUP BY t.route, s.seq")
def _(v):
    return route_load.segment_loads(v("typical"))


@query("join_range_remaining", """SELECT route, seq AS k, level, CAST(max(alight_seq) - 1 AS INT) AS until FROM (SELECT route, seq, alight_seq, sum(p) OVER (PARTITION BY route, seq ORDER BY alight_seq DESC) AS still FROM
    (SELECT t.route, s.seq, alight_seq, sum(passengers) AS p FROM typical t JOIN (SELECT DISTINCT seq FROM route_stop) s ON s.seq >= board_seq AND s.seq < alight_seq GROUP BY 1, 2, 3)) CROSS JOIN (VALUES (100e0), (500e0), (2000e0)) l(level)
    WHERE still > level GROUP BY route, seq, level""")
def _(v):
    return route_load.reach(v("typical"), [100.0, 500.0, 2000.0])


@query("join_cross_scalar", "SELECT route, sum(passengers) / (SELECT sum(passengers) FROM typical) AS share FROM typical GROUP BY route")
def _(v):
    total = v("typical").agg(F.sum("passengers").alias("all"))
    return v("typical").groupBy("route").agg(F.sum("passengers").alias("p")).crossJoin(F.broadcast(total)).select("route", (C("p") / C("all")).alias("share"))


@query("join_full_outer_reconcile", """SELECT CAST(count(*) FILTER (WHERE b.ars IS NULL) AS BIGINT) AS only_a, CAST(count(*) FILTER (WHERE a.ars IS NULL) AS BIGINT) AS only_b, CAST(count(*) FILTER (WHERE a.ars IS NOT NULL AND b.ars IS NOT NULL) AS BIGINT) AS both_
    FROM (SELECT DISTINCT ars FROM route_stop WHERE seq <= 20) a FULL JOIN (SELECT DISTINCT ars FROM route_stop WHERE seq > 25) b ON a.ars = b.ars""")
def _(v):
    a = v("route_stop").where("seq <= 20").select("ars").distinct().withColumn("a", F.lit(1))
    b = v("route_stop").where("seq > 25").select("ars").distinct().withColumn("b", F.lit(1))
    return a.join(b, "ars", "full").agg(F.count_if(C("b").isNull()).alias("only_a"), F.count_if(C("a").isNull()).alias("only_b"), F.count_if(C("a").isNotNull() & C("b").isNotNull()).alias("both_"))


@query("join_update_from", "SELECT s.ars, coalesce(d.dong, s.name) AS name FROM stop_point s LEFT JOIN (SELECT lpad(CAST(substr(dong, 3, 3) AS STRING), 5, '0') AS ars, dong FROM district) d ON s.ars = d.ars")
def _(v):
    fixes = v("district").select(F.lpad(F.substring("dong", 3, 3), 5, "0").alias("ars"), C("dong").alias("name"))
    return lookups.update_from(v("stop_point").select("ars", "name"), fixes, ["ars"], "name")


@query("join_delete_using", "SELECT route, count(*) AS n FROM raw_od r WHERE NOT EXISTS (SELECT 1 FROM stop_point s WHERE s.k % 2 = 0 AND s.ars = r.board_ars) GROUP BY route")
def _(v):
    gone = v("stop_point").where("k % 2 = 0").select(C("ars").alias("board_ars"))
    return v("raw_od").join(gone, "board_ars", "left_anti").groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query("join_alias_wildcard", """SELECT s.k, count(*) AS n FROM stop_point s JOIN (SELECT DISTINCT service, node FROM demand WHERE mode = 'bus') d ON s.ars = lpad(d.node, 5, '0') OR s.name = concat('stop ', d.node) GROUP BY s.k""")
def _(v):
    bus = v("demand").where("mode = 'bus'").select("service", "node").distinct()
    points = v("stop_point").select("k", "ars", "name")
    # an OR of two equalities is the union of two joins, each pair once
    by_ars = points.join(bus.withColumn("ars", F.lpad("node", 5, "0")), "ars").select("k", "service", "node")
    by_name = points.join(bus.withColumn("name", F.concat(F.lit("stop "), "node")), "name").select("k", "service", "node")
    return by_ars.unionByName(by_name).distinct().groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("join_calendar_interval", """SELECT l.route, sum(passengers) AS passengers FROM leg l JOIN (SELECT date AS a, date + 30 AS b FROM holiday) h ON l.service_date BETWEEN h.a AND h.b GROUP BY l.route""")
def _(v):
    spans = v("holiday").select(F.explode(F.sequence("date", F.date_add("date", 30))).alias("service_date"))
    return v("leg").join(F.broadcast(spans), "service_date").groupBy("route").agg(F.sum("passengers").alias("passengers"))


@query("join_asof_prev", "SELECT a.stop, a.day, coalesce(b.boardings, 0e0) AS week_before FROM daily a LEFT JOIN daily b ON a.stop = b.stop AND b.day = a.day - 7")
def _(v):
    before = v("daily").select("stop", F.date_add("day", 7).alias("day"), C("boardings").alias("b"))
    return v("daily").join(before, ["stop", "day"], "left").select("stop", "day", F.coalesce("b", F.lit(0.0)).alias("week_before"))


@query("join_fanout_guard", "SELECT t.route, CAST(count(*) AS BIGINT) AS n FROM typical t LEFT JOIN stop_point s ON t.board_ars = s.ars GROUP BY t.route")
def _(v):
    points = demand.one_point(v("stop_point"))
    return v("typical").join(points, C("board_ars") == C("ars"), "left").groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query("join_full_outer_summary", """SELECT coalesce(o.dong, i.dong) AS dong, coalesce(out_subway, 0e0) AS out_subway, coalesce(out_bus, 0e0) AS out_bus, coalesce(in_subway, 0e0) AS in_subway, coalesce(in_bus, 0e0) AS in_bus, coalesce(inside, 0e0) AS inside
    FROM (SELECT origin AS dong, sum(subway) AS out_subway, sum(bus) AS out_bus FROM flow GROUP BY origin) o FULL JOIN (SELECT dest AS dong, sum(subway) AS in_subway, sum(bus) AS in_bus FROM flow GROUP BY dest) i ON o.dong = i.dong
    LEFT JOIN (SELECT origin AS dong, sum(subway + bus) AS inside FROM flow WHERE origin = dest GROUP BY origin) s ON s.dong = coalesce(o.dong, i.dong)""")
def _(v):
    from ..operators.districts import summary

    return summary(v("flow"))


@query("agg_demand_sum_avg", """SELECT mode, service, node, CAST(sum(round_even(boardings, 0)) AS BIGINT) AS boardings, CAST(sum(round_even(alightings, 0)) AS BIGINT) AS alightings, CAST(sum(round_even(boardings, 0)) + sum(round_even(alightings, 0)) AS BIGINT) AS total,
    CAST(round(sum(CAST(boardings AS DECIMAL(28, 9))) / 7) AS BIGINT) AS mean FROM demand GROUP BY mode, service, node""")
def _(v):
    d = v("demand")
    keys = ["mode", "service", "node"]
    return demand.summed_and_mean(d, keys, 7)


@query("agg_mode_route_breakdown", "SELECT mode, service, CAST(sum(round_even(boardings, 0)) AS BIGINT) AS boardings FROM demand GROUP BY GROUPING SETS ((mode), (mode, service))")
def _(v):
    return v("demand").groupingSets([[C("mode")], [C("mode"), C("service")]], "mode", "service").agg(F.sum(num.to_count(C("boardings"))).alias("boardings"))


@query("agg_catchment_rollup", f"""SELECT d.node, min(s.name) AS name, CAST(sum(round_even(boardings, 0)) AS BIGINT) AS boardings FROM demand d JOIN stop_point s ON lpad(d.node, 5, '0') = s.ars JOIN (SELECT * FROM stop_point WHERE k = 50) c
    ON {_DIST.format(h=_H2.replace('a.', 'c.').replace('b.', 's.'))} <= 3000 WHERE d.mode = 'bus' GROUP BY d.node""")
def _(v):
    points = v("stop_point").select("ars", "name", C("lng").alias("r_lng"), C("lat").alias("r_lat"))
    stops = spatial.near(v("stop_point").where("k = 50").select("lng", "lat"), points, 3000).select("ars", "name")
    bus = v("demand").where("mode = 'bus'").withColumn("ars", F.lpad("node", 5, "0"))
    return bus.join(stops, "ars").groupBy("node").agg(F.min("name").alias("name"), F.sum(num.to_count(C("boardings"))).alias("boardings"))


@query("agg_line_list", "SELECT DISTINCT mode, service FROM demand")
def _(v):
    return v("demand").select("mode", "service").distinct()


@query("agg_route_summary", "SELECT route, sum(passengers) AS passengers, count(*) AS pairs FROM typical GROUP BY route")
def _(v):
    return v("typical").groupBy("route").agg(F.sum("passengers").alias("passengers"), F.count(F.lit(1)).alias("pairs"))


@query("agg_stop_matrix", "SELECT board_ars, alight_ars, sum(passengers) AS passengers FROM typical WHERE route = 'R05' GROUP BY ALL ORDER BY passengers DESC, board_ars, alight_ars LIMIT 200")
def _(v):
    return v("typical").where("route = 'R05'").groupBy("board_ars", "alight_ars").agg(F.sum("passengers").alias("passengers")).orderBy(F.desc("passengers"), "board_ars", "alight_ars").limit(200)


_OD = "service_date, route, route_id, board_seq, coalesce(board_ars, 'name:' || board_name) AS b, alight_seq, coalesce(alight_ars, 'name:' || alight_name) AS a"


@query("agg_dedup_fixed", f"""SELECT service_date, route, CAST(count(*) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS passengers, CAST(count(code) AS BIGINT) AS codes FROM (SELECT service_date, route, p, code FROM (SELECT *, sum(passengers) OVER (PARTITION BY service_date, route, route_id, board_seq, b, alight_seq, a) AS p, board_code AS code,
    row_number() OVER (PARTITION BY service_date, route, route_id, board_seq, b, alight_seq, a ORDER BY passengers DESC NULLS LAST, board_code NULLS LAST, board_name NULLS LAST, alight_code NULLS LAST, alight_name NULLS LAST) AS n
    FROM (SELECT {_OD}, passengers, board_code, board_name, alight_code, alight_name FROM raw_od)) WHERE n = 1) GROUP BY service_date, route""")
def _(v):
    d = od_cleaning.deduplicate(v("raw_od"))
    return d.groupBy("service_date", "route").agg(F.count(F.lit(1)).alias("n"), F.sum("passengers").alias("passengers"), F.count("board_code").alias("codes"))


@query("agg_mode_seq", """SELECT service_date, route, board_ars, modal_seq FROM (SELECT *, row_number() OVER (PARTITION BY service_date, route, board_ars ORDER BY n DESC, modal_seq NULLS LAST) AS r FROM
    (SELECT service_date, route, board_ars, board_seq AS modal_seq, count(*) AS n FROM raw_od WHERE board_ars <> '00000' AND route IS NOT NULL GROUP BY ALL)) WHERE r = 1""")
def _(v):
    return od_cleaning.modal_sequence(v("raw_od")).select("service_date", "route", "board_ars", "modal_seq")


@query("agg_min_within_2", """SELECT route, board_seq, board_ars, alight_ars, min(alight_seq) AS low FROM raw_od WHERE board_ars <> '00000' AND alight_ars <> '00000' GROUP BY ALL HAVING count(DISTINCT alight_seq) > 1 AND max(alight_seq) - min(alight_seq) <= 2""")
def _(v):
    rows = v("raw_od").where("board_ars != '00000' and alight_ars != '00000'").groupBy("route", "board_seq", "board_ars", "alight_ars")
    return rows.agg(F.count_distinct("alight_seq").alias("n"), F.min("alight_seq").alias("low"), F.max("alight_seq").alias("high")).where("n > 1 and high - low <= 2").drop("n", "high")


@query("agg_route_max_seq", "SELECT route, max(board_seq) AS last_seq FROM raw_od WHERE route IS NOT NULL GROUP BY route")
def _(v):
    return v("raw_od").where("route is not null").groupBy("route").agg(F.max("board_seq").alias("last_seq"))


@query("agg_reference_build", """SELECT ars, name, CAST(count(*) AS BIGINT) AS n, CAST(sum(passengers) AS BIGINT) AS passengers FROM (SELECT board_ars AS ars, board_name AS name, passengers FROM raw_od UNION ALL SELECT alight_ars, alight_name, passengers FROM raw_od) GROUP BY ars, name""")
def _(v):
    side = lambda s: v("raw_od").select(C(f"{s}_ars").alias("ars"), C(f"{s}_name").alias("name"), "passengers")
    return side("board").unionByName(side("alight")).groupBy("ars", "name").agg(F.count(F.lit(1)).alias("n"), F.sum("passengers").alias("passengers"))


@query("agg_best_per_node", "SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1")
def _(v):
    return lookups.first_per(v("part"), ["p_brand"], [F.desc("p_retailprice"), C("p_partkey").asc()]).select("p_brand", "p_partkey", "p_retailprice")


@query("agg_service_expand", """SELECT node, kind, min(service) AS service FROM (SELECT DISTINCT node, service, kind FROM (SELECT node, service FROM demand) CROSS JOIN (VALUES ('name'), ('id')) k(kind)) GROUP BY node, kind HAVING count(DISTINCT service) = 1""")
def _(v):
    rows = v("demand").select("node", "service").distinct().withColumn("kind", F.explode(F.array(F.lit("name"), F.lit("id"))))
    return lookups.unambiguous(rows, ["node", "kind"], "service")


@query("agg_join_coverage", """SELECT route, count(*) AS rows, CAST(count(s.ars) AS BIGINT) AS matched, round(count(s.ars) * 100e0 / count(*), 2) AS percent FROM raw_od r LEFT JOIN (SELECT DISTINCT ars FROM stop_point WHERE k % 5 <> 0) s ON r.board_ars = s.ars GROUP BY route""")
def _(v):
    return quality.coverage(v("raw_od").withColumnRenamed("board_ars", "ars"), v("stop_point").where("k % 5 != 0"), "ars", ["route"])


@query("agg_diag_codes", """SELECT CASE WHEN r.board_code IS NULL THEN 'missing' WHEN s.ars IS NULL THEN 'unknown' WHEN '1' || s.ars || '000' = r.board_code THEN 'equal' ELSE 'other' END AS state, count(*) AS n FROM raw_od r LEFT JOIN stop_point s ON r.board_ars = s.ars GROUP BY 1""")
def _(v):
    joined = v("raw_od").join(v("stop_point").select("ars"), C("board_ars") == C("ars"), "left")
    state = F.when(C("board_code").isNull(), "missing").when(C("ars").isNull(), "unknown").when(F.concat(F.lit("1"), "ars", F.lit("000")) == C("board_code"), "equal").otherwise("other")
    return joined.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_quality_report", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS nulls, CAST(count(*) FILTER (WHERE CAST({c} AS STRING) = '') AS BIGINT) AS empty, count(DISTINCT length(CAST({c} AS STRING))) AS lengths FROM raw_od" for c in od_cleaning.COLUMNS))
def _(v):
    return quality.quality_report(v("raw_od").select(*od_cleaning.COLUMNS))


@query("agg_master_check", "SELECT CAST(count(*) FILTER (WHERE s.ars IS NULL) AS BIGINT) AS unchecked, CAST(count(*) FILTER (WHERE '1' || s.ars || '000' <> r.board_code) AS BIGINT) AS wrong FROM raw_od r LEFT JOIN stop_point s ON r.board_ars = s.ars")
def _(v):
    joined = v("raw_od").join(v("stop_point").select("ars"), C("board_ars") == C("ars"), "left")
    return joined.agg(F.count_if(C("ars").isNull()).alias("unchecked"), F.count_if(F.concat(F.lit("1"), "ars", F.lit("000")) != C("board_code")).alias("wrong"))


@query("agg_legacy_od_analytics", """SELECT route, sum(passengers) AS p, round(sum(passengers) * 100 / sum(sum(passengers)) OVER (), 6) AS share FROM leg GROUP BY route""")
def _(v):
    sums = v("leg").groupBy("route").agg(F.sum("passengers").alias("p"))
    return sums.withColumn("share", F.round(C("p") * 100 / F.sum("p").over(Window.partitionBy()), 6))


@query("agg_row_multiset_diff", """SELECT dong, side, count(*) AS n FROM (SELECT dong, slope, 'left' AS side FROM (SELECT dong, slope FROM terrain EXCEPT ALL SELECT dong, slope FROM terrain WHERE node % 2 = 0) UNION ALL SELECT dong, slope, 'right' FROM (SELECT dong, slope FROM terrain WHERE node % 2 = 0 EXCEPT ALL SELECT dong, slope FROM terrain)) GROUP BY dong, side""")
def _(v):
    t = v("terrain")
    return quality.multiset_difference(t.select("dong", "slope"), t.where("node % 2 = 0").select("dong", "slope")).groupBy("dong", "side").agg(F.count(F.lit(1)).alias("n"))


query("agg_fingerprint")(lambda v: quality.fingerprint(v("typical")))


@query("agg_distinct_filter_string", "SELECT node, string_agg(DISTINCT service, ',' ORDER BY service) AS services, string_agg(DISTINCT service, ',' ORDER BY service) FILTER (WHERE hour < 8) AS early FROM demand GROUP BY node")
def _(v):
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    early = F.sort_array(F.collect_set(F.when(C("hour") < 8, C("service"))))
    return v("demand").groupBy("node").agg(joined("service").alias("services"), F.when(F.size(early) > 0, F.array_join(early, ",")).alias("early"))


@query("agg_percentile_median_point", "SELECT name, median(lng) AS lng, median(lat) AS lat FROM stop_point GROUP BY name")
def _(v):
    return v("stop_point").groupBy("name").agg(F.median("lng").alias("lng"), F.median("lat").alias("lat"))


@query("agg_clip_quantile", "SELECT stop, day, least(boardings, (SELECT quantile_cont(boardings, 0.995) FROM daily)) AS boardings FROM daily")
def _(v):
    return clipped(v("daily"), "boardings")


@query("agg_dense_code", "SELECT DISTINCT route, CAST(dense_rank() OVER (ORDER BY route) - 1 AS INT) AS code FROM route_stop")
def _(v):
    return dense_codes(v("route_stop").select("route").distinct(), "route", "code")


@query("agg_feature_medians", "SELECT median(boardings) AS boardings, median(CAST(month(day) AS DOUBLE)) AS month FROM daily")
def _(v):
    return v("daily").agg(F.median("boardings").alias("boardings"), F.median(F.month("day").cast("double")).alias("month"))


@query("agg_training_daily", "SELECT day, route, ars, sum(boardings) AS boardings FROM boarding_hour GROUP BY day, route, ars")
def _(v):
    return v("boarding_hour").groupBy("day", "route", "ars").agg(F.sum("boardings").alias("boardings"))


query("agg_poisson_floor")(lambda v: quality.poisson_floor(v("daily"), ["stop"], "boardings"))


@query("win_lag_rows", "SELECT stop, day, coalesce(lag(boardings, 7) OVER w, 0e0) AS lag_7, coalesce(lag(boardings, 30) OVER w, 0e0) AS lag_30 FROM daily WINDOW w AS (PARTITION BY stop ORDER BY day)")
def _(v):
    return features(v("daily")).select("stop", "day", "lag_7", "lag_30")


@query("win_rolling", "SELECT stop, day, round(coalesce(avg(boardings) OVER (PARTITION BY stop ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0e0), 9) AS mean_7, round(coalesce(avg(boardings) OVER (PARTITION BY stop ORDER BY day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), 0e0), 9) AS mean_14 FROM daily")
def _(v):
    return features(v("daily")).select("stop", "day", F.round("mean_7", 9).alias("mean_7"), F.round("mean_14", 9).alias("mean_14"))


@query("win_group_mean_broadcast", "SELECT stop, day, round(avg(boardings) OVER (PARTITION BY stop), 9) AS stop_mean FROM daily")
def _(v):
    return features(v("daily")).select("stop", "day", F.round("stop_mean", 9).alias("stop_mean"))


@query("win_share_of_total", "SELECT use_ym, route, sum(boardings) / sum(sum(boardings)) OVER (PARTITION BY use_ym) AS share FROM boarding_month GROUP BY use_ym, route")
def _(v):
    sums = v("boarding_month").groupBy("use_ym", "route").agg(F.sum("boardings").alias("b"))
    return sums.select("use_ym", "route", (C("b") / F.sum("b").over(Window.partitionBy("use_ym"))).alias("share"))


@query("win_diff", "SELECT use_ym, sum(boardings) - lag(sum(boardings)) OVER (ORDER BY use_ym) AS change FROM boarding_month GROUP BY use_ym")
def _(v):
    sums = v("boarding_month").groupBy("use_ym").agg(F.sum("boardings").alias("b"))  # a row per month
    return sums.select("use_ym", (C("b") - F.lag("b").over(Window.orderBy("use_ym"))).alias("change"))


@query("win_row_number_tiebreak", """SELECT ars, dong FROM (SELECT ars, dong, row_number() OVER (PARTITION BY ars ORDER BY (lng > x0 AND lng < x1 AND lat > y0 AND lat < y1) DESC, dong) AS r FROM stop_point JOIN district ON lng BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1) WHERE r = 1""")
def _(v):
    inside = geo.in_rectangle(*[C(c) for c in ("lng", "lat", "x0", "y0", "x1", "y1")], edge=False)
    return lookups.first_per(spatial.covering(v("stop_point"), v("district"), 0.02), ["ars"], [inside.desc(), C("dong").asc()]).select("ars", "dong")


@query("win_count_partition", "SELECT node, dong, count(*) OVER (PARTITION BY dong) AS n, CAST(count(*) FILTER (WHERE slope > 8) OVER (PARTITION BY dong) AS BIGINT) AS steep FROM terrain")
def _(v):
    w = Window.partitionBy("dong")
    return v("terrain").select("node", "dong", F.count(F.lit(1)).over(w).alias("n"), F.count(F.when(C("slope") > 8, 1)).over(w).alias("steep"))


@query("win_first_n_per_group", "SELECT mode, node, total FROM (SELECT mode, node, CAST(sum(boardings) AS DOUBLE) AS total, row_number() OVER (PARTITION BY mode ORDER BY sum(boardings) DESC, node) AS r FROM demand GROUP BY mode, node) WHERE r <= 5")
def _(v):
    return lookups.top_per(v("demand").groupBy("mode", "node").agg(F.sum("boardings").alias("total")), ["mode"], [F.desc("total"), C("node").asc()], 5)


@query("top_distinct_on", "SELECT DISTINCT ON (name) name, k, lng FROM stop_point ORDER BY name, k DESC")
def _(v):
    return lookups.first_per(v("stop_point"), ["name"], [F.desc("k")]).select("name", "k", "lng")


@query("top_nodes_limit", """SELECT mode, node, CAST(sum(round_even(boardings, 0)) + sum(round_even(alightings, 0)) AS BIGINT) AS total FROM demand GROUP BY mode, node ORDER BY total DESC, mode, node LIMIT 50""")
def _(v):
    return demand.top_nodes(demand.summed(v("demand"), ["mode", "node"]), 50).select("mode", "node", "total")


@query("top_search_rank", """SELECT mode, node, name FROM (SELECT DISTINCT mode, node, concat('stop ', node) AS name FROM demand) WHERE name ILIKE '%1%' ORDER BY CASE WHEN name = 'stop 12' THEN 0 WHEN node = 'stop 12' THEN 1 ELSE 2 END, CASE WHEN mode = 'subway' THEN 0 ELSE 1 END, name, node LIMIT 20""")
def _(v):
    nodes = v("demand").select("mode", "node", F.concat(F.lit("stop "), "node").alias("name")).distinct()
    return nodes.where(F.expr("name ilike '%1%'")).orderBy(*demand.search_order("stop 12")).limit(20)


@query("top_steep_stops", "SELECT node, slope FROM terrain WHERE slope IS NOT NULL ORDER BY slope DESC, node LIMIT 25 OFFSET 10")
def _(v):
    return v("terrain").where("slope is not null").orderBy(F.desc("slope"), "node").offset(10).limit(25).select("node", "slope")


@query("top_longest_variant", "SELECT route, variant FROM (SELECT route, variant, row_number() OVER (PARTITION BY route ORDER BY count(*) DESC, variant) AS r FROM station GROUP BY route, variant) WHERE r = 1")
def _(v):
    return lookups.first_per(v("station").groupBy("route", "variant").agg(F.count(F.lit(1)).alias("n")), ["route"], [F.desc("n"), C("variant").asc()]).select("route", "variant")


@query("top_section", "SELECT variant, seq FROM station s WHERE seq >= (SELECT min(seq) FROM station x WHERE x.variant = s.variant AND x.seq % 7 = 3) AND seq <= coalesce((SELECT min(seq) FROM station x WHERE x.variant = s.variant AND x.seq % 31 = 30), 9999)")
def _(v):
    w = Window.partitionBy("variant")
    ends = v("station").withColumns({"a": F.min(F.when(C("seq") % 7 == 3, C("seq"))).over(w), "b": F.coalesce(F.min(F.when(C("seq") % 31 == 30, C("seq"))).over(w), F.lit(9999))})
    return ends.where("seq between a and b").select("variant", "seq")


@query("top_k_flows", "SELECT route, alight_seq, p FROM (SELECT route, alight_seq, sum(passengers) AS p, row_number() OVER (PARTITION BY route ORDER BY sum(passengers) DESC, alight_seq) AS r FROM typical WHERE board_seq = 5 GROUP BY 1, 2) WHERE r <= 10")
def _(v):
    sums = v("typical").where("board_seq = 5").groupBy("route", "alight_seq").agg(F.sum("passengers").alias("p"))
    return lookups.top_per(sums, ["route"], [F.desc("p"), C("alight_seq").asc()], 10)


@query("top_next_stop_choice", """SELECT service_date, route, board_seq, board_ars FROM (SELECT *, row_number() OVER (PARTITION BY service_date, route, board_seq ORDER BY board_ars NULLS LAST, board_code NULLS LAST, board_name NULLS LAST) AS r FROM raw_od WHERE board_seq IS NOT NULL) WHERE r = 1""")
def _(v):
    return od_cleaning.next_stops(v("raw_od")).select("service_date", "route", "board_seq", "board_ars")


@query("top_stale_routes", "SELECT route, max(service_date) AS seen FROM leg GROUP BY route HAVING max(service_date) < DATE '2001-10-31' OR route LIKE '%3' ORDER BY seen NULLS FIRST, route")
def _(v):
    seen = v("leg").groupBy("route").agg(F.max("service_date").alias("seen"))
    return seen.where((C("seen") < "2001-10-31") | C("route").endswith("3")).orderBy(C("seen").asc_nulls_first(), "route")


@query("top_points", "SELECT board_ars, sum(passengers) AS p FROM typical GROUP BY board_ars ORDER BY p DESC, board_ars LIMIT 150")
def _(v):
    return v("typical").groupBy("board_ars").agg(F.sum("passengers").alias("p")).orderBy(F.desc("p"), "board_ars").limit(150)


@query("set_union_all", "SELECT route, seq, sum(n) AS net FROM (SELECT route, board_seq AS seq, passengers AS n FROM typical UNION ALL SELECT route, alight_seq, -passengers FROM typical) GROUP BY route, seq")
def _(v):
    return route_load.stop_flows(v("typical")).select("route", "seq", (C("ons") - C("offs")).alias("net"))


@query("set_union_distinct", "SELECT route, count(*) AS n FROM (SELECT * FROM typical WHERE board_ars IN (SELECT ars FROM stop_point WHERE k <= 40) UNION SELECT * FROM typical WHERE alight_ars IN (SELECT ars FROM stop_point WHERE k <= 40)) GROUP BY route")
def _(v):
    return route_load.area_legs(v("typical"), v("stop_point").where("k <= 40"), "any").groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query("set_union_first_wins", "SELECT route, seq, min(ars) AS ars FROM route_stop GROUP BY route, seq")
def _(v):
    return lookups.first_per(v("route_stop"), ["route", "seq"], [C("ars").asc()])


@query("set_not_in", "SELECT DISTINCT board_ars FROM raw_od r WHERE board_ars IS NOT NULL AND NOT EXISTS (SELECT 1 FROM stop_point s WHERE s.k < 250 AND s.ars = r.board_ars)")
def _(v):
    known = v("stop_point").where("k < 250").select(C("ars").alias("board_ars"))
    return v("raw_od").where("board_ars is not null").select("board_ars").distinct().join(known, "board_ars", "left_anti")


@query("set_except_all", "SELECT route, count(*) AS n FROM (SELECT route, board_seq FROM typical EXCEPT ALL SELECT route, seq FROM route_stop) GROUP BY route")
def _(v):
    return v("typical").select("route", "board_seq").exceptAll(v("route_stop").select("route", "seq")).groupBy("route").agg(F.count(F.lit(1)).alias("n"))
