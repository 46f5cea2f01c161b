"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendars as cal
from ..functions import geo
from ..functions import identifiers as ids
from ..functions import numbers as num
from ..operators import ranks
from .views import query


def T():  # noqa: N802
    """The text of the messy view."""
    return F.col("t")


def scalar(name: str, view: str, key: list[str], column, sql: str, as_: str = "out"):
    """A query of one expression over a view; ``column`` makes the expression, once a session is there."""
    keys = ", ".join(key)
    query(name, f"SELECT {keys}, {sql} AS {as_} FROM {view}")(lambda v: v(view).select(*key, column().alias(as_)))


_TRIM = "trim(t)"
_PAD = "CASE WHEN length({0}) < 5 THEN lpad({0}, 5, '0') ELSE {0} END"
scalar("sc_clean_text", "messy", ["k"], lambda: ids.clean_text(T()), f"CASE WHEN {_TRIM} NOT IN ('nan', 'None', '', '<NA>') THEN {_TRIM} END")
scalar("sc_strip_dot0", "messy", ["k"], lambda: F.concat_ws("/", ids.strip_all_dot0(T()), ids.strip_dot0(T())), r"concat_ws('/', replace(t, '.0', ''), regexp_replace(t, '\.0$', ''))")
scalar(
    "sc_norm_ars_a", "messy", ["k"], lambda: ids.ars_or_virtual(T()),
    f"CASE WHEN t IS NULL OR {_TRIM} = '' OR lower({_TRIM}) = 'nan' THEN '00000' WHEN regexp_matches({_TRIM}, '^[0-9]+$') THEN {_PAD.format(_TRIM)} ELSE {_TRIM} END",
)
scalar("sc_norm_ars_b", "messy", ["k"], lambda: ids.ars_or_null(T()), f"CASE WHEN regexp_matches({_TRIM}, '^[0-9]+$') AND NOT regexp_matches({_TRIM}, '^0+$') THEN {_PAD.format(_TRIM)} END")
scalar("sc_norm_ars_c", "messy", ["k"], lambda: ids.ars_as_keyed(T()), f"CASE WHEN regexp_matches({_TRIM}, '^[0-9]{{1,4}}$') THEN lpad({_TRIM}, 5, '0') ELSE {_TRIM} END")
_S = r"regexp_replace(trim(coalesce(t, '')), '\.0$', '')"
scalar("sc_norm_ars_d", "messy", ["k"], lambda: ids.ars_key(T()), f"CASE WHEN regexp_matches({_S}, '^0*$') THEN '' ELSE {_PAD.format(_S)} END")
scalar(
    "sc_norm_ars_id", "messy", ["k"], lambda: ids.ars_id(T()),
    rf"(SELECT CASE WHEN y NOT IN ('nan', 'none', '', '<na>') THEN y END FROM (SELECT CASE WHEN regexp_matches(x, '^[0-9]+$') THEN {_PAD.format('x')} ELSE x END AS y FROM"
    rf" (SELECT CASE WHEN {_TRIM} NOT IN ('nan', 'None', '', '<NA>') THEN regexp_replace({_TRIM}, '\.0$', '') END AS x)))",
)
scalar("sc_lpad5", "messy", ["k"], lambda: F.lpad(T(), 5, "0"), "lpad(t, 5, '0')")
scalar("sc_strip_zeros", "messy", ["k"], lambda: ids.strip_zeros(T()), "CASE WHEN t = '' THEN '' WHEN ltrim(t, '0') = '' THEN '0' ELSE ltrim(t, '0') END")
scalar("sc_splittable", "messy", ["k"], lambda: ids.is_real_ars(T()), "regexp_matches(t, '^[0-9]{5}$') AND t <> '00000'")
scalar("sc_zfill_codes", "messy", ["k"], lambda: F.when(T() != "", ids.zero_fill(T(), 9)).otherwise(T()), "CASE WHEN t <> '' AND length(t) < 9 THEN lpad(t, 9, '0') ELSE t END")
scalar("sc_norm_name", "messy", ["k"], lambda: ids.match_name(T()), r"(SELECT CASE WHEN x NOT IN ('nan', 'none', '', '<na>') THEN x END FROM (SELECT regexp_replace(lower(trim(t)), '[\s.·ㆍ_-]+', '', 'g') AS x))")
scalar("sc_strip_parens", "messy", ["k"], lambda: ids.without_parens(T()), r"regexp_replace(t, '\([^)]*\)', '', 'g')")
scalar("sc_route_override", "messy", ["k"], lambda: ids.route_label(T()), "CASE t WHEN 'Jan-01' THEN '101' WHEN '411' THEN '0411' WHEN '40' THEN '040' ELSE t END")
scalar("sc_stop_id", "messy", ["k"], lambda: ids.stop_id(T(), F.col("k").cast("string")), "coalesce(t, 'name:' || CAST(k AS STRING))")
scalar("sc_escape_like", "messy", ["k"], lambda: ids.escape_like(T()), r"replace(replace(replace(t, '\', '\\'), '%', '\%'), '_', '\_')")
scalar("sc_gu_code", "district", ["dong"], lambda: F.concat_ws("/", ids.gu_code(F.col("dong")), F.left("dong", F.lit(4))), "left(dong, 5) || '/' || left(dong, 4)")
scalar("prj_area_unit", "flow", ["day_type", "ok", "dk"], lambda: F.concat_ws("/", *[ids.area_unit(F.col("origin"), x) for x in ("dong", "gu", "city")]),
       "CASE WHEN origin = 'outside' THEN 'outside/outside/outside' ELSE origin || '/' || left(origin, 5) || '/11' END")
scalar("sc_place_name", "district", ["dong"], lambda: F.when(F.col("dong").startswith("1105"), F.concat(F.lit("Incheon "), "name")).when(F.col("dong").startswith("1107"), F.concat(F.lit("Gyeonggi "), "name")).otherwise(F.col("name")),
       "CASE WHEN starts_with(dong, '1105') THEN 'Incheon ' || name WHEN starts_with(dong, '1107') THEN 'Gyeonggi ' || name ELSE name END")
scalar("sc_variant_route", "station", ["variant", "seq"], lambda: ids.variant_route(F.col("variant")), "split_part(variant, '|', 1)")
scalar(
    "sc_route_type", "messy", ["k"], lambda: ids.route_type(T()),
    "(SELECT CASE WHEN contains(u, '한강') THEN 'ferry' WHEN u = '' THEN 'other' WHEN u = 'A21' THEN 'trunk' WHEN starts_with(u, 'N') THEN 'night' WHEN regexp_matches(r, '^[가-힣]+[0-9]') THEN 'village'"
    " WHEN length(d) = 3 THEN 'trunk' WHEN length(d) = 2 THEN 'circular' WHEN length(d) = 4 AND d[1] BETWEEN '1' AND '7' THEN 'branch' WHEN length(d) = 4 AND d[1] = '9' THEN 'express' ELSE 'other' END"
    " FROM (SELECT u, r, regexp_extract(r, '^[0-9]+') AS d FROM (SELECT u, CASE WHEN starts_with(u, 'A') THEN substr(u, 2) ELSE u END AS r FROM (SELECT upper(trim(coalesce(t, ''))) AS u))))",
)
scalar("sc_parse_date", "daily", ["stop", "day"], lambda: cal.parse_day(F.when(F.day("day") % 3 == 0, F.date_format("day", "yyyy/MM/dd")).when(F.day("day") % 3 == 1, F.date_format("day", "yy-MM-dd")).otherwise(F.date_format("day", "yyyyMMdd"))), "strftime(day, '%y%m%d')")
scalar("sc_ym_range", "daily", ["stop", "day"], lambda: F.array_join(cal.month_range(cal.month_of(F.col("day")), cal.month_of(F.add_months("day", F.col("stop") % 5 - 1))), ","),
       "coalesce((SELECT string_agg(strftime(m, '%Y%m'), ',' ORDER BY m) FROM unnest(generate_series(date_trunc('month', day), date_trunc('month', day) + to_months(CAST(stop % 5 - 1 AS INT)), INTERVAL 1 MONTH)) AS g(m)), '')")
scalar("sc_prev_month", "daily", ["stop", "day"], lambda: cal.previous_month(F.col("day")), "strftime(date_trunc('month', day) - INTERVAL 1 MONTH, '%Y%m')")
scalar("sc_catch_up", "daily", ["stop", "day"], lambda: F.size(cal.months_to_collect(F.lit("199906"), F.col("day"))),
       "CAST(least(12, greatest(0, (year(day) * 12 + month(day) - 1) - (1999 * 12 + 6))) AS INT)")
scalar("sc_day_type", "daily", ["stop", "day"], lambda: cal.weekday_type(F.col("day")), "CASE isodow(day) WHEN 1 THEN 'mon' WHEN 2 THEN 'tue' WHEN 3 THEN 'wed' WHEN 4 THEN 'thu' WHEN 5 THEN 'fri' WHEN 6 THEN 'sat' ELSE 'sun_holiday' END")
scalar("sc_ratio_day_type", "flow", ["ok", "dk", "day_type"], lambda: cal.ratio_day_type(F.concat(F.lit("typical_"), "day_type"), F.lit(None).cast("string")), "CASE day_type WHEN 'saturday' THEN 'sat' ELSE 'weekday' END")
scalar("sc_day_group", "daily", ["stop", "day"], lambda: cal.day_group(F.col("day"), F.day("day") == 9), "CASE WHEN day(day) = 9 THEN 2 WHEN isodow(day) >= 6 THEN 1 ELSE 0 END")
scalar("sc_typical_round", "typical", ["route", "board_seq", "alight_seq"], lambda: num.half_up(F.col("passengers") / 7, 2), "floor(passengers / 7 * 100 + 0.5) / 100")
_LL = "radians({b} - {a})"
_HAV = "sin(radians(lat - 37.45e0) / 2) * sin(radians(lat - 37.45e0) / 2) + cos(radians(37.45e0)) * cos(radians(lat)) * sin(radians(lng - 127e0) / 2) * sin(radians(lng - 127e0) / 2)"


def _P():  # noqa: N802
    return F.lit(37.45), F.lit(127.0), F.col("lat"), F.col("lng")



scalar("sc_haversine", "stop_point", ["k"], lambda: F.round(geo.haversine_m(*_P()), 3), f"round(6371000e0 * 2 * atan2(sqrt({_HAV}), sqrt(1 - ({_HAV}))), 3)")
scalar("sc_distance_sphere", "stop_point", ["k"], lambda: F.round(geo.sphere_km(*_P()), 6), f"round(2 * 6370986e0 * asin(least(1e0, sqrt({_HAV}))) / 1000, 6)")
scalar("sc_equirect", "stop_point", ["k"], lambda: F.round(geo.flat_m(*_P()), 3), "round(6371000e0 * sqrt(pow(radians(lng - 127e0) * cos(radians((37.45e0 + lat) / 2)), 2) + pow(radians(lat - 37.45e0), 2)), 3)")
_CONG = "CASE WHEN {m} <= 0 THEN 0e0 ELSE floor(({o} * 100e0 / {m}) * 10 + 0.5) / 10 END"
scalar("sc_relative_congestion", "typical", ["route", "board_seq", "alight_seq"], lambda: num.relative_congestion(F.col("passengers"), F.lit(180)), _CONG.format(o="passengers", m="180"))


def _PC():  # noqa: N802
    return F.pmod(F.col("k"), F.lit(1200)) / 10.0 - 10



scalar("sc_congestion_level", "messy", ["k"], lambda: num.congestion_level(_PC()), "(SELECT CASE WHEN x < 20 THEN 'very_low' WHEN x < 40 THEN 'low' WHEN x < 60 THEN 'medium' WHEN x < 80 THEN 'high' ELSE 'very_high' END FROM (SELECT k % 1200 / 10e0 - 10 AS x))")
_CH = "lpad(upper(to_hex(CAST(trunc(({0})[i + 1] + (({0})[i + 2] - ({0})[i + 1]) * w) AS BIGINT))), 2, '0')"
scalar("sc_gradient_color", "messy", ["k"], lambda: num.gradient_color(_PC()),
       f"(SELECT '#' || {_CH.format('[0, 128, 255, 255, 255]')} || {_CH.format('[255, 255, 255, 128, 0]')} || '00' FROM (SELECT s, i, s - i AS w FROM (SELECT s, CAST(trunc(least(s, 3e0)) AS INT) AS i"
       " FROM (SELECT greatest(0e0, least((k % 1200 / 10e0 - 10) / 100, 1e0)) * 4 AS s))))")  # fmt: skip
scalar("sc_slope_band", "terrain", ["node"], lambda: num.slope_band(F.col("slope")), "CASE WHEN slope IS NULL THEN 'none' WHEN slope <= 4 THEN '0-4' WHEN slope <= 8 THEN '4-8' WHEN slope <= 12 THEN '8-12' ELSE '12+' END")
scalar("sc_log_breaks", "messy", ["k"], lambda: F.element_at(num.log_breaks(1.0, F.col("k") % 90 + 10.0, 4), 2), "round(1e0 * exp(ln((k % 90 + 10e0) / 1e0) / 4 * 2), 1)")
scalar("sc_fixed_scale", "messy", ["k"], lambda: num.fixed_scale((F.col("k") % 50) * 2.5, F.when(F.col("k") % 9 > 0, F.col("k") % 12), F.col("k") % 12 + F.col("k") % 5, F.col("k") % 7 > 0),
    "CASE WHEN k % 9 > 0 AND k % 7 > 0 AND k % 50 > 0 THEN (k % 50) * 2.5e0 * (k % 5 + 1) END")
scalar("sc_shade", "typical", ["route", "board_seq", "alight_seq"], lambda: F.round(num.shade(F.col("passengers"), F.lit(400.0)), 9), "round(0.08e0 + 0.67e0 * sqrt(passengers / 400e0), 9)")
scalar("sc_percent", "typical", ["route", "board_seq", "alight_seq"], lambda: num.percent_text(F.col("passengers"), F.lit(1024) * (F.col("board_seq") % 5)), "CASE WHEN board_seq % 5 > 0 THEN printf('%.1f%%', floor(passengers * 100e0 / (1024 * (board_seq % 5)) * 10 + 0.5) / 10) ELSE '-' END")
scalar("sc_steep_ratio", "messy", ["k"], lambda: num.steep_ratio(F.col("k") % 13, F.col("k") % 29), "CASE WHEN k % 29 <> 0 THEN CAST(round(CAST((k % 13) * 100 AS DECIMAL(20, 4)) / CAST(k % 29 AS DECIMAL(20, 4)), 1) AS DOUBLE) END")
scalar("sc_hours_share", "messy", ["k"], lambda: num.hours_share(F.expr("transform(sequence(0, 23), h -> cast(h as double))"), (F.col("k") % 10).cast("int"), (F.col("k") % 10 + F.col("k") % 14).cast("int")),
       "(SELECT CAST(sum(h) AS DOUBLE) FROM range(CAST(k % 10 AS BIGINT), CAST(k % 10 + k % 14 + 1 AS BIGINT)) AS r(h))")
scalar("sc_normalise_vector", "messy", ["k"], lambda: F.round(F.element_at(num.normalised(F.transform(F.sequence(F.lit(1), (F.col("k") % 3 + 23).cast("int")), lambda h: h * 1.0)), 5), 9), "CASE WHEN k % 3 = 1 THEN round(5e0 / 300e0, 9) END")
scalar("sc_number_nodata", "messy", ["k"], lambda: num.measured_or_null(F.when(F.col("k") % 5 == 0, "-9999").when(F.col("k") % 5 == 1, "NaN").otherwise(T()), least=0.0),
       "(SELECT CASE WHEN isfinite(x) AND x <> -9999 AND x >= 0 THEN x END FROM (SELECT TRY_CAST(CASE k % 5 WHEN 0 THEN '-9999' WHEN 1 THEN 'NaN' ELSE trim(t) END AS DOUBLE) AS x))")
scalar("sc_get_numeric", "messy", ["k"], lambda: num.number_or_zero(F.when(~T().isin("nan"), T())), "coalesce(TRY_CAST(CASE WHEN t <> 'nan' THEN trim(t) END AS DOUBLE), 0e0)")
scalar("sc_log1p", "daily", ["stop", "day"], lambda: F.round(F.greatest(F.lit(0.0), F.expm1(F.log1p("boardings"))), 9), "round(greatest(0e0, exp(ln(1 + boardings)) - 1), 9)")
scalar("sc_wkt_linestring", "stop_point", ["k"], lambda: geo.linestring(F.array(F.struct("lng", "lat"), F.struct(F.lit(127.0).alias("lng"), F.lit(37.5).alias("lat")))), "printf('LINESTRING(%.7f %.7f, 127.0000000 37.5000000)', lng, lat)")
scalar("sc_parse_linestring", "stop_point", ["k"], lambda: geo.parse_linestring(geo.linestring(F.array(F.struct("lng", "lat"))))[0]["lng"], "round(lng, 6)")
scalar("sc_sha256", "messy", ["k"], lambda: F.sha2(F.concat_ws("|", F.col("k").cast("string"), T()), 256), "sha256(concat_ws('|', CAST(k AS STRING), t))")
scalar("flt_like_pattern_list", "messy", ["k"], lambda: F.coalesce(ids.matches_patterns(T(), T(), F.lit("%City%|ars:00000|N1_")), F.lit(False)), "coalesce(t LIKE '%City%' OR t = '00000' OR t LIKE 'N1_', false)")
scalar("sp_make_point", "stop_point", ["k"], lambda: F.coalesce(F.when(F.col("k") % 7 != 0, F.struct("lng", "lat")), F.struct(F.lit(0.0).alias("lng"), F.lit(0.0).alias("lat")))["lng"], "CASE WHEN k % 7 <> 0 THEN lng ELSE 0e0 END")


def _ring(view):
    corner = lambda x, y: F.struct(F.col(x).alias("lng"), F.col(y).alias("lat"))
    return F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"), corner("x0", "y0"))


@query("sp_covers", """SELECT dong, ars, lng > x0 AND lng < x1 AND lat > y0 AND lat < y1 AS inside FROM stop_point JOIN district ON lng BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1""")
def _covers(v):
    from ..operators.spatial import within_cells

    pairs = within_cells(v("stop_point"), v("district"), 0.02)
    ring = _ring(v)
    return pairs.where(geo.covers(F.col("lng"), F.col("lat"), ring)).select("dong", "ars", geo.contains(F.col("lng"), F.col("lat"), ring).alias("inside"))


@query("sp_validity", """SELECT dong, kind, kind IN ('whole', 'turned') AS valid FROM (SELECT dong, unnest(['whole', 'turned', 'open', 'short', 'crossed', 'far', 'twice', 'null', 'missing']) AS kind FROM district)""")
def _valid(v):
    """The area's ring as it is and in other direction, and spoiled in several ways."""
    ring = _ring(v)
    corner = lambda i: F.get(ring, F.lit(i))
    rings = {
        "whole": ring, "turned": F.reverse(ring), "open": F.slice(ring, 1, 4), "short": F.array(corner(0), corner(1), corner(0)),
        "crossed": F.array(corner(0), corner(2), corner(1), corner(3), corner(0)), "far": F.transform(ring, lambda p: F.struct((p["lng"] + 60).alias("lng"), p["lat"].alias("lat"))),
        "twice": F.concat(F.slice(ring, 1, 4), ring), "null": F.transform(ring, lambda p, i: F.struct(F.when(i != 2, p["lng"]).alias("lng"), p["lat"].alias("lat"))), "missing": F.when(F.lit(False), ring),
    }
    kind = "struct<kind:string,ring:array<struct<lng:double,lat:double>>>"
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), r.alias("ring")).cast(kind) for k, r in rings.items()]))
    return v("district").select("dong", each.alias("x")).select("dong", "x.kind", geo.is_valid_ring(F.col("x.ring")).alias("valid"))


@query("sc_quantile_breaks", """SELECT route, CAST(len(list_filter([b1, b2, b3, b4], lambda b: passengers >= b)) AS INT) AS class, count(*) AS n FROM (SELECT route, passengers,
    v[CAST(least(n - 1, floor(n / 5)) AS INT) + 1] AS b1, v[CAST(least(n - 1, floor(2 * n / 5)) AS INT) + 1] AS b2, v[CAST(least(n - 1, floor(3 * n / 5)) AS INT) + 1] AS b3, v[CAST(least(n - 1, floor(4 * n / 5)) AS INT) + 1] AS b4
    FROM typical JOIN (SELECT route AS r, list_sort(list(passengers)) AS v, count(*) AS n FROM typical GROUP BY route) q ON r = route) GROUP BY 1, 2""")
def _breaks(v):
    typical = v("typical")
    breaks = ranks.class_limits_by(typical, "route", "passengers", 5)
    return typical.join(breaks, "route").groupBy("route", num.class_of(F.col("passengers"), F.col("breaks")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("sc_join_lines", "SELECT route, CAST(count(*) AS INT) AS points FROM route_stop GROUP BY route")
def _join_lines(v):
    # each stop's segment to the next shares a vertex with the one before it
    points = v("route_stop").groupBy("route").agg(F.sort_array(F.collect_list(F.struct("seq", "ars"))).alias("s"))
    dot = lambda x: F.struct(x["seq"].cast("double").alias("lng"), F.length(x["ars"]).cast("double").alias("lat"))
    lines = F.zip_with(F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s")), lambda a, b: F.array(dot(a), dot(b)))
    return points.select("route", F.size(geo.joined_lines(lines)).alias("points"))
