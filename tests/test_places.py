import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from headway.functions import calendars as cal
from headway.functions import geo
from headway.functions import identifiers as ids
from headway.functions import parameters as par
from headway.operators import lookups, od_cleaning, paths, terrain
from headway.sources import files, paged_api, sinks


def test_ordered_vertices_equal_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(40):
        stops, path = rng.integers(0, 6, (rng.integers(1, 5), 2)) / 100.0, rng.integers(0, 6, (rng.integers(1, 7), 2)) / 100.0
        at, metres = paths.ordered_vertices(stops, path)
        assert list(at) == sorted(at)

        def length(s, p):
            return geo.EARTH_M * math.hypot(math.radians(p[0] - s[0]) * math.cos(math.radians((s[1] + p[1]) / 2)), math.radians(p[1] - s[1]))

        best = min(sum(length(s, path[i]) for s, i in zip(stops, pick)) for pick in itertools.combinations_with_replacement(range(len(path)), len(stops)))
        assert metres.sum() == pytest.approx(best, abs=1e-6)


def test_a_route_that_comes_back_keeps_its_order(spark):
    stations = spark.createDataFrame([("1", s, x, 37.0) for s, x in enumerate([127.0, 127.01, 127.02, 127.01, 127.0])] + [("2", 1, 127.0, 37.0), (None, 1, 1.0, 1.0)], "route string, seq int, lng double, lat double")
    path = spark.createDataFrame([("1", v, x, 37.0) for v, x in enumerate([127.0, 127.01, 127.02, 127.01, 127.0])], "route string, vertex int, lng double, lat double")
    got = {(r["route"], r["seq"]): r["vertex"] for r in paths.match_stations(stations, path).collect()}
    assert got == {("1", i): i for i in range(5)} | {("2", 1): None}


def test_stops_without_a_number_go_to_the_nearest_of_their_name(spark):
    stops = spark.createDataFrame([("r", 1, "01", "a"), ("r", 2, None, "b b"), ("r", 3, "99", "c"), ("r", 4, None, "none"), ("q", 1, None, "bb")], "route string, seq int, ars string, name string")
    points = spark.createDataFrame([(1, "1", "a", 127.0, 37.0), (2, "2", "bb", 128.0, 37.0), (3, "3", "b b", 127.1, 37.0), (4, "4", "c", 127.2, 37.0), (5, "01", "x", 0.0, 0.0), (6, "5", "none", None, 37.0)],
                                   "k int, ars string, name string, lng double, lat double")
    got = {(r["route"], r["seq"]): r["lng"] for r in paths.place_stops(stops, points).collect()}
    assert got == {("r", 1): 127.0, ("r", 2): 127.1, ("r", 3): 127.2, ("q", 1): 128.0}


def test_simplification_keeps_bends_and_nulls(spark):
    x = np.array([0.0, 1, 2, 3, 4])
    assert list(geo.kept_points(x, np.array([0, 0.001, 0, 2, 0]), 0.01)) == [True, False, True, True, True]
    assert list(geo.kept_points(x[:1], x[:1], 1)) == [True] and len(geo.kept_points(x[:0], x[:0], 1)) == 0
    rows = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]), (2, None), (3, [])], "k int, line array<struct<lng: double, lat: double>>")
    got = {r["k"]: r["s"] for r in rows.select("k", geo.simplified(F.col("line"), 0.1).alias("s")).collect()}
    assert got[2] is None and got[3] == [] and [tuple(p) for p in got[1]] == [(0.0, 0.0), (2.0, 0.0)]


def test_point_on_surface_lies_inside_a_concave_ring(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 4.0), (8.0, 4.0), (8.0, 1.0), (3.0, 1.0), (3.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    rows = spark.createDataFrame([(ring,), ([],)], "ring array<struct<lng: double, lat: double>>")
    p = geo.point_on_surface(F.col("ring"))
    got = rows.select(p.alias("p"), geo.contains(p["lng"], p["lat"], F.col("ring")).alias("inside")).collect()
    assert tuple(got[0]["p"]) == (1.5, 2.0) and got[0]["inside"] and got[1]["p"] is None


def test_parameters(spark):
    par.require(spark, par.mode_error(F.lit("bus")), par.period_error(F.lit("2024-01..2024-12")), par.hours_error(F.lit("7-9")), par.radius_error(F.lit(800)), par.keyword_error(F.lit("ab ")))
    for check in (par.mode_error(F.lit("rail")), par.mode_error(F.lit(None)), par.period_error(F.lit("2024-1")), par.period_error(F.lit("20 24-01")), par.hours_error(F.lit("9-7")), par.hours_error(F.lit("1-24")),
                  par.district_error(F.lit("1234567")), par.coordinate_error(F.lit(40.0), F.lit(127.0)), par.node_limit_error(F.lit(0)), par.keyword_error(F.lit(" a "))):
        with pytest.raises(ValueError):
            par.require(spark, check)
    row = spark.range(1).select(par.typical_label(F.lit("  ")).alias("a"), par.typical_label(F.lit("typical_saturday")).alias("b"), par.typical_label(F.lit("20240101")).alias("c"), par.page_rows(F.lit(None).cast("int")).alias("d"), par.page_rows(F.lit(5000)).alias("e")).first()
    assert tuple(row) == ("typical_weekday", "typical_saturday", None, 100, 1000)


def test_month_arithmetic_and_names(spark):
    row = spark.range(1).select(cal.month_after(F.lit(202401), -1).alias("a"), cal.month_after(F.lit(202311), 14).alias("b"), cal.months_between(F.lit(202311), F.lit(202401)).alias("c"),
                                ids.file_name(F.lit(" R 1/2 "), F.lit(""), F.lit("역.a")).alias("d"), ids.file_name(F.lit("")).alias("e"), ids.natural_key(F.lit("a10b2")).alias("f") > ids.natural_key(F.lit("a9b3"))).first()
    assert tuple(row) == (202312, 202501, 3, "R_1_2-역.a.csv", "table.csv", True)


def test_lookup_values_and_repeated_keys(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    table = spark.createDataFrame([("a", 1), ("c", 2), ("c", 3), (None, 4)], "key string, v int")
    got = {r["x"]: (r["v"], r["hit"]) for r in lookups.values_of(rows, {"x": "key"}, table, ["v"]).collect()}
    assert got == {"a": (1, True), "b": (None, False), None: (None, False)}
    with pytest.raises(Exception, match="not unique"):
        lookups.values_of(spark.createDataFrame([("c",)], "x string"), {"x": "key"}, table, ["v"]).collect()


def test_older_merge_keeps_its_defects(spark):
    schema = "service_date string, route string, route_id string, board_seq int, board_ars string, board_code string, board_name string, alight_seq int, alight_ars string, alight_code string, alight_name string, passengers int"
    row = lambda rid, code, name, n: ("d", "r", rid, 1, "00001", code, name, 2, "00002", "c", "z", n)
    rows = spark.createDataFrame([row("i", "k", "a", 1), row("i", "k", "a", 2), row("i", "k", "other", 4), row(None, "k", "a", 3), row(None, "k", "a", 4)], schema)
    got = sorted(((r["route_id"] or "", r["board_code"] or "", r["passengers"]) for r in od_cleaning.deduplicate_as_before(rows).collect()))
    assert got == [("", "", 7), ("", "k", 3), ("", "k", 4), ("i", "", 3)]


def test_terrain_refuses_bad_stops_and_changes(spark, tmp_path):
    good = ("1", "01", "a", "127.01", "37.01", "-9999", "3.5")
    schema = "node_id string, stop_no string, stop_name string, longitude string, latitude string, elev_m string, slope_pct string"
    for at, bad in ((0, " 1"), (0, ""), (2, " "), (3, "x"), (3, None), (4, "95"), (5, "NaN"), (6, "-1"), (6, "inf")):
        with pytest.raises(ValueError):
            terrain.checked_stops(spark.createDataFrame([good[:at] + (bad,) + good[at + 1 :]], schema))
    with pytest.raises(ValueError):
        terrain.checked_stops(spark.createDataFrame([good, good], schema))
    stops = terrain.checked_stops(spark.createDataFrame([good, ("2", "", "b", "127.5", "37.5", None, "")], schema))
    areas = spark.createDataFrame([("10", 127.0, 37.0, 127.02, 37.02), ("11", 127.02, 37.0, 127.04, 37.02)], "dong string, x0 double, y0 double, x1 double, y1 double")
    root = f"file://{tmp_path}"
    assert terrain.publish(root, "a", stops, areas, 0.02) == {"stops": 2, "measured": 1, "rows": 2, "assigned": 1, "ambiguous": 0}
    with pytest.raises(ValueError):
        terrain.publish(root, "a", stops, areas, 0.02)
    with pytest.raises(ValueError):
        terrain.activate(spark, root, "b")
    with pytest.raises(ValueError):
        terrain.assigned(stops, areas.unionByName(areas), 0.02)
    assert terrain.active(spark, root)[0].count() == 2


def test_reports_and_listings(spark):
    rows = spark.createDataFrame([("b", None), ("a", 1.5)], "k string, n double")
    lines = lambda df, **how: [r["line"] for r in df.transform(sinks.markdown, ["k"], **how).collect()]
    assert lines(rows, digits=1) == ["| k | n |", "|---|---:|", "| a | 1.5 |", "| b |  |"]
    odd = spark.createDataFrame([("x|y\nz", 12345678, 0.5), (None, None, None)], "k string, n long, share double")
    assert lines(odd, digits=2) == ["| k | n | share |", "|---|---:|---:|", "|  |  |  |", "| x\\|y<br>z | 12345678.00 | 0.50 |"]
    assert lines(rows.limit(0)) == ["| k | n |", "|---|---:|"]
    listed = spark.createDataFrame([("1", "1"), ("1", "1A"), ("2", "2A"), ("2", "2A"), ("2", "2출근"), ("2", "2AB"), ("3", "33")], "route string, name string")
    assert sorted(r["variant"] for r in paged_api.route_variants(listed).collect()) == ["1", "2|2A", "2|2출근"]
    stale = spark.createDataFrame([("a", 5), ("b", None), ("c", 1)], "route string, day int")
    assert {r["route"] for r in paged_api.within_quota(stale, "day", 3, 8).collect()} == {"b", "c"}
    assert files.hour_columns(["HR_4_GET_ON_NOPE", "23시-00시 승차인원", "x"]) == {"HR_4_GET_ON_NOPE": 4, "23시-00시 승차인원": 23}
