"""Ferries, bases, reproduced alightings, styles, retirement and checks on small cases with known results."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from headway.operators import districts, ferry, hourly, quality, rides, route_load, spatial, terrain
from headway.plans import catalogue

SF = "/root/testdata/sf0.001"
DAY = datetime.date(2026, 4, 1)
OD = "service_date date, route string, board_seq int, board_ars string, board_name string, alight_seq int, alight_ars string, alight_name string, passengers int"


def test_ferry_rows(spark):
    rows = [
        (DAY, None, None, None, "마곡", None, None, "여의도", 5), (DAY, None, None, None, "잠실", None, None, None, 2), (DAY, None, None, None, "서울숲", None, None, "성수", 3),
        (DAY, None, None, None, "마곡", None, None, "마곡", 1), (DAY, None, None, None, "강남역", None, None, "잠실", 7), (DAY, None, None, None, "망원", None, None, "강남역", 7),
        (DAY, "101", 4, None, "마곡", 5, None, "망원", 9), (DAY, None, None, "00011", "마곡", None, None, "망원", 8), (DAY, None, None, None, "망원", None, None, "잠실", 4),
    ]
    got = ferry.corrected(spark.createDataFrame(rows, OD)).collect()
    seen = [(r["route"], r["board_name"], r["board_seq"], r["alight_name"], r["alight_seq"], r["kind"]) for r in got]
    assert seen == [
        (ferry.ROUTE, "마곡", 1, "여의도", 3, "ferry"), (ferry.ROUTE, "잠실", 8, "뚝섬", 7, "no_alighting"), (ferry.ROUTE, "옥수", 5, "성수", 6, "same_pier"),
        (ferry.ROUTE, "망원", 2, "마곡", 1, "same_pier"), (None, "강남역", None, "잠실", None, "other"), (None, "망원", None, "강남역", None, "other"),
        ("101", "마곡", 4, "망원", 5, None), (None, "마곡", None, "망원", None, "other"), (ferry.ROUTE, "망원", 2, "잠실", 8, "ferry"),
    ]
    calendar = spark.createDataFrame([(DAY, DAY, "망원,옥수")], "first date, last date, piers string")
    day = ferry.by_day(ferry.corrected(spark.createDataFrame(rows, OD)), ferry.closures(calendar)).first()
    assert (day["n"], day["passengers"], day["closed"], day["at_closed"], day["changing"]) == (5, 15, "망원,옥수", 3 + 1 + 4, 4)
    assert ferry.by_day(ferry.corrected(spark.createDataFrame(rows, OD)), ferry.closures(calendar), "2027-01-01").first()["changing"] is None
    with pytest.raises(ValueError):
        ferry.closures(spark.createDataFrame([(DAY, DAY, "강남역")], "first date, last date, piers string"))
    assert ferry.corrected(spark.createDataFrame([], OD)).count() == 0


def test_alightings_split_an_hour_and_scale(spark):
    rows = spark.createDataFrame([("r", "b", 23, 20, 12.0)], "route string, alight_ars string, hour int, span int, riders double")
    got = {(r["minutes"], r["hour"]): r["riders"] for r in rides.alightings(rows, [0.0, 1.5, 3.0]).collect()}
    assert got == {(0.0, 23): 12.0, (1.5, 23): 6.0, (1.5, 0): 6.0, (3.0, 0): 12.0}
    cells = "what string, route string, hour int, riders double"
    predicted = spark.createDataFrame([("x", "r", 7, 30.0), ("x", "r", 8, 10.0), ("x", "only", 8, 10.0)], cells)
    counted = spark.createDataFrame([(None, "r", 7, 10.0), (None, "r", 9, 10.0)], cells).drop("what")
    assert rides.wape(predicted, counted, ["route"], ["hour"], ["what"]).first()["wape"] == pytest.approx((5 + 5 + 10) / 20)


def test_bases_of_a_view(spark):
    typical = spark.createDataFrame([("r", "1", "2", 10.0), ("r", "3", "2", 4.0)], "route string, board_ars string, alight_ars string, passengers double")
    daily = spark.createDataFrame([(DAY, "r", "1", "2", 3.0), (DAY + datetime.timedelta(1), "r", "3", "2", 5.0)], "service_date date, route string, board_ars string, alight_ars string, passengers double")
    profiles = spark.createDataFrame([("r", "1", 7, 0.25), ("r", "1", 12, 0.75)], "route string, ars string, hour int, ratio double")
    got = lambda *a: {r["board_ars"]: r["passengers"] for r in rides.basis(typical, daily, *a).collect()}
    assert got() == {"1": 10.0, "3": 4.0} and got(("2026-04-01", "2026-04-02")) == {"1": 1.5, "3": 2.5}
    share = sum(hourly.default_profile()[7:10])
    assert got(None, (7, 9), profiles) == {"1": 2.5, "3": pytest.approx(4 * share)}


def test_styles(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(1, 101)] + [(0, 0.0)], "k int, load double")
    got = {r["k"]: (r["level"], r["color"], r["weight"]) for r in route_load.styled(rows).collect()}
    assert 0 not in got and got[1] == (0, "#006837", 2.5) and got[100] == (9, "#a50026", 10.0) and sorted({x[0] for x in got.values()}) == list(range(10))
    fixed = {r["k"]: r["level"] for r in route_load.styled(rows, 10, 1000.0).collect()}
    assert min(fixed) == 10 and fixed[10] == 0 and fixed[100] == 5
    assert route_load.styled(rows.limit(0)).count() == 0 and route_load.styled(rows, 50, 40.0).count() == 51


def test_hours_of_a_day(spark):
    daily = spark.createDataFrame([(1, 100.0), (2, 100.0)], "stop int, n double")
    profiles = spark.createDataFrame([(1, h, float(h == 8), float(h in (8, 9))) for h in range(24)] + [(2, 5, 1.0, 1.0)], "stop int, hour int, boardings double, alightings double")
    got = {(r["stop"], r["hour"]): (r["boarding"], r["alighting"]) for r in hourly.distributed(daily, profiles, "n").collect()}
    assert got[1, 8] == (100.0, 50.0) and got[1, 9] == (0.0, 50.0) and len(got) == 48
    assert got[2, 7] == (round(100 * 0.11 / sum(hourly.DEFAULT_PROFILE), 2), round(100 * 0.10 / sum(hourly.DEFAULT_ALIGHTING), 2))
    predicted = catalogue.QUERIES["dom_predict_hourly"](spark, SF)
    days = predicted.groupBy("stop", "day").agg(F.sum("boarding").alias("b"), F.sum("alighting").alias("a"), F.first("prediction").alias("p"), F.count("*").alias("n"))
    assert days.count() > 0 and days.where("n != 24 or abs(b - p) > 0.13 or abs(a - p) > 0.13").count() == 0


def test_periods_divide_each_mode_by_its_days(spark):
    rows = spark.createDataFrame(
        [(DAY, "weekday", "a", "b", 6.0, 0.0), (DAY + datetime.timedelta(1), "weekday", "a", "b", 0.0, 4.0), (DAY + datetime.timedelta(2), "weekday", "a", "c", 2.0, 4.0), (DAY, "saturday", "a", "b", 9.0, 9.0)],
        "day date, day_type string, origin string, dest string, subway double, bus double",
    )
    got = {r["dest"]: (r["subway"], r["bus"]) for r in districts.period_pairs(rows, "2026-04-01", "2026-04-03", "weekday").collect()}
    assert got == {"b": (3.0, 2.0), "c": (1.0, 2.0)}
    none = districts.period_pairs(rows.where("subway = 6"), "2026-04-01", "2026-04-03", "weekday").first()
    assert none["subway"] == 6.0 and none["bus"] is None


def test_readings_retire_only_when_the_snapshot_has_them(spark, tmp_path):
    raw = spark.createDataFrame([("1", "", "a", "0.5", "0.5", "3", "1"), ("2", "", "b", "0.6", "0.5", "-9999", "-9999")], "node_id string, stop_no string, stop_name string, longitude string, latitude string, elev_m string, slope_pct string")
    areas = spark.createDataFrame([("d", 0.0, 0.0, 1.0, 1.0)], "dong string, x0 double, y0 double, x1 double, y1 double")
    terrain.publish(str(tmp_path), "one", terrain.checked_stops(raw), areas, 1.0)
    master = spark.createDataFrame([("1", 3.0, 1.0), ("2", None, None)], "node_id string, elev_m double, slope_pct double")
    assert terrain.retire(master, str(tmp_path)).columns == ["node_id"]
    for bad in (master.withColumn("elev_m", F.lit(4.0)), master.withColumn("slope_pct", F.lit(None).cast("double"))):
        with pytest.raises(ValueError):
            terrain.retire(bad, str(tmp_path))


def test_misplaced_stops(spark):
    path = spark.createDataFrame([("r", "1", 0.1, 0.1), ("s", "1", 0.1, 0.1), ("t", "1", 9.0, 9.0), ("r", "2", 0.9, 0.5), ("r", "3", 0.5, 0.5)], "route string, ars string, lng double, lat double")
    used = spark.createDataFrame([("1", 0.1, 0.1001), ("2", 1.5, 0.5)], "ars string, lng double, lat double")
    areas = spark.createDataFrame([("d", 0.0, 0.0, 1.0, 1.0), ("e", 1.0, 0.0, 2.0, 1.0)], "dong string, x0 double, y0 double, x1 double, y1 double")
    got = {r["ars"]: (r["n_routes"], r["used_dong"], r["path_dong"], r["differs"], r["metres"] is None) for r in spatial.misplaced(used, path, areas, 0.5, 150.0).collect()}
    assert got == {"2": (1, "e", "d", True, False), "3": (1, None, "d", True, True)}


def test_fingerprints_and_floors(spark):
    rows = spark.createDataFrame([(1, "a", 0.1), (2, None, 0.2), (2, None, 0.2)], "k int, t string, x double")
    one = quality.fingerprint(rows).first()
    assert quality.fingerprint(rows.orderBy(F.desc("k")).select("x", "t", "k")).first() == one and one["rows"] == 3
    for other in (rows.distinct(), rows.withColumn("t", F.coalesce("t", F.lit(""))), rows.withColumn("x", F.col("x") + 1e-16 * F.col("k")), rows.withColumnRenamed("t", "u")):
        assert quality.fingerprint(other).first() != one or other.collect() == rows.collect()
    values = [0.0, 0.3, 1.0, 4.5, 9.99, 10.0, 37.2, 1500.5, 1e6]
    got = quality.poisson_floor(spark.createDataFrame([(i, m) for i, m in enumerate(values)], "k int, v double"), ["k"], "v").collect()
    for r in got:
        m, k = r["mean"], math.floor(r["mean"])
        want = 2 * math.exp(-m + (k + 1) * math.log(m) - math.lgamma(k + 1)) if m else 0.0
        assert r["floor"] == pytest.approx(want, rel=1e-8)


def test_hours_are_rounded_as_their_sql_rounds(spark):
    import duckdb

    daily = spark.range(1, 2001).select(F.lit(1).alias("stop"), F.col("id").cast("double").alias("n"))
    profiles = spark.createDataFrame([], "stop int, hour int, boardings double, alightings double")  # every stop gets the defaults
    got = {(r["n"], r["hour"]): (r["boarding"], r["alighting"]) for r in hourly.distributed(daily, profiles, "n").collect()}
    on, off = (hourly.default_profile(x) for x in (hourly.DEFAULT_PROFILE, hourly.DEFAULT_ALIGHTING))
    wanted = duckdb.sql(f"SELECT CAST(n AS DOUBLE) AS n, CAST(h AS INT) AS h, round(n * CAST({on}[h + 1] AS DOUBLE), 2), round(n * CAST({off}[h + 1] AS DOUBLE), 2) FROM range(1, 2001) t(n), range(24) u(h)").fetchall()
    assert got == {(n, h): (b, a) for n, h, b, a in wanted}


def test_sums_at_the_limit_do_not_depend_on_the_order(spark):
    import random

    rng, rows = random.Random(3), []
    shares = [n / 2900 for n in (203, 17, 340, 611, 89, 128, 457, 333, 71, 622)]  # 0.99 together
    for k in range(60):
        rng.shuffle(shares)
        rows += [("r", f"{k:05d}", h, x) for h, x in enumerate(shares)]
    profiles = spark.createDataFrame(rows, "route string, ars string, hour int, ratio double").coalesce(1)
    got = hourly.pattern_sums(profiles, ["route", "ars"], ["route"]).first()
    assert (got["groups"], got["zero"], got["off"]) == (60, 0, 60)  # 1 - 0.99 is above 0.01 in double precision


def test_reproduced_alightings_are_moved_by_route_once(spark):
    """Trips times hours never cross a shuffle: they are grouped where their route is, and both levels read what was written."""
    plan = catalogue.QUERIES["dom_alight_reproduction"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan and plan.count("Exchange hashpartitioning") <= 24


def test_errors_of_cells_that_one_side_has(spark):
    predicted = spark.createDataFrame([("x", "r", 1, 2.0), ("x", "r", 2, 2.0), ("x", "s", 1, 0.0), ("x", "t", 1, 5.0)], "what string, route string, hour int, riders double")
    counted = spark.createDataFrame([("r", 2, 3.0), ("r", 3, 3.0), ("r", 3, 2.0), ("s", 1, 4.0), ("u", 1, 9.0)], "route string, hour int, riders double")
    # 4 riders are scaled to 8: 4 at hour 1, |4 - 3| at hour 2, 5 at hour 3; s has no riders, t and u only one side
    assert [tuple(r) for r in rides.wape(predicted, counted, ["route"], ["hour"], ["what"]).collect()] == [("x", (4 + 1 + 5) / 8)]
    trips = spark.createDataFrame([("r", "b", "c", 2.0), ("r", "z", "c", 1.0)], "route string, board_ars string, alight_ars string, p double")
    shares = spark.createDataFrame([("r", "b", 4, 0.25), ("r", "b", 5, 0.75), ("q", "z", 5, 1.0)], "route string, board_ars string, hour int, ratio double")
    assert sorted(tuple(r) for r in rides.over_hours(trips, shares).collect()) == [("r", "b", "c", 4, 0.5), ("r", "b", "c", 5, 1.5)]
