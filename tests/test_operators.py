"""Literal cases, invariants and sources."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from headway.functions import geo
from headway.functions.calendars import DAY_TYPES, parse_day_strict
from headway.operators import hourly, models, od_cleaning, quality, route_load
from headway.plans.views import views
from headway.sources import files, paged_api, sinks

SF = "/root/testdata/sf0.001"
OD = "service_date date, route string, route_id string, board_seq int, board_ars string, board_code string, board_name string, alight_seq int, alight_ars string, alight_code string, alight_name string, passengers int"


def od(spark, rows):
    full = [{"service_date": None, "route": "100", "route_id": "r", "board_code": "c", "board_name": "B", "alight_code": "d", "alight_name": "A", "passengers": 1} | r for r in rows]
    day = __import__("datetime").date(2024, 1, 2)
    return spark.createDataFrame([tuple((day if c == "service_date" else r.get(c)) for c in od_cleaning.COLUMNS) for r in full], OD)


def test_virtual_alighting_cases(spark):
    rows = [{"board_seq": i, "board_ars": f"{i:05}", "alight_seq": 30, "alight_ars": "00030"} for i in range(1, 30)]
    virtual = {"alight_ars": "00000", "alight_name": "end (가상)"}
    rows += [{"board_seq": s, "board_ars": a, "passengers": p, **virtual} for s, a, p in ((0, "00000", 10), (5, "00005", 20), (12, "00012", 30), (20, "00020", 40))]
    d, aside = od_cleaning.virtual_stops(od(spark, rows))
    assert [r["passengers"] for r in aside.collect()] == [30]
    got = {r["passengers"]: (r["alight_seq"], r["alight_ars"]) for r in d.where("passengers > 1").collect()}
    assert got == {10: (1, "00000"), 20: (5, "00005"), 40: (20, "00020")}


def test_modal_sequence_and_its_tie(spark):
    rows = [{"board_seq": s, "board_ars": "00001", "alight_seq": 9, "alight_ars": "00009"} for s in (3, 3, 4)]
    rows += [{"board_seq": s, "board_ars": "00002", "alight_seq": 9, "alight_ars": "00009"} for s in (7, 6)]
    got = {r["board_ars"]: r["modal_seq"] for r in od_cleaning.modal_sequence(od(spark, rows)).collect()}
    assert got == {"00001": 3, "00002": 6}


def test_same_stop_moves_to_the_next(spark):
    rows = [{"board_seq": 1, "board_ars": "01001", "alight_seq": 1, "alight_ars": "01001", "passengers": 5}, {"board_seq": 2, "board_ars": "01002", "board_name": "B2", "alight_seq": 4, "alight_ars": "01004"}]
    rows.append({"board_seq": None, "board_ars": None, "alight_seq": None, "alight_ars": None, "passengers": 7})
    got = {r["passengers"]: (r["alight_seq"], r["alight_ars"], r["alight_name"]) for r in od_cleaning.same_stops(od(spark, rows)).collect()}
    assert got[5] == (2, "01002", "B2") and got[7] == (None, None, "A")


def test_correction_conserves_passengers(spark):
    raw = views(spark, SF)("raw_od")
    after, aside = od_cleaning.correct(raw)
    od_cleaning.assert_conserved(raw, after, aside)
    with pytest.raises(ValueError):
        od_cleaning.assert_conserved(raw, after.where("passengers != 7 or passengers is null"), aside)


def test_legs_on_a_loop(spark):
    stations = spark.createDataFrame([("7", "7|A", s, a) for s, a in enumerate(["1", "2", "3", "4", "2", "5"], 1)], "route string, variant string, seq int, ars string")
    legs = [("7", "2", "5", None, None, 1.0), ("7", "00002", "00005", 2, 6, 2.0), ("7", "1", "2", None, None, 4.0), ("7", None, "3", 0, 3, 8.0), ("7", "5", "1", 6, 1, 16.0), ("9", "1", "2", 1, 2, 32.0)]
    df = spark.createDataFrame(legs, "route string, board_ars string, alight_ars string, board_seq int, alight_seq int, passengers double")
    got = {r["passengers"]: (r["from_at"], r["to_at"]) for r in route_load.place(df, stations).collect()}
    assert got == {1.0: (4, 5), 2.0: (1, 5), 4.0: (0, 1), 8.0: (0, 2), 16.0: (None, None), 32.0: (None, None)}


def test_least_squares_equals_numpy(spark):
    rng = np.random.default_rng(1)
    months = list(range(200001, 200013))
    a = rng.integers(3, 6, (12, 7))
    counts = spark.createDataFrame([(m, *map(int, row)) for m, row in zip(months, a)], "use_ym int, " + ", ".join(f"{d} int" for d in DAY_TYPES))
    seen = {"x": months, "y": months[:4], "z": months[2:11], "few": months[:2]}
    values = [(k, m, float(v)) for k, ms in seen.items() for m, v in zip(ms, rng.integers(0, 900, len(ms)))]
    got = {}
    for r in hourly.solve(counts, spark.createDataFrame(values, "k string, use_ym int, b double"), ["k"], "b", list(DAY_TYPES), clip=False).collect():
        got.setdefault(r["k"], {})[r["day_type"]] = r["x"]
    assert got.keys() == {"x", "y", "z"}
    for k, x in got.items():
        rows = [months.index(m) for m in seen[k]]
        want = np.linalg.lstsq(a[rows].astype(float), np.array([v for kk, _, v in values if kk == k]), rcond=None)[0]
        assert [x[d] for d in DAY_TYPES] == pytest.approx(list(want), rel=1e-8, abs=1e-8)


def test_spread_keeps_totals_and_names_the_method(spark):
    trips = spark.createDataFrame([("a", "1", 10.0), ("a", "2", 5.0), ("b", "1", 3.0)], "route string, ars string, passengers double")
    profiles = spark.createDataFrame([("a", "1", h, 1.0 if h == 8 else 0.0) for h in range(24)] + [("a", "2", h, 0.0) for h in range(24)], "route string, ars string, hour int, ratio double")
    rows = hourly.spread(trips, profiles).groupBy("route", "ars", "method").agg(F.sum("hourly").alias("s"), F.count("*").alias("n"), F.max_by("hour", "hourly").alias("top")).collect()
    assert {(r["route"], r["ars"]): (r["method"], round(r["s"], 9), r["n"], r["top"]) for r in rows} == {("a", "1"): (hourly.FITTED, 10.0, 24, 8), ("a", "2"): (hourly.ZERO_FIT, 5.0, 24, 7), ("b", "1"): (hourly.NO_KEY, 3.0, 24, 7)}


def test_points_and_polygons(spark):
    triangle = F.array(*[F.struct(F.lit(x).alias("lng"), F.lit(y).alias("lat")) for x, y in ((0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0))])
    points = [(1.0, 1.0, True, True), (2.0, 2.0, True, False), (0.0, 1.0, True, False), (3.0, 3.0, False, False), (0.0, 0.0, True, False)]
    df = spark.createDataFrame([p[:2] for p in points], "lng double, lat double")
    got = df.select(geo.covers(F.col("lng"), F.col("lat"), triangle), geo.contains(F.col("lng"), F.col("lat"), triangle)).collect()
    assert [tuple(r) for r in got] == [p[2:] for p in points]
    assert df.limit(1).select(geo.is_valid_ring(triangle)).first()[0]


def test_bad_days_fail(spark):
    df = spark.createDataFrame([("23/10/17",), ("2023-10-17",), ("20231017",), ("231017",)], "t string")
    assert {r[0] for r in df.select(parse_day_strict(F.col("t"))).collect()} == {"231017"}
    with pytest.raises(Exception, match="no day"):
        spark.createDataFrame([("17th",)], "t string").select(parse_day_strict(F.col("t"))).collect()


def test_poisson_floor(spark):
    got = quality.poisson_floor(spark.createDataFrame([(1, 3.0), (1, 4.0), (2, 0.0)], "k int, v double"), ["k"], "v").orderBy("k").collect()
    want = sum(abs(x - 3.5) * np.exp(-3.5) * 3.5**x / np.prod(np.arange(1.0, x + 1)) for x in range(60))
    assert got[0]["floor"] == pytest.approx(want, rel=1e-9) and got[1]["floor"] == 0.0


def test_model_learns(spark):
    _, scores = models.train(models.features(views(spark, SF)("daily")), rounds=3)
    assert scores["mae"] > 0


def test_delimited_files_and_zips(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_bytes("노선,승객\n강남,1\n,2\n".encode("cp949"))
    (tmp_path / "csv" / "b.csv").write_bytes("노선,승객\n한강,3\n".encode("utf-8-sig"))
    rows = files.read_delimited(spark, str(tmp_path / "csv"), ["노선", "승객"]).collect()
    assert sorted(map(tuple, rows), key=str) == [("강남", "1"), ("한강", "3"), (None, "2")]
    with pytest.raises(Exception, match="columns"):
        files.read_delimited(spark, str(tmp_path / "csv"), ["x"]).collect()
    (tmp_path / "zip").mkdir()
    with zipfile.ZipFile(tmp_path / "zip" / "x.zip", "w") as z:
        z.writestr("OD_20240101.csv", "a")
        z.writestr("readme.txt", "b")
    assert [(r["member"], bytes(r["content"])) for r in files.zip_members(spark, str(tmp_path / "zip"), r"OD_\d{8}\.csv").collect()] == [("OD_20240101.csv", b"a")]


def test_exports_are_checked(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", 2.0)], "k string, v double")
    files.write_export(df, f"{tmp_path}/e", ["v"])
    assert files.read_export(spark, f"{tmp_path}/e", ["k"], ["v"]).count() == 2
    df.limit(1).write.mode("append").parquet(f"{tmp_path}/e/data")
    with pytest.raises(ValueError):
        files.read_export(spark, f"{tmp_path}/e", ["k"], ["v"])


def test_snapshots_partitions_and_upserts(spark, tmp_path):
    root = f"{tmp_path}/t"
    sinks.publish(spark.range(3).toDF("k"), root)

    def refuse(df):
        raise ValueError("no")

    with pytest.raises(ValueError):
        sinks.publish(spark.range(9).toDF("k"), root, refuse)
    assert sinks.current(spark, root).count() == 3
    sinks.replace_partitions(spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "p int, v int"), f"{tmp_path}/p", "p")
    sinks.replace_partitions(spark.createDataFrame([(2, 9)], "p int, v int"), f"{tmp_path}/p", "p")
    assert sorted((r["p"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/p").collect()) == [(1, 1), (1, 2), (2, 9)]
    with pytest.raises(ValueError):
        sinks.upserted(spark.range(2).toDF("k"), spark.createDataFrame([(1,), (1,)], "k long"), ["k"])


def test_paged_service(spark):
    def fetch(first, last):
        rows = "".join(f"<row><NUM>{i}</NUM>{'<NAME>n</NAME>' if i % 2 else '<ALIAS>m</ALIAS>'}</row>" for i in range(first, last + 1))
        return f"<r><RESULT><CODE>INFO-000</CODE></RESULT>{rows}</r>"

    source = paged_api.page_source("headway_test_pages", fetch, {"num": ("NUM",), "name": ("NAME", "ALIAS")}, 2500)
    got = paged_api.read_pages(spark, source)
    assert got.rdd.getNumPartitions() == 3 and got.count() == 2500 and {r["name"] for r in got.select("name").distinct().collect()} == {"n", "m"}
    with pytest.raises(paged_api.NotPublished):
        paged_api.checked("<RESULT><CODE>INFO-200</CODE></RESULT>")
    with pytest.raises(paged_api.ServiceError, match=r"\*\*\*"):
        paged_api.checked("<r><RESULT><CODE>ERROR-1</CODE><MESSAGE>key abc is bad</MESSAGE></RESULT></r>", "abc")
    with pytest.raises(paged_api.ServiceError):  # pages that succeed have a result
        paged_api.checked("<r><list_total_count>0</list_total_count></r>")
