"""Node search, route votes, committed batches, ring validity and predictions against hand-made cases."""

import pytest
from pyspark.sql import functions as F

from headway.functions import geo, numbers
from headway.operators import demand, hourly, lookups, models
from headway.sources import files
from headway.streaming import monthly

PLACE = "name string, lat double, lng double"


def test_search_finds_stations_stops_and_outer_nodes(spark):
    subway = spark.createDataFrame([("Seoul", 1.0, 1.0), ("Seoul", 3.0, 1.0), ("100% Mall", 1.0, 1.0)], PLACE)
    bus = spark.createDataFrame([("1001", "seoul gate", 1.0, 2.0), ("01001", "Seoul Gate", 3.0, 2.0), ("22", "else", 0.0, 0.0)], f"ars string, {PLACE}")
    outer = spark.createDataFrame([("c1", "31001", "Seoul Road", 5.0, 5.0), ("c2", "31002", "Seoul Road", 7.0, 5.0), ("c3", "1001", "Seoul Copy", 9.0, 9.0)], f"canonical string, ars string, {PLACE}")
    mapping = spark.createDataFrame([("c1", "300"), ("c2", "300"), ("c3", "1001")], "canonical string, node string")
    find = lambda text: [(r["mode"], r["node"], r["name"], r["lat"]) for r in demand.found_nodes(text, subway, bus, outer, mapping).collect()]
    assert find("Seoul") == [("subway", "Seoul", "Seoul", 2.0), ("bus", "01001", "Seoul Gate", 2.0), ("bus", "00300", "Seoul Road", 6.0)]
    assert find("00300") == [("bus", "00300", "Seoul Road", 6.0)] and find("%") == [("subway", "100% Mall", "100% Mall", 1.0)]
    assert find("1001")[0][1] == "01001" and find("nothing") == []


def test_votes_for_routes(spark):
    rows = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("r", "b", 2), ("r", None, 3), ("s", "a", 1), (None, "a", 1), ("t", "z", 9)], "route string, name string, seq int")
    reference = spark.createDataFrame([("1", "a", 1), ("2", "a", 1), ("2", "b", 2), ("2", "b", 2), (None, "a", 1)], "id string, name string, seq int")
    got = {r["route"]: (r["id"], r["votes"]) for r in lookups.voted(rows, reference, "route", "id", ["name", "seq"]).collect()}
    assert got == {"r": ("2", 2), "s": ("1", 1)}


def test_batches_are_committed_in_order_and_resumed(spark, tmp_path):
    rows = spark.range(100).withColumn("v", F.col("id") * 2)
    ledger = monthly.Ledger(spark, f"{tmp_path}/ledger")
    assert ledger.committed() == 0
    with pytest.raises(ValueError, match="out of order"):
        ledger.commit(1)
    assert monthly.write_in_batches(rows, F.col("id") % 5, 5, f"{tmp_path}/out", ledger, 1) == 2
    # a batch that was written but not entered, as when a run is cut off
    spark.range(7).write.parquet(f"{tmp_path}/out/batch=2")
    assert monthly.write_in_batches(rows, F.col("id") % 5, 5, f"{tmp_path}/out", ledger) == 3
    assert monthly.write_in_batches(rows, F.col("id") % 5, 5, f"{tmp_path}/out", ledger) == 0
    for again in (0, 4, 9):
        with pytest.raises(ValueError, match="out of order"):
            ledger.commit(again)
    got = spark.read.schema("id long, v long").parquet(f"{tmp_path}/out")
    assert sorted((r["id"], r["v"]) for r in got.collect()) == [(i, 2 * i) for i in range(100)]


def test_rings(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    cases = {
        True: [square, square[::-1], [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)], [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0), (0.0, 0.0)]],
        False: [square[:-1], [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0), (0.0, 0.0)], [(0.0, 0.0), (181.0, 0.0), (0.0, 1.0), (0.0, 0.0)], [], None, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 0.0), (0.0, 4.0), (0.0, 0.0)]],
    }
    rows = [(good, None if r is None else [{"lng": x, "lat": y} for x, y in r]) for good, rings in cases.items() for r in rings]
    df = spark.createDataFrame(rows, "good boolean, ring array<struct<lng:double,lat:double>>")
    assert [(r[0], r[1]) for r in df.select("good", geo.is_valid_ring(F.col("ring"))).collect()] == [(g, g) for g, _ in rows]


def test_fixed_scales_pattern_sums_and_scores(spark):
    df = spark.createDataFrame([(10.0, 7, 9, True), (10.0, 7, 9, False), (0.0, 7, 9, True), (10.0, None, 9, True)], "m double, a int, b int, f boolean")
    assert [r[0] for r in df.select(numbers.fixed_scale(F.col("m"), F.col("a"), F.col("b"), F.col("f"))).collect()] == [30.0, None, None, None]
    sums = spark.createDataFrame([("r", k, x) for k, xs in {"ok": [0.4, 0.6], "off": [0.5, 0.6], "zero": [0.0, 0.0], "near": [0.5, 0.505]}.items() for x in xs], "route string, ars string, ratio double")
    assert tuple(hourly.pattern_sums(sums, ["route", "ars"], ["route"]).first()) == ("r", 4, 1, 1)
    scored = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 3.0)], "boardings double, prediction double")
    got = models.scores(scored)
    assert (got["mae"], got["rmse"], got["r2"]) == pytest.approx((1.0, (5 / 3) ** 0.5, 1 - 5 / 8))
    assert got["log_mae"] > 0 and models.scores(scored.withColumn("prediction", F.col("boardings")))["log_r2"] == 1


def test_one_delimited_file_is_read_by_several_tasks(spark, tmp_path):
    for name, encoding, text in (("a.csv", "cp949", "강남"), ("b.csv", "utf-8-sig", "한강"), ("c.csv", "utf-8", "plain")):
        lines = ["name,n", *[f"{text}{i},{i}" if i % 7 else f',"{i},x"' for i in range(3000)]]
        (tmp_path / name).write_bytes("\n".join(lines).encode(encoding))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = files.read_delimited(spark, str(tmp_path), ["name", "n"])
        assert df.rdd.getNumPartitions() > 8
        got = sorted(map(tuple, df.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted([(f"{t}{i}", str(i)) if i % 7 else (None, f"{i},x") for t in ("강남", "한강", "plain") for i in range(3000)], key=str)
    assert sorted(map(tuple, files.read_delimited(spark, str(tmp_path), ["name", "n"], multiline=True).collect()), key=str) == got
    (tmp_path / "d.csv").write_bytes(b"name,n\n\xff\xff\xff,1\n")
    with pytest.raises(Exception, match="in none of"):
        files.read_delimited(spark, str(tmp_path), ["name", "n"])
