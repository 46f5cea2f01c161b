"""Steps whose work must not grow faster than their input."""

from pyspark.sql import functions as F

from headway.operators import ferry, od_cleaning, route_load
from headway.plans import catalogue
from headway.plans.views import views
from headway.sources import files, paged_api

SF = "/root/testdata/sf0.001"


def test_cleaning_moves_rows_once(spark):
    after, _ = od_cleaning.correct(views(spark, SF)("raw_od"))
    assert after._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_lookups_of_cleaning_leave_rows_without_a_day_or_route(spark):
    rows = [(d, r, s, "00001", a, "00002", p) for d, r in (("2026-04-01", "r"), ("2026-04-01", None), (None, "r")) for s, a, p in ((3, 8, 1), (3, 9, 2), (4, 9, 3), (None, 9, 4))]
    df = spark.createDataFrame(rows, "service_date string, route string, board_seq int, board_ars string, alight_seq int, alight_ars string, passengers int")
    got = {(r["service_date"], r["route"], r["passengers"]): (r["board_seq"], r["alight_seq"]) for r in od_cleaning.sequences(df).collect()}
    assert [got["2026-04-01", "r", p] for p in (1, 2, 3, 4)] == [(3, 8), (3, 8), (3, 8), (None, 9)]
    for d, r in (("2026-04-01", None), (None, "r")):
        assert [got[d, r, p] for p in (1, 2, 3, 4)] == [(3, 8), (3, 9), (4, 9), (None, 9)]


def test_pages_are_parsed_once(spark):
    pages = [("<RESULT><CODE> INFO-200 </CODE><MESSAGE>none | yet</MESSAGE></RESULT>",), ("<a><RESULT><MESSAGE>k1 is k1</MESSAGE></RESULT></a>",), ("<a><RESULT><CODE>INFO-000</CODE></RESULT></a>",), ("<a/>",), (None,)]
    df = paged_api.result_states(spark.createDataFrame(pages, "xml string"), key="k1")
    assert df._jdf.queryExecution().optimizedPlan().toString().count(".evaluate(xml") == 1
    assert [(r["state"], r["message"]) for r in df.collect()] == [("not_published", "none | yet"), ("error", "*** is ***"), ("ok", ""), ("error", ""), ("error", None)]


def test_numbers_are_checked_once_a_stop(spark):
    assert any("boarders-" in f for f in catalogue.QUERIES["dom_hourly_share"](spark, SF).inputFiles())


def test_lines_are_decoded_by_the_batch(spark, tmp_path, monkeypatch):
    """A row of odd lines in either encoding, and no reader of its own for a line without quotes."""
    import csv

    text = "name,n\r\n\n강남,1\n\ufeff한강,\n\"a, \"\"b\"\"\",2\nplain\n"
    (tmp_path / "a.csv").write_bytes(("\ufeff" + text).encode())
    (tmp_path / "b.csv").write_bytes(text.replace("\ufeff", "").encode("cp949"))
    want = [("강남", "1"), ("한강", None), ('a, "b"', "2"), ("plain", None)]
    assert sorted(map(tuple, files.read_delimited(spark, str(tmp_path), ["name", "n"]).collect()), key=str) == sorted(want * 2, key=str)
    seen = []
    reader = csv.reader
    monkeypatch.setattr(csv, "reader", lambda *a, **k: seen.append(1) or reader(*a, **k))
    lines = ["강남,1".encode(), b"", b"x,2", b'"y,",3'] * 50
    assert files.parsed(lines, "utf-8-sig", ",", False) == [["강남", "1"], ["x", "2"], ["y,", "3"]] * 50
    assert len(seen) == 50


def test_names_of_piers_are_made_once(spark):
    name = F.concat(F.lit("pier "), F.col("id").cast("string"))
    rows = spark.range(9).select(F.lit("2026-04-01").cast("date").alias("service_date"), F.lit(None).cast("string").alias("route"), name.alias("board_name"), name.alias("alight_name"),
                                 *[F.lit(None).cast(t).alias(f"{s}_{c}") for s in ("board", "alight") for c, t in (("seq", "int"), ("ars", "string"))], F.lit(1).alias("passengers"))
    trips = ferry.corrected(rows).where("kind in ('ferry', 'same_pier')").select("board_name", "alight_name")
    assert trips._jdf.queryExecution().optimizedPlan().toString().count("concat(pier") <= 2  # one for each side


def test_legs_that_cross_a_segment_twice_are_one_row(spark):
    stations = spark.createDataFrame([("7", "7|A", s, a) for s, a in enumerate(["00001", "00002", "00003", "00001", "00002", "00005"], 1)] + [("8", "8|A", 1, "00001"), ("8", "8|A", 2, "00009")], "route string, variant string, seq int, ars string")
    legs = [("7", 1, "00001", 6, "00005", 1.0), ("7", 2, "00002", 3, "00003", 2.0), ("7", 3, "00003", 5, "00002", 4.0), ("8", 1, "00001", 2, "00009", 8.0)]
    df = spark.createDataFrame(legs, "route string, board_seq int, board_ars string, alight_seq int, alight_ars string, passengers double")
    got = route_load.legs_crossing(df, stations, "00001", "00002").collect()
    assert sorted(r["passengers"] for r in got) == [1.0, 4.0]  # a leg that passes the segment twice is one row
