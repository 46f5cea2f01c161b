"""Files in older encodings, archives, stored pages, lists of holidays and the days of months."""

import datetime as dt

import pytest

from headway.operators import hourly, lookups
from headway.sources import files, paged_api, sinks


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_encoded_files_come_back(spark, tmp_path):
    data = [("강남", 'a "quoted", name'), (None, "2"), ("한강", ""), ("plain", None)]
    df = spark.createDataFrame(data, "name string, n string")
    sinks.write_encoded(df.repartition(3), f"{tmp_path}/cp949", "cp949")
    assert rows(files.read_delimited(spark, f"{tmp_path}/cp949", ["name", "n"])) == sorted([("강남", 'a "quoted", name'), (None, "2"), ("한강", None), ("plain", None)], key=str)
    assert "강남".encode("cp949") in b"".join(p.read_bytes() for p in (tmp_path / "cp949").glob("part-*"))
    sinks.write_encoded(df.limit(0), f"{tmp_path}/none", "cp949")
    assert files.read_delimited(spark, f"{tmp_path}/none", ["name", "n"]).count() == 0
    with pytest.raises(Exception, match="can't encode"):
        sinks.write_encoded(spark.createDataFrame([("😀",)], "name string"), f"{tmp_path}/bad", "cp949")


def test_archives_keep_every_byte(spark, tmp_path):
    data = [("a", "x.csv", b"1\n2\n"), ("a", "노선.csv", bytes(range(256))), ("b", "x.csv", b""), ("b", "empty\n", b"\n")]
    df = spark.createDataFrame([(a, m, bytearray(c)) for a, m, c in data], "archive string, member string, content binary")
    files.write_archives(df, f"{tmp_path}/z")
    got = files.zip_members(spark, f"{tmp_path}/z")
    assert sorted((r["archive"].split("archive=")[1][0], r["member"], bytes(r["content"])) for r in got.collect()) == sorted(data)
    assert [r["member"] for r in files.zip_members(spark, f"{tmp_path}/z", "^노선").collect()] == ["노선.csv"]
    with pytest.raises(Exception, match="twice"):
        files.write_archives(df.union(df), f"{tmp_path}/twice")


def test_rows_of_stored_pages(spark):
    ok = "<r><RESULT><CODE>INFO-000</CODE></RESULT><row><A>1</A><B>x</B></row><row><C>2</C></row></r>"
    none, empty = "<RESULT><CODE>INFO-200</CODE></RESULT>", "<r><RESULT><CODE>INFO-000</CODE></RESULT></r>"
    pages = spark.createDataFrame([(1, ok), (2, none), (3, empty)], "page int, xml string")
    assert rows(paged_api.stored_rows(pages, {"a": ("C", "A"), "b": ("B",)})) == [("1", "x"), ("2", None)]
    assert paged_api.stored_rows(pages.limit(0), {"a": ("A",)}).count() == 0
    with pytest.raises(Exception, match=r"ERROR-1: key \*\*\* is bad"):
        paged_api.stored_rows(spark.createDataFrame([("<r><RESULT><CODE>ERROR-1</CODE><MESSAGE>key abc is bad</MESSAGE></RESULT></r>",)], "xml string"), {"a": ("A",)}, key="abc").count()
    with pytest.raises(Exception, match="no result"):
        paged_api.stored_rows(spark.createDataFrame([(None,)], "xml string"), {"a": ("A",)}).count()


def test_last_line_of_a_holiday_counts(spark):
    lines = [(1, " 2024-01-01 ", "old"), (2, "2024-01-01", " new "), (3, None, "x"), (4, "", "x"), (5, "2024-02-30", "x"), (6, "2024-05-05", None)]
    got = rows(lookups.holidays(spark.createDataFrame(lines, "line long, day string, name string")))
    assert got == [(dt.date(2024, 1, 1), "new"), (dt.date(2024, 5, 5), None)]


def test_days_of_months(spark):
    months = spark.createDataFrame([(202402,), (202402,), (199912,), (None,)], "use_ym int")
    days = [r["day"] for r in hourly.month_days(months).collect()]
    assert len(days) == 60 and len(set(days)) == 60 and min(days) == dt.date(1999, 12, 1) and max(days) == dt.date(2024, 2, 29)
