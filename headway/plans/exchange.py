"""Queries that write to a new folder of the shared ones and read back: sources, sinks and incremental loading."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranks
from ..sources import files, paged_api, sinks
from ..streaming import monthly
from .views import query

C = F.col
_OD = ["service_date", "route", "board_ars", "alight_ars", "board_name", "passengers"]
_OD_TEXT = "CAST(service_date AS STRING) AS service_date, route, board_ars, alight_ars, board_name, CAST(passengers AS STRING) AS passengers"


def _od_text(v):
    return v("raw_od").select(*[C(c).cast("string").alias(c) for c in _OD])


def _folder(df, name):
    return files.work_folder(df.sparkSession, name)


@query("snk_csv_out", f"SELECT {_OD_TEXT} FROM raw_od")
def _(v):
    rows = _od_text(v)
    path = _folder(rows, "csv")
    sinks.write_delimited(rows, path)
    return rows.sparkSession.read.schema(", ".join(f"{c} string" for c in _OD)).option("header", True).option("sep", "|").option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


@query("src_csv_strict", "SELECT route, count(*) AS n, CAST(count(board_ars) AS BIGINT) AS stops, CAST(sum(passengers) AS BIGINT) AS passengers FROM raw_od GROUP BY route")
def _(v):
    rows = _od_text(v)
    path = _folder(rows, "strict")
    sinks.write_delimited(rows, path, ",", None)
    read = files.read_delimited(rows.sparkSession, path, _OD)
    return read.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.count("board_ars").alias("stops"), F.sum(C("passengers").cast("long")).alias("passengers"))


@query("src_csv_od", f"SELECT {_OD_TEXT} FROM raw_od")
def _(v):
    rows = _od_text(v)
    path = _folder(rows, "od")
    sinks.write_delimited(rows, path, "|", None)
    return files.read_delimited(rows.sparkSession, path, _OD, "|")


@query("src_csv_flexible", f"SELECT {_OD_TEXT} FROM raw_od")
def _(v):
    """Days before 1995 in UTF-8, the rest and those without a day in cp949; each file is read in the encoding that decodes it."""
    rows = _od_text(v)
    root, early = _folder(rows, "flexible"), F.coalesce(C("service_date") < "1995", F.lit(False))
    sinks.write_delimited(rows.where(early), f"{root}/utf8", ",", None)
    sinks.write_encoded(rows.where(~early), f"{root}/cp949", "cp949")
    return files.read_delimited(rows.sparkSession, f"{root}/*", _OD)


@query("src_multi_csv_concat", "SELECT route, board_ars, sum(passengers) AS passengers FROM typical GROUP BY route, board_ars")
def _(v):
    rows = v("typical").select("route", "board_ars", C("passengers").cast("string").alias("passengers"))
    root = _folder(rows, "parts")
    sinks.write_delimited(rows.where("board_ars < '00150'"), f"{root}/a", ",", None)
    sinks.write_delimited(rows.where("board_ars >= '00150'"), f"{root}/b", ",", None)
    return files.summed_folders(rows.sparkSession, [f"{root}/a", f"{root}/b"], ["route", "board_ars", "passengers"], ["route", "board_ars"], ["passengers"])


@query("src_zip_members", "SELECT service_date AS day, route, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(passengers AS INT)) AS BIGINT) AS passengers FROM leg GROUP BY service_date, route")
def _(v):
    """The trips of a day and 20 routes are a member of their year's archive; read back are the members of a day's name."""
    legs = v("leg").withColumns({"archive": F.concat_ws("-", F.year("service_date"), F.floor(F.substring("route", 2, 9).cast("int") / 20)), "member": F.concat(F.lit("노선별OD_"), F.date_format("service_date", "yyyyMMdd"), F.lit(".csv"))})
    text = F.array_join(F.collect_list(F.concat_ws(",", "route", C("passengers").cast("int"))), "\n")
    days = legs.groupBy("archive", "member").agg(F.encode(text, "UTF-8").alias("content"))
    other = legs.select("archive", F.lit("readme.txt").alias("member"), F.encode(F.lit("one file a day"), "UTF-8").alias("content")).distinct()
    path = _folder(legs, "zips")
    files.write_archives(days.unionByName(other), path)
    read = files.zip_members(legs.sparkSession, path, r"^노선별OD_\d{8}\.csv$")
    lines = read.select(F.to_date(F.regexp_extract("member", r"(\d{8})", 1), "yyyyMMdd").alias("day"), F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line"))
    parts = lines.select("day", F.split_part("line", F.lit(","), F.lit(1)).alias("route"), F.split_part("line", F.lit(","), F.lit(2)).cast("long").alias("p"))
    return parts.groupBy("day", "route").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("passengers"))


@query("src_manifest", "SELECT route, board_ars, alight_ars, board_seq, alight_seq, passengers FROM typical")
def _(v):
    keys = ["route", "board_ars", "alight_ars", "board_seq", "alight_seq"]
    rows = v("typical").select(*keys, "passengers")
    path = _folder(rows, "export")
    files.write_export(rows, path, ["passengers"])
    return files.read_export(rows.sparkSession, path, keys, ["passengers"])


@query("src_xml_api", "SELECT CAST(use_ym AS STRING) AS use_ym, route, ars, CAST(h AS INT) AS hour, coalesce(sum(boardings) FILTER (WHERE hour = h), 0e0) AS riders FROM boarding_month, (SELECT unnest(range(24)) AS h) GROUP BY use_ym, route, ars, h")
def _(v):
    """Stored pages of the service, a column per hour; some rows have their stop under its older tag."""
    hours = {h: files.api_hour_column(h) for h in range(24)}
    month = v("boarding_month")
    wide = month.groupBy("use_ym", "route", "ars").agg(*[F.sum(F.when(C("hour") == h, C("boardings").cast("long"))).alias(c) for h, c in hours.items()])
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value.cast("string"), F.lit(f"</{name}>"))
    stop = F.when(C("use_ym") % 2 == 1, tag("ARS", C("ars"))).otherwise(tag("STOP_ARS", C("ars")))
    row = F.concat(F.lit("<row>"), tag("USE_YM", C("use_ym")), tag("ROUTE", C("route")), stop, *[F.coalesce(tag(c, C(c)), F.lit("")) for c in hours.values()], F.lit("</row>"))
    numbered = ranks.placed(wide.select("use_ym", "route", "ars", row.alias("row")), [C("use_ym"), C("route"), C("ars")])
    rows = F.array_join(F.collect_list("row"), "")
    pages = numbered.groupBy(F.floor(C("place") / paged_api.PAGE_ROWS).alias("page")).agg(F.concat(F.lit(f"<list><RESULT><CODE>{paged_api.OK}</CODE></RESULT>"), rows, F.lit("</list>")).alias("xml"))
    read = paged_api.stored_rows(pages, {"use_ym": ("USE_YM",), "route": ("ROUTE",), "ars": ("STOP_ARS", "ARS")} | {c: (c,) for c in hours.values()})
    return files.wide_to_long(read, ["use_ym", "route", "ars"], files.hour_columns(read.columns))


@query("src_route_api", "SELECT route, CASE WHEN rn % 4 = 0 THEN route || '|' || route || x ELSE route END AS variant FROM (SELECT DISTINCT route, CAST(substr(route, 2) AS INT) AS rn FROM route_stop) r, (VALUES ('A'), ('B')) t(x) WHERE (rn % 4 = 0 OR x = 'A') AND rn % 8 < 6")
def _(v):
    """Listed names of each route: an exact name, or else its lettered variants; the day's quota covers the stalest routes."""
    routes = v("route_stop").select("route").distinct().withColumn("rn", F.substring("route", 2, 9).cast("int"))
    names = F.when(C("rn") % 4 == 0, F.array(F.concat("route", F.lit("A")), F.concat("route", F.lit("B")), F.concat("route", F.lit("XY")), F.concat("route", F.lit("A")))).otherwise(F.array("route", F.concat("route", F.lit("A"))))
    listed = routes.select("route", F.explode(names).alias("name"))
    stale = routes.select("route", (C("rn") % 8).alias("fetched"))
    calls = paged_api.within_quota(stale, "fetched", 3, 3 * stale.where("fetched < 6").count() + 2)
    return paged_api.route_variants(listed.join(calls, "route", "left_semi")).select("route", "variant")


@query("snk_copy", "SELECT stop, CAST(count(*) AS BIGINT) AS days, sum(boardings) AS boardings FROM daily GROUP BY stop")
def _(v):
    daily = v("daily")
    path = _folder(daily, "append")
    sinks.append(daily.where("day < '1998-01-01'"), path)
    sinks.append(daily.where("day >= '1998-01-01'"), path)
    return daily.sparkSession.read.schema(daily.schema).parquet(path).groupBy("stop").agg(F.count(F.lit(1)).alias("days"), F.sum("boardings").alias("boardings"))


@query("snk_copy_upsert", "SELECT stop, day, CASE WHEN stop % 10 = 1 THEN boardings * 2 ELSE boardings END AS boardings FROM daily")
def _(v):
    """A batch is written first, its keys are checked, and then it is merged."""
    daily = v("daily")
    path = _folder(daily, "stage")
    sinks.append(daily.where("stop % 10 = 1").withColumn("boardings", C("boardings") * 2), path)
    return sinks.upserted(daily, daily.sparkSession.read.schema(daily.schema).parquet(path), ["stop", "day"])


@query("snk_shadow_swap", "SELECT stop, day, boardings FROM daily WHERE stop % 2 = 1")
def _(v):
    """Two published snapshots and one whose check fails: the second is current."""
    daily = v("daily")
    root = _folder(daily, "published")
    sinks.publish(daily.where("stop % 2 = 0"), root)
    sinks.publish(daily.where("stop % 2 = 1"), root)

    def refuse(df):
        raise ValueError("no")

    try:
        sinks.publish(daily, root, refuse)
    except ValueError:
        pass
    return sinks.current(daily.sparkSession, root)


@query("dom_replace_range", "SELECT year, CAST(count(*) AS BIGINT) AS n, sum(boardings) AS boardings FROM (SELECT year(day) AS year, CASE WHEN year(day) = 1997 THEN boardings + 1 ELSE boardings END AS boardings FROM daily) GROUP BY year")
def _(v):
    """One year is estimated again: its rows are replaced and the others stay."""
    years = v("daily").withColumn("year", F.year("day"))
    path = _folder(years, "years")
    sinks.replace_partitions(years, path, "year")
    sinks.replace_partitions(years.where("year = 1997").withColumn("boardings", C("boardings") + 1), path, "year")
    read = years.sparkSession.read.parquet(path)
    return read.groupBy(C("year").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum("boardings").alias("boardings"))


@query("src_psql_copy", "SELECT ars, lng, lat, lng || ' ' || lat AS spot FROM (SELECT ars, CAST(printf('%.4f', lng) AS STRING) AS lng, CAST(printf('%.4f', lat) AS STRING) AS lat FROM stop_point)")
def _(v):
    stops = v("stop_point").select("ars", F.format_string("%.4f", C("lng").cast("double")).alias("lng"), F.format_string("%.4f", C("lat").cast("double")).alias("lat"))
    return sinks.reloaded(stops, _folder(stops, "reload"), spot=F.concat_ws(" ", "lng", "lat"))


@query("snk_markdown", "SELECT '| ' || route || ' | ' || CAST(CAST(sum(passengers) AS BIGINT) AS STRING) || ' |' AS line FROM typical GROUP BY route UNION ALL SELECT '| route | riders |' UNION ALL SELECT '|---|---:|'")
def _(v):
    return sinks.markdown(v("typical").groupBy("route").agg(F.sum("passengers").alias("riders")), ["route"])


@query("snk_js_csv", "SELECT 'segment' AS type, route AS from_ars, board_ars AS to_ars, CAST(NULL AS STRING) AS ars, sum(passengers) AS riders FROM typical GROUP BY route, board_ars UNION ALL SELECT 'origin', NULL, NULL, board_ars, sum(passengers) FROM typical GROUP BY board_ars")
def _(v):
    loads = v("typical").groupBy(C("route").alias("from_ars"), C("board_ars").alias("to_ars")).agg(F.sum("passengers").alias("load"))
    ends = v("typical").groupBy(C("board_ars").alias("ars")).agg(F.sum("passengers").alias("riders")).withColumn("type", F.lit("origin"))
    rows = sinks.road_rows(loads, ends)
    path = _folder(rows, "road")
    sinks.write_delimited(rows, path, ",", None)
    return rows.sparkSession.read.schema(rows.schema).option("header", True).csv(path)


_MONTHS = "SELECT use_ym, route, ars, hour, sum(boardings) AS boardings FROM boarding_month WHERE {0} GROUP BY use_ym, route, ars, hour"


def _put_months(rows, root: str, unfinished=lambda ym: False):
    """Every month of the rows in its folder, and the manifests of those that are finished, written last."""
    spark = rows.sparkSession
    rows.withColumn("ym", C("use_ym")).write.partitionBy("ym").parquet(f"{root}/arrived")
    months = sorted(int(n.removeprefix("ym=")) for n in files.names_in(spark, f"{root}/arrived") if n.startswith("ym="))
    for ym in months:
        files.move(spark, f"{root}/arrived/ym={ym}", f"{root}/in/ym={ym}/data")
        if not unfinished(ym):
            files.put_text(spark, f"{root}/in/ym={ym}/manifest.json", f'{{"ym": {ym}}}')


def _run(spark, root: str):
    monthly.load_finished_months(spark, f"{root}/in", f"{root}/out", f"{root}/state").awaitTermination()


@query("str_manifest_last", _MONTHS.format("use_ym % 3 <> 1"))
def _(v):
    """All months, of which every third was interrupted before its manifest."""
    month = v("boarding_month")
    root = _folder(month, "months")
    _put_months(month, root, lambda ym: ym % 3 == 1)
    _run(month.sparkSession, root)
    return month.sparkSession.read.parquet(f"{root}/out").select("use_ym", "route", "ars", "hour", "boardings")


@query("str_catch_up", _MONTHS.format("true"))
def _(v):
    """A first run loads the months up to 1998; a later one finds those that came since, and a third finds nothing."""
    month = v("boarding_month")
    root = _folder(month, "catchup")
    for part in ("use_ym <= 199812", "use_ym > 199812", None):
        if part:
            _put_months(month.where(part), f"{root}/{len(part)}", lambda ym: True)
            for name in files.names_in(month.sparkSession, f"{root}/{len(part)}/in"):
                files.move(month.sparkSession, f"{root}/{len(part)}/in/{name}", f"{root}/in/{name}")
                files.put_text(month.sparkSession, f"{root}/in/{name}/manifest.json", name)
        _run(month.sparkSession, root)
    return month.sparkSession.read.parquet(f"{root}/out").select("use_ym", "route", "ars", "hour", "boardings")


@query("str_resume", "SELECT use_ym, route, ars, hour, boardings, visit FROM boarding_month")
def _(v):
    """Batches of twelve months; the run ends after the third, and a second one resumes at the first that isn't committed."""
    month = v("boarding_month")
    spark, root = month.sparkSession, _folder(month, "resume")
    ledger = monthly.Ledger(spark, f"{root}/ledger")
    number = C("use_ym").cast("int") / 100 - 1992
    last = month.agg(F.max("use_ym")).first()[0]
    for stop in (2, None):
        monthly.write_in_batches(month, F.floor(number), (last or 199200) // 100 - 1991, f"{root}/out", ledger, stop)
    return spark.read.schema(month.schema).parquet(f"{root}/out").select(*month.columns)
