"""Transit-shaped views over the provided tables.

Every query of the catalogue reads one of these. Their text runs in Spark and in DuckDB, so that queries and their SQL
share it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

_ARS = "lpad(CAST(1 + (rn * 17 + CASE WHEN rn % 5 = 0 THEN {0} % 30 ELSE {0} END) % 300 AS STRING), 5, '0')"

_PIER = "CASE {0} % 11 WHEN 0 THEN '마곡' WHEN 1 THEN '망원' WHEN 2 THEN '여의도' WHEN 3 THEN '압구정' WHEN 4 THEN '옥수' WHEN 5 THEN '성수' WHEN 6 THEN '뚝섬' WHEN 7 THEN '잠실' WHEN 8 THEN '서울숲' WHEN 9 THEN '강남역' END"

VIEWS: dict[str, str] = {
    "leg0": """SELECT l_orderkey AS okey, CAST(l_shipdate AS DATE) AS service_date, CAST(l_suppkey % 20 + 20 * floor(l_orderkey / 20000) AS INT) AS rn,
        CAST(1 + l_partkey % 40 AS INT) AS board_seq, CAST(1 + (l_orderkey * 7 + l_linenumber) % 40 AS INT) AS alight_seq,
        CAST(l_quantity AS DOUBLE) AS passengers FROM lineitem""",
    "leg": f"""SELECT okey, service_date, concat('R', CASE WHEN rn < 10 THEN '0' ELSE '' END, CAST(rn AS STRING)) AS route, board_seq, alight_seq,
        {_ARS.format('board_seq')} AS board_ars, {_ARS.format('alight_seq')} AS alight_ars, passengers FROM leg0""",
    # a typical day: total riders of each stop pair
    "typical": """SELECT route, board_seq, board_ars, alight_seq, alight_ars, sum(passengers) AS passengers
        FROM leg GROUP BY route, board_seq, board_ars, alight_seq, alight_ars""",
    "route_stop": """SELECT DISTINCT route, CASE WHEN side = 0 THEN board_seq ELSE alight_seq END AS seq, CASE WHEN side = 0 THEN board_ars ELSE alight_ars END AS ars
        FROM (SELECT route, board_seq, board_ars, alight_seq, alight_ars, EACH(0, 1) AS side FROM leg) s""",
    "station": """SELECT route, concat(route, CASE WHEN side = 0 THEN '|A' ELSE '|B' END) AS variant, seq, ars FROM (SELECT *, EACH(0, 1) AS side FROM route_stop) s
        WHERE side = 0 OR seq <= 30 AND route IN ('R00', 'R04', 'R08', 'R12')""",
    "stop_point": """SELECT k, lpad(CAST(k AS STRING), 5, '0') AS ars, concat('stop ', CAST(k % 90 AS STRING)) AS name,
        126.9e0 + (k % 20) * 0.01e0 AS lng, 37.4e0 + floor(k / 20) * 0.01e0 AS lat
        FROM (SELECT DISTINCT CAST(1 + p_partkey % 300 AS INT) AS k FROM part) s""",
    "district": """SELECT concat('11', lpad(CAST(d AS STRING), 3, '0'), '500') AS dong, concat('dong ', CAST(d AS STRING)) AS name,
        126.9e0 + (d % 10) * 0.02e0 AS x0, 37.4e0 + floor(d / 10) * 0.02e0 AS y0,
        126.9e0 + (d % 10 + 1) * 0.02e0 AS x1, 37.4e0 + (floor(d / 10) + 1) * 0.02e0 AS y1
        FROM (SELECT DISTINCT CAST(p_partkey % 100 AS INT) AS d FROM part) s""",
    "raw_od": f"""SELECT CASE WHEN okey % 97 = 5 THEN NULL ELSE service_date END AS service_date, route,
        CASE WHEN m = 1 THEN NULL ELSE concat('1000', route) END AS route_id,
        CASE WHEN m IN (2, 5) THEN NULL ELSE board_seq END AS board_seq,
        CASE WHEN m = 4 THEN NULL WHEN m = 5 THEN '00000' ELSE board_ars END AS board_ars,
        CASE WHEN m = 8 THEN NULL ELSE concat('1', board_ars, '000') END AS board_code,
        CASE WHEN m = 3 THEN concat('기점가상 ', board_ars) WHEN m IN (4, 9) THEN NULL ELSE concat('stop ', board_ars) END AS board_name,
        CASE WHEN m IN (6, 7) THEN NULL WHEN m = 10 THEN board_seq ELSE alight_seq END AS alight_seq,
        CASE WHEN m IN (5, 7) THEN '00000' WHEN m = 10 THEN board_ars WHEN m = 11 THEN NULL ELSE alight_ars END AS alight_ars,
        CASE WHEN m = 12 THEN NULL ELSE concat('1', alight_ars, '000') END AS alight_code,
        CASE WHEN m = 6 THEN concat('stop (가상) ', alight_ars) ELSE concat('stop ', alight_ars) END AS alight_name,
        CASE WHEN m = 13 THEN NULL ELSE CAST(passengers AS INT) END AS passengers
        FROM (SELECT *, okey % 23 AS m FROM leg) s""",
    "boarding_month": """SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT) AS use_ym, o_orderpriority AS route,
        CAST(o_orderkey % 24 AS INT) AS hour, lpad(CAST(o_custkey % 20 AS STRING), 5, '0') AS ars, CAST(floor(o_totalprice) AS DOUBLE) AS boardings,
        concat('v', CAST(o_orderkey % 3 AS STRING)) AS visit FROM orders""",
    "boarding_hour": """SELECT CAST(ts AS DATE) AS day, CAST(hour(ts) AS INT) AS hour, event_type AS route,
        lpad(CAST(user_id AS STRING), 5, '0') AS ars, CAST(floor(value) AS DOUBLE) AS boardings FROM events""",
    "demand": """SELECT 'bus' AS mode, CAST(hour(ts) AS INT) AS hour, event_type AS service, CAST(user_id AS STRING) AS node, CAST(extract(day FROM ts) AS INT) % 7 AS dow,
        CAST(floor(value) / 2 AS DOUBLE) AS boardings, CAST(floor(value) / 4 AS DOUBLE) AS alightings FROM events
        UNION ALL SELECT 'subway', CAST(o_orderkey % 24 AS INT), o_orderpriority, concat('S', CAST(o_custkey % 40 AS STRING)), CAST(o_orderkey % 7 AS INT),
        CAST(floor(o_totalprice) / 4 AS DOUBLE), CAST(floor(o_totalprice) / 8 AS DOUBLE) FROM orders""",
    "od_dong": """SELECT CASE WHEN s_nationkey >= 20 THEN 'outside' ELSE concat('110', CAST(10 + s_nationkey % 5 AS STRING), lpad(CAST(s_nationkey AS STRING), 3, '0')) END AS origin,
        CASE WHEN c_nationkey >= 20 THEN 'outside' ELSE concat('110', CAST(10 + c_nationkey % 5 AS STRING), lpad(CAST(c_nationkey AS STRING), 3, '0')) END AS dest,
        CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0e0 END AS subway, CASE WHEN l_returnflag <> 'A' THEN l_quantity ELSE 0e0 END AS bus,
        s_nationkey AS ok, c_nationkey AS dk, CASE WHEN l_linenumber % 3 = 0 THEN 'saturday' ELSE 'weekday' END AS day_type, CAST(l_shipdate AS DATE) AS day
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "flow": """SELECT day_type, origin, dest, ok, dk, sum(subway) AS subway, sum(bus) AS bus FROM od_dong GROUP BY day_type, origin, dest, ok, dk""",
    "terrain": """SELECT p_partkey AS node, p_brand AS dong, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 4 END AS slope,
        CAST(p_partkey % 90 AS DOUBLE) AS elev, CASE WHEN p_partkey % 3 = 0 THEN 'interior' WHEN p_partkey % 3 = 1 THEN 'boundary' ELSE 'nearest' END AS method FROM part""",
    "daily": """SELECT CAST(o_custkey % 50 AS INT) AS stop, CAST(o_orderdate AS DATE) AS day, CAST(count(*) AS DOUBLE) AS boardings FROM orders
        GROUP BY CAST(o_custkey % 50 AS INT), CAST(o_orderdate AS DATE)""",
    "messy": """SELECT p_partkey AS k, CASE p_partkey % 16 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' 1041' WHEN 3 THEN '00000' WHEN 4 THEN 'nan' WHEN 5 THEN '1041.0'
        WHEN 6 THEN '0000~' WHEN 7 THEN '123456' WHEN 8 THEN CAST(p_partkey AS STRING) WHEN 9 THEN 'Jan-01' WHEN 10 THEN '0' WHEN 11 THEN 'A160' WHEN 12 THEN '9401'
        WHEN 13 THEN '1.05' WHEN 14 THEN ' City Hall (gate 2).west_1 ' ELSE 'N' || CAST(p_partkey % 40 AS STRING) END AS t FROM part""",
    # trips with their hour and minute of boarding and the minutes between two stops
    "timed": """SELECT service_date, route, board_seq, board_ars, alight_seq, alight_ars, passengers, CAST(okey % 24 AS INT) AS hour, CAST(okey * 13 % 60 AS INT) AS minute, CAST(1 + okey % 3 AS INT) AS pace FROM leg""",
    "pier_od": f"""SELECT CAST(l_shipdate AS DATE) AS service_date, CASE WHEN l_orderkey % 9 = 0 THEN 'R01' END AS route, CAST(NULL AS INT) AS board_seq, CASE WHEN l_orderkey % 10 = 0 THEN '00011' END AS board_ars,
        {_PIER.format('l_partkey')} AS board_name, CASE WHEN l_orderkey % 9 = 0 THEN 4 END AS alight_seq, CAST(NULL AS STRING) AS alight_ars, {_PIER.format('(l_partkey + l_suppkey + l_linenumber)')} AS alight_name, CAST(l_quantity AS INT) AS passengers FROM lineitem""",
    "closure": """SELECT CAST('1997-03-01' AS DATE) AS first, CAST('1997-03-20' AS DATE) AS last, 'all' AS piers UNION ALL SELECT CAST('1998-07-01' AS DATE), CAST('1998-09-05' AS DATE), '잠실,망원'
        UNION ALL SELECT CAST('1998-08-01' AS DATE), CAST('1998-08-03' AS DATE), '옥수'""",
    "used_point": "SELECT ars, name, CASE WHEN k % 29 = 0 THEN NULL ELSE lng END AS lng, CASE WHEN k % 29 = 0 THEN NULL ELSE lat END AS lat FROM stop_point WHERE k % 31 <> 5",
    "path_point": "SELECT route, seq, ars, lng + CASE WHEN k % 13 = 0 THEN 0.004e0 ELSE seq * 0.00001e0 END AS lng, lat + CASE WHEN k % 19 = 0 THEN 0.02e0 ELSE 0e0 END AS lat FROM route_stop JOIN stop_point USING (ars)",
    "api_page": """SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN '<CardBusTimeNew><list_total_count>1</list_total_count><RESULT><CODE>INFO-000</CODE><MESSAGE>fine</MESSAGE></RESULT><row><A>1</A></row></CardBusTimeNew>'
        WHEN 1 THEN '<RESULT><CODE>INFO-200</CODE><MESSAGE>nothing yet</MESSAGE></RESULT>' WHEN 2 THEN '<RESULT><CODE>INFO-100</CODE><MESSAGE>bad key abc123 of abc123</MESSAGE></RESULT>'
        WHEN 3 THEN '<CardBusTimeNew><list_total_count>0</list_total_count></CardBusTimeNew>' ELSE '<CardBusTimeNew><RESULT><CODE>ERROR-500</CODE></RESULT></CardBusTimeNew>' END AS xml FROM orders""",
    # typical trips of which some board where the stop has no usable number
    "trip": """SELECT route, board_seq, CASE board_seq WHEN 40 THEN NULL WHEN 33 THEN '00000' WHEN 25 THEN 'A0025' ELSE board_ars END AS board_ars, alight_seq, alight_ars, passengers FROM typical""",
    # boardings by hour of every route and stop but those of one route; some stops have counts of 0 only
    "hour_count": """SELECT route, board_ars AS ars, CAST(okey % 24 AS INT) AS hour, CASE WHEN CAST(board_ars AS INT) % 9 = 4 THEN 0e0 ELSE passengers END AS boardings FROM leg WHERE route <> 'R03'""",
    # stations of which some lack a number
    "station_gap": "SELECT route, variant, seq, CASE WHEN seq = 17 THEN NULL ELSE ars END AS ars FROM station",
    # the vertices of each variant's path: one beside every stop and one between it and the next
    "path_vertex": """SELECT variant, 2 * seq AS vertex, lng + 0.0001e0 AS lng, lat FROM station JOIN stop_point USING (ars)
        UNION ALL SELECT variant, 2 * seq + 1, (lng + nlng) / 2 + 0.001e0, (lat + nlat) / 2 FROM (SELECT variant, seq, lng, lat, lead(lng) OVER (PARTITION BY variant ORDER BY seq) AS nlng, lead(lat) OVER (PARTITION BY variant ORDER BY seq) AS nlat FROM station JOIN stop_point USING (ars)) s WHERE nlng IS NOT NULL""",
    # trips with codes of which some are wrong, missing or of other stops
    "coded": """SELECT CAST(board_seq AS INT) AS board_seq, CASE WHEN m = 5 THEN '00000' WHEN m = 9 THEN NULL ELSE board_ars END AS board_ars, concat('stop ', CAST(board_seq % 5 AS STRING)) AS board_name,
        CASE m WHEN 3 THEN '164000626' WHEN 4 THEN NULL WHEN 5 THEN '277102436' WHEN 6 THEN concat('9', board_ars, '000') ELSE concat('1', board_ars, '000') END AS board_code,
        CASE WHEN m = 7 THEN '00000' WHEN m = 8 THEN '38624' ELSE alight_ars END AS alight_ars, concat('stop ', CAST(alight_seq % 5 AS STRING)) AS alight_name,
        CASE m WHEN 8 THEN '164000626' WHEN 10 THEN '164000626' WHEN 7 THEN CASE WHEN alight_seq % 5 = 4 THEN NULL ELSE '277102436' END ELSE concat('1', alight_ars, '000') END AS alight_code, passengers FROM (SELECT *, (okey + board_seq) % 19 AS m FROM leg) s""",
    "master_node": """SELECT ars, concat('1', ars, '000') AS node, name FROM stop_point WHERE k % 4 <> 0 UNION ALL SELECT ars, concat('2', ars, '000'), name FROM stop_point WHERE k % 50 = 0
        UNION ALL SELECT '00000', concat('7', ars, '000'), concat('stop ', CAST(k AS STRING)) FROM stop_point WHERE k <= 4 UNION ALL SELECT '00000', '799999999', 'stop 3' FROM stop_point WHERE k = 1""",
    "outer_node": """SELECT ars, concat('8', ars, '000') AS node FROM stop_point WHERE k % 4 = 0 UNION ALL SELECT ars, concat('6', ars, '000') FROM stop_point WHERE k % 40 = 0""",
    "subway_station": "SELECT concat('Stop ', CAST(k % 40 AS STRING)) AS name, lng * 1e0 AS lng, lat * 1e0 AS lat FROM stop_point WHERE k % 5 = 0",
    "inner_stop": "SELECT ars, name, lng * 1e0 AS lng, lat * 1e0 AS lat FROM stop_point WHERE k % 3 <> 0",
    "outer_stop": "SELECT concat('c', CAST(k AS STRING)) AS canonical, ars, name, lng * 1e0 AS lng, lat * 1e0 AS lat FROM stop_point WHERE k % 2 = 0",
    "node_map": "SELECT concat('c', CAST(k AS STRING)) AS canonical, CAST(k - k % 4 AS STRING) AS node FROM stop_point",
    # lines of a list of holidays, of which some have no day
    "holiday_line": """SELECT o_orderkey AS line, CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'none' WHEN 2 THEN '' ELSE concat('  ', CAST(CAST(o_orderdate AS DATE) AS STRING), ' ') END AS day,
        concat(' holiday ', CAST(o_orderkey % 9 AS STRING), '  ') AS name FROM orders""",
    "holiday": """SELECT CAST('1996-01-01' AS DATE) AS date UNION SELECT CAST('1996-05-05' AS DATE) UNION SELECT CAST('1997-03-03' AS DATE)
        UNION SELECT CAST('2024-01-01' AS DATE) UNION SELECT CAST('1999-12-24' AS DATE) UNION SELECT CAST('2000-02-29' AS DATE)""",
}

_WITH = "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in VIEWS.items()) + "\n"
#: EACH(a, b) stands for a row per value, the one thing that both engines write differently.
PREFIX = re.sub(r"EACH\((.*?)\)", r"unnest([\1])", _WITH)
SPARK_PREFIX = re.sub(r"EACH\((.*?)\)", r"explode(array(\1))", _WITH)


def views(spark: SparkSession, sf_dir: str):
    """A function that gives a view or a table by name."""

    def get(name: str) -> DataFrame:
        if name in TABLES:
            return spark.read.parquet(f"{sf_dir}/{name}.parquet")
        for table in TABLES:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        return spark.sql(f"{SPARK_PREFIX} SELECT * FROM {name}")

    return get


#: Queries and their SQL by name; the modules of the catalogue fill both.
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(view)`` as a query; ``sql`` is its text over the views."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(views(spark, sf_dir))
        if sql:
            ORACLES[name] = PREFIX + sql
        return f

    return add
