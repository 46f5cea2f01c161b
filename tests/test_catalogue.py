"""Every query against its SQL in DuckDB, over the smallest tables."""

import math

import duckdb
import pytest

from headway.plans import catalogue
from headway.plans.views import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if type(x).__name__ == "Decimal":
        return float(x)
    if isinstance(x, float) and math.isnan(x):
        return "nan"
    return x


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = db.execute(catalogue.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["join_covers_any", "join_distance_within", "join_range_onboard", "dom_place_legs", "join_calendar_interval"])
def test_spatial_and_range_plans_have_no_nested_loops(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_queries_without_sql_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
