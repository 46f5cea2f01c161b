"""Recovery of codes by weaker and weaker sources, repairs, and the ledger of rules."""

from headway.operators import recovery
from headway.plans.views import views

TRIP = "route string, route_id string, board_seq int, board_ars string, board_code string, board_name string, alight_seq int, alight_ars string, alight_code string, alight_name string"


def trips(spark, *rows):
    return spark.createDataFrame([tuple(r) for r in rows], TRIP)


def codes(df):
    return sorted(((r["board_code"], r["board_rule"], r["alight_code"], r["alight_rule"]) for r in df.collect()), key=str)


def test_every_source_and_its_rule(spark):
    reference = trips(
        spark,
        ("101", "7", 1, "1001", "111111111", "a", 2, "01002", "222222222", "b"),
        ("101", None, 1, "1001", "111111111", "a", 2, "01002", "222222222", "b"),
        ("101", "7", 3, "01003", "333333333", "c", 4, "00000", "444444444", "d"),
    )
    master = spark.createDataFrame([("1009", "9"), ("01008", "81"), ("01008", "82")], "ars string, node string")
    raw = trips(
        spark,
        ("Jan-01", None, 1, "1001", None, "a", 2, "1002", "", "b"),  # the label of a spreadsheet; both by the reference
        ("101", None, 3, "1001", None, "a", 2, "1009", None, "x"),  # another position: same number; master
        ("101", "", 9, "0", None, "a", 4, "00000", None, "d"),  # by name (no number); the placeholder never
        ("102", None, 1, "1002", None, "q", 1, "1001", None, "q"),  # across sides
        ("102", "5", 1, "1008", None, "a", 1, None, "given", "q"),  # two nodes: none; a row with a number never by name
    )
    out = recovery.recover(raw, reference, master)
    assert out.count() == 5
    assert codes(out) == sorted([
        ("111111111", "reference", "222222222", "reference"),
        ("111111111", "same_ars", "000000009", "master"),
        ("111111111", "name", None, None),
        ("222222222", "cross", "111111111", "cross"),
        (None, None, "0000given", None),
    ], key=str)
    assert {(r["route"], r["route_id"], r["route_id_rule"]) for r in out.collect()} == {("101", "7", "route_by_board"), ("101", "7", "route_by_alight"), ("102", None, None), ("102", "5", None)}
    assert {r["board_ars"] for r in out.collect()} == {"01001", "00000", "01002", "01008"}


def test_ambiguous_keys_give_nothing_and_rows_stay(spark):
    none = trips(spark).where("false")
    master = spark.createDataFrame([], "ars string, node string")
    raw = trips(spark, *[("1", "1", 1, "01001", c, n, 2, a, None, "z") for c, n, a in (("1", "m", "01001"), ("2", "m", "01001"), (None, "m", "00000"), (None, "m", None))], ("1", "1", 1, None, None, "m", 2, "00000", None, "z"))
    out = recovery.recover(raw, none, master)
    assert out.count() == 5 and {r["board_rule"] for r in out.collect()} == {None} and {r["alight_rule"] for r in out.collect()} == {None}
    assert recovery.recover(none, none, master).count() == 0


def test_strong_sources_are_not_overwritten_and_repeats_keep_their_number(spark):
    master = spark.createDataFrame([("01001", "1")], "ars string, node string")
    raw = trips(spark, *[("1", "1", 1, "01001", None, "m", 2, "02002", "2", "z")] * 7, ("1", "1", 1, "02002", "3", "m", 2, "01001", None, "z"))
    out = recovery.recover(raw, trips(spark).where("false"), master)
    assert codes(out) == sorted([("000000001", "master", "000000002", None)] * 7 + [("000000003", None, "000000001", "master")], key=str)
    rows, seen = recovery.observed(out, "recovery")
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get["board:master"] == 7 and seen.get["alight:master"] == 1 and seen.get["board:name"] == 0
    assert {(r["column"], r["rule"], r["n"]) for r in recovery.rule_counts(out).collect()} == {("board", "master", 7), ("alight", "master", 1)}


def test_repairs_in_order(spark):
    bad, owner = recovery.BAD_CODE, recovery.BAD_CODE_STOP
    master = spark.createDataFrame([("00001", "1", "a"), ("00002", "2", "b"), ("00002", "3", "b"), ("00000", "7", "depot"), ("00000", "8", "yard"), ("00000", "9", "yard")], "ars string, node string, name string")
    outside = spark.createDataFrame([("00005", "5"), ("00006", "6"), ("00006", "66"), ("00001", "x")], "ars string, node string")
    cases = [  # number, name, code; code and rules after
        ("00001", "a", bad, "1", ["cleared_bad", "refilled"]), ("00001", "a", "4", "1", ["by_ars"]), ("00001", "a", "1", "1", []), ("00002", "b", bad, None, ["cleared_bad"]), ("00002", "b", "4", "4", []),
        (owner, "o", bad, bad, []), ("00005", "e", None, "5", ["outside"]), ("00005", "e", "5", "5", []), ("00006", "f", "4", "4", []), ("00000", "depot", "4", "7", ["virtual_by_name"]),
        ("00000", "yard", "4", None, ["virtual_cleared"]), ("00000", None, bad, None, ["cleared_bad"]), ("00000", "yard", None, None, []), (None, "a", bad, bad, []), ("00001", None, None, "1", ["refilled"]),
    ]
    rows = spark.createDataFrame([(i, a, n, c, a, n, c) for i, (a, n, c, _, _) in enumerate(cases)], "i int, board_ars string, board_name string, board_code string, alight_ars string, alight_name string, alight_code string")
    got = {r["i"]: r for r in recovery.repair(rows, master, outside).collect()}
    for i, (_, _, _, code, rules) in enumerate(cases):
        for side in recovery.SIDES:
            assert (got[i][f"{side}_code"], got[i][f"{side}_rules"]) == (code, rules), cases[i]
    checked = {r["side"]: (r["checked"], r["wrong"]) for r in recovery.disagreements(recovery.repair(rows, master, outside).withColumnsRenamed({}).selectExpr("'r' as route_id", "1 as board_seq", "1 as alight_seq", *[f"{s}_{c}" for s in recovery.SIDES for c in ("ars", "name", "code")]), master).collect()}
    assert checked == {"board": (4, 0), "alight": (4, 0)}


def test_trips_meet_their_lookups_once_by_route(spark):
    """Both joins of the trips are by route, so that one exchange serves them; the others are those of the lookups."""
    raw = views(spark, "/root/testdata/sf0.001")("raw_od")
    master = spark.createDataFrame([("00001", "1")], "ars string, node string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = recovery.recover(raw.where("service_date > '1995-03-31'"), raw.where("service_date <= '1995-03-31'"), master)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    joins = [line.split("SortMergeJoin ")[1] for line in plan.splitlines() if "SortMergeJoin " in line]
    assert len(joins) == 2 and all(j.startswith("[__route#") and "," not in j.split("]")[0] for j in joins)
    assert plan.count("Exchange hashpartitioning") == 4


def test_trips_without_a_route_find_codes_but_no_id(spark):
    reference = trips(spark, (None, "6", 1, "01001", "1", "a", 2, "01002", "2", "b"), ("", "7", 1, "01001", "1", "a", 2, "01002", "2", "b"))
    raw = trips(spark, (None, None, 1, "01003", None, "a", None, "0", None, "x"), ("", None, 1, "01004", None, "a", None, "0", None, None), ("9", "", None, "01003", "", "a", 2, "00000", "", "y"), ("9", "8", 1, "01005", "5", "x", 2, None, "9", "y"))
    out = recovery.recover(raw, reference, spark.createDataFrame([("01003", "3")], "ars string, node string"))
    assert sorted(((r["route"], r["route_id"], r["route_id_rule"], r["board_code"], r["board_rule"], r["alight_code"], r["alight_rule"]) for r in out.collect()), key=str) == sorted([
        (None, None, None, "000000003", "master", None, None), ("", "7", "route_by_board", None, None, None, None),
        ("9", "", None, "000000003", "master", "000000009", "name"), ("9", "8", None, "000000005", None, "000000009", None),
    ], key=str)
