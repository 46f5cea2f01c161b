"""Queries of the composite operators: cleaning, loads, profiles, districts, periods, terrain and checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calendars as cal
from ..functions import geo
from ..functions import identifiers as ids
from ..functions import numbers as num
from ..operators import cohorts, demand, districts, hourly, lookups, models, od_cleaning, paths, quality, recovery, route_load, segments, spatial
from ..sources import sinks
from ..sources.files import saved
from .views import query

C = F.col

# ---------------------------------------------------------------- cleaning

_COLS = ", ".join(od_cleaning.COLUMNS)
_V = "'00000'"
_FLAG = "coalesce(regexp_matches({0}, '가상|기점가상|경유'), false)"


def _update(name: str, source: str, mask: str, **values: str) -> str:
    parts = [f"CASE WHEN coalesce({mask}, false) THEN {values[c]} ELSE {c} END AS {c}" if c in values else c for c in od_cleaning.COLUMNS]
    return f"{name} AS (SELECT {', '.join(parts)} FROM {source})"


def _copy(to: str, frm: str) -> dict[str, str]:
    return {f"{to}_{x}": f"{frm}_{x}" for x in ("seq", "ars", "code", "name")}


_TO_V = f"alight_ars = {_V} AND alight_seq IS NULL"
_END = "max(board_seq) OVER (PARTITION BY service_date, route)"


def _merge(name: str, source: str) -> str:
    key = "service_date, route, route_id, board_seq, coalesce(board_ars, 'name:' || board_name), alight_seq, coalesce(alight_ars, 'name:' || alight_name)"
    order = "passengers DESC NULLS LAST, board_code NULLS LAST, board_name NULLS LAST, alight_code NULLS LAST, alight_name NULLS LAST, board_ars NULLS LAST, alight_ars NULLS LAST"
    cols = _COLS.replace("passengers", "CAST(total AS INT) AS passengers")
    return f"{name} AS (SELECT {cols} FROM (SELECT *, sum(passengers) OVER (PARTITION BY {key}) AS total, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {source}) WHERE rn = 1)"


_MODAL = """(SELECT service_date AS d, route AS r, board_ars AS a, board_seq AS modal FROM (SELECT *, row_number() OVER (PARTITION BY service_date, route, board_ars ORDER BY n DESC, board_seq NULLS LAST) AS rn
    FROM (SELECT service_date, route, board_ars, board_seq, count(*) AS n FROM {0} WHERE board_ars <> '00000' AND route IS NOT NULL GROUP BY ALL)) WHERE rn = 1)"""
_LOWS = """(SELECT service_date AS d, route AS r, board_seq AS s, board_ars AS b, alight_ars AS a, min(alight_seq) AS low FROM {0} WHERE board_ars <> '00000' AND alight_ars <> '00000' GROUP BY ALL
    HAVING count(DISTINCT alight_seq) > 1 AND max(alight_seq) - min(alight_seq) <= 2)"""
_NEXT = """(SELECT service_date AS d, route AS r, board_seq - 1 AS s, board_ars AS n_ars, board_code AS n_code, board_name AS n_name FROM (SELECT *, row_number() OVER (PARTITION BY service_date, route, board_seq
    ORDER BY board_ars NULLS LAST, board_code NULLS LAST, board_name NULLS LAST) AS rn FROM {0} WHERE route IS NOT NULL AND board_seq IS NOT NULL) WHERE rn = 1)"""

_VIRTUAL = ",\n".join([
    f"c0 AS (SELECT {_COLS} FROM raw_od WHERE service_date IS NOT NULL)",
    _update("c1", "c0", f"{_FLAG.format('board_name')} AND NOT coalesce(board_ars = '06137', false)", board_ars=_V),
    _update("c2", "c1", f"{_FLAG.format('alight_name')} AND NOT coalesce(alight_ars = '06137', false)", alight_ars=_V),
    _update("c3", "c2", f"board_ars = {_V} AND board_seq IS NULL", board_seq="0"),
    _update("c4", "c3", f"board_seq = 0 AND board_ars = {_V} AND {_TO_V}", alight_seq="0"),
    _update("c5", "c4", f"{_TO_V} AND board_seq BETWEEN 1 AND 10", **_copy("alight", "board")),
    f"c6 AS (SELECT *, coalesce({_TO_V} AND last_seq <> 0 AND board_seq / last_seq * 100 < 48 AND board_seq >= 11, false) AS odd FROM (SELECT *, CASE WHEN route IS NOT NULL THEN {_END} END AS last_seq FROM c5))",
    f"c7 AS (SELECT {_COLS}, CASE WHEN route IS NOT NULL THEN {_END} END AS last_seq FROM c6 WHERE NOT odd)",
    _update("c8", "c7", f"{_TO_V} AND last_seq IS NOT NULL", alight_seq="last_seq + 1"),
    _update("c9", "c8", "(alight_name IS NULL OR alight_name = '') AND alight_code = '0'", alight_name="board_name"),
    _update("c10", "c9", f"board_ars <> {_V} AND alight_ars = {_V} AND alight_seq IS NOT NULL", **_copy("alight", "board")),
    _update("c11", "c10", f"board_ars = {_V} AND board_seq <> 0", **_copy("board", "alight")),
    _update("c12", "c11", f"board_ars = {_V} AND alight_ars = {_V} AND board_seq = alight_seq", alight_seq="board_seq + 1"),
])
_SEQUENCES = ",\n".join([
    f"d1 AS (SELECT x.*, modal FROM d0 x LEFT JOIN {_MODAL.format('d0')} m ON service_date = d AND route = r AND board_ars = a)",
    _update("d2", "d1", "board_seq <> modal", board_seq="modal"),
    f"d3 AS (SELECT x.*, low FROM d2 x LEFT JOIN {_LOWS.format('d2')} m ON service_date = d AND route = r AND board_seq = s AND board_ars = b AND alight_ars = a)",
    _update("d4", "d3", "alight_seq <> low", alight_seq="low"),
])
_SAME = ",\n".join([
    _update("e1", "e0", f"board_seq = alight_seq AND board_ars = alight_ars AND board_ars <> {_V}", alight_seq="board_seq + 1"),
    f"e2 AS (SELECT x.*, n_ars, n_code, n_name, s IS NOT NULL AS hit FROM e1 x LEFT JOIN {_NEXT.format('e1')} m ON service_date = d AND route = r AND board_seq = s)",
    _update("e3", "e2", "hit AND board_ars = alight_ars", alight_seq="board_seq + 1", alight_ars="n_ars", alight_code="n_code", alight_name="n_name"),
])


@query("dom_virtual_stop_steps", f"SELECT * FROM (WITH {_VIRTUAL} SELECT * FROM c12)")
def _(v):
    return od_cleaning.virtual_stops(v("raw_od").where("service_date is not null"))[0].select(*od_cleaning.COLUMNS)


@query("agg_anomaly_split", f"SELECT * FROM (WITH {_VIRTUAL} SELECT {_COLS} FROM c6 WHERE odd)")
def _(v):
    return od_cleaning.virtual_stops(v("raw_od").where("service_date is not null"))[1].select(*od_cleaning.COLUMNS)


@query("dom_sequence_steps", f"SELECT * FROM (WITH d0 AS (SELECT {_COLS} FROM raw_od), {_SEQUENCES} SELECT * FROM d4)")
def _(v):
    return od_cleaning.sequences(v("raw_od")).select(*od_cleaning.COLUMNS)


@query("dom_same_stop_steps", f"SELECT * FROM (WITH e0 AS (SELECT {_COLS} FROM raw_od), {_SAME} SELECT * FROM e3)")
def _(v):
    return od_cleaning.same_stops(v("raw_od")).select(*od_cleaning.COLUMNS)


_CORRECTED = f"{_VIRTUAL}, {_merge('d0', 'c12')}, {_SEQUENCES}, {_merge('e0', 'd4')}, {_SAME}, {_merge('f0', 'e3')}"


@query("dom_correct_day", f"SELECT * FROM (WITH {_CORRECTED} SELECT * FROM f0 UNION ALL SELECT {_COLS} FROM raw_od WHERE service_date IS NULL)")
def _(v):
    return od_cleaning.correct(v("raw_od"))[0].select(*od_cleaning.COLUMNS)


@query("agg_conservation", """SELECT service_date, route, CAST(coalesce(sum(passengers), 0) AS BIGINT) AS before, CAST(0 AS BIGINT) AS lacking FROM raw_od GROUP BY service_date, route""")
def _(v):
    raw = v("raw_od")
    after, aside = od_cleaning.correct(raw)
    return od_cleaning.balance(raw, after, aside).select("service_date", "route", "before", "lacking")


@query("dom_normalize_raw", r"""SELECT strftime(service_date, '%y%m%d') AS service_date, route, CAST(count(route_id) AS BIGINT) AS ids, CAST(sum(board_seq) AS BIGINT) AS seqs, count(DISTINCT board_ars) AS stops, CAST(sum(coalesce(passengers, 0)) AS BIGINT) AS passengers FROM raw_od GROUP BY 1, 2""")
def _(v):
    text = v("raw_od").select(*[C(c).cast("string").alias(c) for c in od_cleaning.COLUMNS])
    d = od_cleaning.normalise(text)
    return d.groupBy("service_date", "route").agg(F.count("route_id").alias("ids"), F.sum("board_seq").alias("seqs"), F.count_distinct("board_ars").alias("stops"), F.sum("passengers").alias("passengers"))


_UNCODED = "(SELECT service_date, route, route_id, board_seq, board_ars, CAST(NULL AS VARCHAR) AS board_code, board_name, alight_seq, alight_ars, CAST(NULL AS VARCHAR) AS alight_code, alight_name FROM raw_od WHERE coalesce(service_date NOT BETWEEN DATE '1995-01-01' AND DATE '1995-03-31', true))"
_REFERENCE = "(SELECT * FROM raw_od WHERE service_date BETWEEN DATE '1995-01-01' AND DATE '1995-03-31')"
_UNIQUE = "(SELECT {k}, min({v}) AS found FROM {t} WHERE {v} IS NOT NULL AND {v} <> '' {w} GROUP BY {k} HAVING count(DISTINCT {v}) = 1)"
_REAL = "AND {0} IS NOT NULL AND {0} <> '00000'"


def _step(name: str, source: str, side: str, rule: str, lookup: str, on: str, when: str = "true") -> str:
    code, set_by = f"{side}_code", f"{side}_rule"
    return f"""{name} AS (SELECT x.* EXCLUDE ({code}, {set_by}), coalesce({code}, CASE WHEN {when} THEN found END) AS {code}, CASE WHEN {code} IS NULL AND {when} AND found IS NOT NULL THEN '{rule}' ELSE {set_by} END AS {set_by}
        FROM {source} x LEFT JOIN {lookup} l ON {on})"""


def _recovery() -> str:
    by = lambda side: f"(SELECT route, {side}_seq, min(route_id) AS id FROM ref WHERE route_id IS NOT NULL GROUP BY ALL)"
    parts = [f"raw AS {_UNCODED}", f"ref AS {_REFERENCE}", "mst AS (SELECT ars, concat('1', ars, '000') AS node FROM stop_point WHERE k % 3 = 0)",
             f"""r0 AS (SELECT x.* EXCLUDE (route_id), coalesce(x.route_id, b.id, a.id) AS route_id, CASE WHEN x.route_id IS NOT NULL THEN NULL WHEN b.id IS NOT NULL THEN 'route_by_board' WHEN a.id IS NOT NULL THEN 'route_by_alight' END AS route_id_rule,
        CAST(NULL AS VARCHAR) AS board_rule, CAST(NULL AS VARCHAR) AS alight_rule FROM raw x LEFT JOIN {by('board')} b ON b.route = x.route AND b.board_seq = x.board_seq LEFT JOIN {by('alight')} a ON a.route = x.route AND a.alight_seq = x.alight_seq)"""]  # fmt: skip
    last = "r0"

    def add(*args: str) -> None:
        nonlocal last
        name = f"r{len(parts)}"
        parts.append(_step(name, last, *args))
        last = name

    for s in ("board", "alight"):
        add(s, "master", _UNIQUE.format(k="ars", v="node", t="mst", w=""), f"l.ars = x.{s}_ars")
        add(s, "reference", _UNIQUE.format(k=f"route_id, {s}_seq, {s}_ars", v=f"{s}_code", t="ref", w=_REAL.format(f"{s}_ars")), f"l.route_id = x.route_id AND l.{s}_seq = x.{s}_seq AND l.{s}_ars = x.{s}_ars")
    for s in ("board", "alight"):
        add(s, "same_ars", _UNIQUE.format(k=f"{s}_ars", v=f"{s}_code", t=last, w=_REAL.format(f"{s}_ars")), f"l.{s}_ars = x.{s}_ars")
    for s in ("board", "alight"):
        add(s, "name", _UNIQUE.format(k=f"{s}_name", v=f"{s}_code", t=last, w=f"AND {s}_name IS NOT NULL"), f"l.{s}_name = x.{s}_name", f"coalesce(x.{s}_ars, '00000') = '00000'")
    for s, t in (("board", "alight"), ("alight", "board")):
        add(t, "cross", _UNIQUE.format(k=f"{s}_ars", v=f"{s}_code", t=last, w=_REAL.format(f"{s}_ars")), f"l.{s}_ars = x.{t}_ars")
    return f"""SELECT * FROM (WITH {', '.join(parts)} SELECT route, "column", rule, count(*) AS n FROM (SELECT route, 'route_id' AS "column", route_id_rule AS rule FROM {last} UNION ALL SELECT route, 'board', board_rule FROM {last} UNION ALL SELECT route, 'alight', alight_rule FROM {last}) GROUP BY ALL)"""


@query("dom_code_recovery", _recovery())
def _(v):
    raw, inside = v("raw_od"), C("service_date").between("1995-01-01", "1995-03-31")
    empty = F.lit(None).cast("string")
    rows = raw.where(F.coalesce(~inside, F.lit(True))).withColumns({"board_code": empty, "alight_code": empty})
    master = v("stop_point").where("k % 3 = 0").select("ars", F.concat(F.lit("1"), "ars", F.lit("000")).alias("node"))
    done = recovery.recover(rows, raw.where(inside), master)
    rules = F.array(*[F.struct(F.lit(c).alias("column"), C(f"{c}_rule").alias("rule")) for c in ("route_id", "board", "alight")])
    return done.select("route", F.explode(rules).alias("x")).groupBy("route", "x.column", "x.rule").agg(F.count(F.lit(1)).alias("n"))


def _repairs(side: str) -> str:
    steps = (
        ("cleared_bad", f"code = '{recovery.BAD_CODE}' AND x.ars <> '{recovery.BAD_CODE_STOP}'", "NULL"), ("refilled", "code IS NULL AND m.found IS NOT NULL", "m.found"),
        ("by_ars", "m.found IS NOT NULL AND m.found IS DISTINCT FROM code", "m.found"), ("outside", "e.found IS NOT NULL AND e.found IS DISTINCT FROM code", "e.found"),
        ("virtual_by_name", "x.ars = '00000' AND v.found IS NOT NULL AND v.found IS DISTINCT FROM code", "v.found"), ("virtual_cleared", "x.ars = '00000' AND code IS NOT NULL AND v.found IS NULL", "NULL"),
    )
    lookups_ = [("m", _UNIQUE.format(k="ars", v="node", t="master_node", w="")), ("e", _UNIQUE.format(k="ars", v="node", t="outer_node", w="AND ars NOT IN (SELECT ars FROM master_node)")), ("v", _UNIQUE.format(k="name", v="node", t="master_node", w="AND ars = '00000'"))]
    text, hits = f"(SELECT {side}_ars AS ars, {side}_name AS name, {side}_code AS code FROM coded)", ""
    for rule, when, value in steps:
        joins = " ".join(f"LEFT JOIN {t} {a} ON {a}.{'name' if a == 'v' else 'ars'} = x.{'name' if a == 'v' else 'ars'}" for a, t in lookups_)
        text = f"(SELECT x.* EXCLUDE (code), CASE WHEN coalesce({when}, false) THEN {value} ELSE code END AS code, coalesce({when}, false) AS {rule} FROM {text} x {joins})"
        hits += f"{', ' if hits else ''}sum(CAST({rule} AS INT)) AS {rule}"
    sums = f"(SELECT {hits} FROM {text})"
    return " UNION ALL ".join(f"""SELECT '{side}' AS "column", '{r}' AS rule, CAST({r} AS BIGINT) AS n FROM {sums} WHERE {r} > 0""" for r, _, _ in steps)


@query("fix_codes", f"{_repairs('board')} UNION ALL {_repairs('alight')}")
def _(v):
    return recovery.rule_counts(recovery.repair(v("coded"), v("master_node"), v("outer_node")))


@query("dom_legacy_route_vote", f"""SELECT route, route_id, votes FROM (SELECT a.route, b.route_id, count(*) AS votes, row_number() OVER (PARTITION BY a.route ORDER BY count(*) DESC, b.route_id) AS r FROM
    (SELECT DISTINCT route, board_name, board_seq FROM raw_od) a JOIN (SELECT DISTINCT route_id, board_name, board_seq FROM {_REFERENCE} WHERE route_id IS NOT NULL) b ON a.board_name = b.board_name AND a.board_seq = b.board_seq WHERE a.route IS NOT NULL GROUP BY 1, 2) WHERE r = 1""")
def _(v):
    raw = v("raw_od")
    return lookups.voted(raw, raw.where(C("service_date").between("1995-01-01", "1995-03-31")), "route", "route_id", ["board_name", "board_seq"])


# ---------------------------------------------------------------- loads

_FLOW = "SELECT route, seq, sum(ons) AS ons, sum(offs) AS offs FROM (SELECT route, board_seq AS seq, passengers AS ons, 0e0 AS offs FROM {0} UNION ALL SELECT route, alight_seq, 0e0, passengers FROM {0}) GROUP BY route, seq"
_ORD = "(SELECT * FROM typical WHERE alight_seq > board_seq)"


@query("win_onboard_floor0", f"SELECT route, seq, ons, offs, greatest(sum(ons - offs) OVER (PARTITION BY route ORDER BY seq), 0e0) AS load FROM ({_FLOW.format(_ORD)})")
def _(v):
    return route_load.on_board(v("typical"))


@query("win_cum_occupancy", f"""SELECT route, seq, occupancy, max(occupancy) OVER (PARTITION BY route) AS most FROM (SELECT route, seq, CASE WHEN run < 0 THEN 0 ELSE CAST(round_even(run / 19, 0) AS INT) END AS occupancy FROM
    (SELECT route, seq, sum(ons - offs) OVER (PARTITION BY route ORDER BY seq) AS run FROM ({_FLOW.format('typical')})))""")
def _(v):
    return route_load.occupancy(v("typical"))


@query("win_route_load", f"SELECT route, seq, load, lead(seq) OVER (PARTITION BY route ORDER BY seq) AS next_seq FROM (SELECT route, seq, greatest(sum(ons - offs) OVER (PARTITION BY route ORDER BY seq), 0e0) AS load FROM ({_FLOW.format(_ORD)}))")
def _(v):
    return route_load.on_board(v("typical")).select("route", "seq", "load", F.lead("seq").over(Window.partitionBy("route").orderBy("seq")).alias("next_seq"))


@query("win_leaving_cumulative", "SELECT route, board_seq, sum(sum(passengers)) OVER (PARTITION BY route ORDER BY board_seq) AS leaving FROM typical WHERE alight_seq > board_seq AND board_seq BETWEEN 10 AND 20 AND alight_seq > 20 GROUP BY route, board_seq")
def _(v):
    out = route_load.ordered(v("typical")).where("board_seq between 10 and 20 and alight_seq > 20").groupBy("route", "board_seq").agg(F.sum("passengers").alias("p"))
    return out.select("route", "board_seq", F.sum("p").over(Window.partitionBy("route").orderBy("board_seq")).alias("leaving"))


@query("qry_congestion_response", f"""SELECT route, seq, percent, CASE WHEN percent < 20 THEN 'very_low' WHEN percent < 40 THEN 'low' WHEN percent < 60 THEN 'medium' WHEN percent < 80 THEN 'high' ELSE 'very_high' END AS level FROM
    (SELECT route, seq, CASE WHEN max(occupancy) OVER (PARTITION BY route) <= 0 THEN 0e0 ELSE floor(occupancy * 100e0 / max(occupancy) OVER (PARTITION BY route) * 10 + 0.5) / 10 END AS percent FROM
    (SELECT route, seq, CASE WHEN run < 0 THEN 0 ELSE CAST(round_even(run / 19, 0) AS INT) END AS occupancy FROM (SELECT route, seq, sum(ons - offs) OVER (PARTITION BY route ORDER BY seq) AS run FROM ({_FLOW.format('typical')}))))""")
def _(v):
    percent = num.relative_congestion(C("occupancy"), C("most"))
    return route_load.occupancy(v("typical")).select("route", "seq", percent.alias("percent")).withColumn("level", num.congestion_level(C("percent")))


@query("qry_congestion_stops", "SELECT name, min(seq) AS seq FROM route_stop r JOIN stop_point s ON r.ars = s.ars WHERE route = 'R07' GROUP BY name ORDER BY seq, name")
def _(v):
    return v("route_stop").where("route = 'R07'").join(v("stop_point").select("ars", "name"), "ars").groupBy("name").agg(F.min("seq").alias("seq")).orderBy("seq", "name")


_PLACED = """st AS (SELECT *, row_number() OVER (PARTITION BY route, variant ORDER BY seq) - 1 AS pos, count(*) OVER (PARTITION BY route, variant, ars) AS times FROM station),
    pairs AS (SELECT t.route, board_seq, board_ars, alight_seq, alight_ars, passengers, f.variant, f.pos AS from_at, g.pos AS to_at, g.pos - f.pos AS span,
        CASE WHEN f.times > 1 OR g.times > 1 THEN abs(f.seq - board_seq) + abs(g.seq - alight_seq) ELSE g.pos - f.pos END AS score
        FROM typical t JOIN st f ON f.route = t.route AND f.ars = board_ars JOIN st g ON g.route = t.route AND g.variant = f.variant AND g.ars = alight_ars AND g.pos > f.pos),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY route, board_seq, board_ars, alight_seq, alight_ars, variant ORDER BY score, span, from_at) AS n FROM pairs) WHERE n = 1),
    placed AS (SELECT * EXCLUDE (m, n) FROM (SELECT *, row_number() OVER (PARTITION BY route, board_seq, board_ars, alight_seq, alight_ars ORDER BY span, variant) AS m FROM best) WHERE m = 1)"""


@query("dom_place_legs", f"SELECT * FROM (WITH {_PLACED} SELECT variant, CAST(x.pos AS INT) AS pos, sum(passengers) AS load FROM placed p JOIN (SELECT DISTINCT pos FROM st) x ON x.pos >= from_at AND x.pos < to_at GROUP BY variant, x.pos)")
def _(v):
    return route_load.placed_loads(route_load.place(v("typical"), v("station"))).withColumnRenamed("at", "pos")


@query("agg_unplaced_by_route", f"SELECT * FROM (WITH {_PLACED} SELECT t.route, sum(t.passengers) AS unplaced FROM typical t LEFT JOIN placed p USING (route, board_seq, board_ars, alight_seq, alight_ars) WHERE p.variant IS NULL GROUP BY t.route)")
def _(v):
    return route_load.place(v("typical"), v("station")).where("variant is null").groupBy("route").agg(F.sum("passengers").alias("unplaced"))


_LINK = "(SELECT variant AS lv, pos AS la FROM (SELECT variant, pos, ars, lead(ars) OVER (PARTITION BY variant ORDER BY pos) AS n FROM st) WHERE ars = '00018' AND n = '00019')"


@query("dom_select_link", f"SELECT * FROM (WITH {_PLACED} SELECT route, board_ars, alight_ars, sum(passengers) AS passengers FROM placed WHERE EXISTS (SELECT 1 FROM {_LINK} l WHERE lv = variant AND la >= from_at AND la < to_at) GROUP BY 1, 2, 3)")
def _(v):
    stations = v("station")
    hit = route_load.legs_crossing(v("typical"), stations, "00018", "00019")
    return hit.groupBy("route", "board_ars", "alight_ars").agg(F.sum("passengers").alias("passengers"))


_GAPS = _PLACED.replace("FROM station)", "FROM station_gap)")
_SEG = "seg AS (SELECT variant, route, pos, from_ars, to_ars, CASE WHEN from_ars IS NULL OR to_ars IS NULL THEN variant || '#' || pos END AS alone FROM (SELECT variant, route, pos, ars AS from_ars, lead(ars) OVER (PARTITION BY variant ORDER BY pos) AS to_ars FROM st))"
_LOAD = "ld AS (SELECT variant, x.pos, sum(passengers) AS load FROM placed p JOIN (SELECT DISTINCT pos FROM st) x ON x.pos >= from_at AND x.pos < to_at GROUP BY variant, x.pos)"


@query("dom_merge_segments", f"""SELECT * FROM (WITH {_GAPS}, {_SEG}, {_LOAD} SELECT from_ars, to_ars, alone, sum(load) AS load, CAST(sum(n) AS BIGINT) AS variants, string_agg(route || ':' || CAST(load AS BIGINT), ';' ORDER BY route) AS by_route FROM
    (SELECT from_ars, to_ars, alone, route, sum(load) AS load, count(DISTINCT variant) AS n FROM ld JOIN seg USING (variant, pos) GROUP BY ALL) GROUP BY ALL)""")
def _(v):
    stations = v("station_gap")
    merged = route_load.merged_segments(route_load.placed_loads(route_load.place(v("typical"), stations)), stations)
    listed = F.transform(F.map_entries("by_route"), lambda x: F.concat_ws(":", x["key"], x["value"].cast("long")))
    return merged.withColumn("by_route", F.array_join(listed, ";"))


@query("dom_area_legs", "SELECT how, sum(passengers) AS passengers FROM (SELECT 'from' AS how, passengers FROM typical WHERE board_ars <= '00040' UNION ALL SELECT 'to', passengers FROM typical WHERE alight_ars <= '00040' UNION ALL SELECT 'any', passengers FROM typical WHERE board_ars <= '00040' OR alight_ars <= '00040') GROUP BY how")
def _(v):
    stops = v("stop_point").where("k <= 40")
    parts = [route_load.area_legs(v("typical"), stops, how).agg(F.sum("passengers").alias("passengers")).select(F.lit(how).alias("how"), "passengers") for how in ("from", "to", "any")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_SPLIT = ", ".join(f"coalesce(sum(CASE WHEN {c} THEN passengers END), 0e0) AS {n}" for n, c in (
    ("within", "board_seq BETWEEN 10 AND 20 AND alight_seq BETWEEN 10 AND 20"), ("leaving", "board_seq BETWEEN 10 AND 20 AND alight_seq > 20"),
    ("entering", "board_seq < 10 AND alight_seq BETWEEN 10 AND 20"), ("through", "board_seq < 10 AND alight_seq > 20")))


_STOPS = "(SELECT route, seq, min(ars) AS ars FROM (SELECT route, board_seq AS seq, board_ars AS ars FROM typical UNION ALL SELECT route, alight_seq, alight_ars FROM typical) GROUP BY route, seq)"
_ENDS = "(SELECT route, {0} AS seq, sum(passengers) AS p FROM " + _ORD + " WHERE {1} GROUP BY 1, 2)"
_LIST = "(SELECT route, string_agg(seq || ':' || CAST(p AS BIGINT), ';' ORDER BY p DESC, seq) AS top FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY p DESC, seq) AS n FROM {0}) WHERE n <= 10 GROUP BY route)"


def _listed(column: str, *more: str):
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["seq"], *[x[c] for c in more], x["riders"].cast("long"))), ";")


@query("dom_route_segment", f"""SELECT s.route, s.seq, s.ars, coalesce(f.ons, 0) AS boardings, coalesce(f.offs, 0) AS alightings, coalesce(f.load, 0) AS load, coalesce(l.p, 0) AS leaving, sum(coalesce(l.p, 0)) OVER (PARTITION BY s.route ORDER BY s.seq) AS leaving_so_far,
    t.within, t.leaving AS out, t.entering, t.through, b.top AS beyond, e.top AS earlier FROM {_STOPS} s LEFT JOIN (SELECT *, greatest(sum(ons - offs) OVER (PARTITION BY route ORDER BY seq), 0e0) AS load FROM ({_FLOW.format(_ORD)})) f ON f.route = s.route AND f.seq = s.seq
    LEFT JOIN {_ENDS.format('board_seq', 'board_seq BETWEEN 10 AND 20 AND alight_seq > 20')} l ON l.route = s.route AND l.seq = s.seq LEFT JOIN (SELECT route, {_SPLIT} FROM {_ORD} GROUP BY route) t ON t.route = s.route
    LEFT JOIN {_LIST.format(_ENDS.format('alight_seq', 'board_seq BETWEEN 10 AND 20 AND alight_seq > 20'))} b ON b.route = s.route LEFT JOIN {_LIST.format(_ENDS.format('board_seq', 'board_seq < 10 AND alight_seq BETWEEN 10 AND 20'))} e ON e.route = s.route WHERE s.seq BETWEEN 10 AND 20""")
def _(v):
    out = cohorts.segment_report(v("typical"), 10, 20)
    return out.withColumns({"beyond": _listed("beyond"), "earlier": _listed("earlier")})


@query("agg_core_segment_share", f"SELECT route, within / (within + leaving + entering + through) AS share FROM (SELECT route, {_SPLIT} FROM {_ORD} GROUP BY route)")
def _(v):
    return route_load.segment_split(v("typical"), 10, 20).select("route", (C("within") / (C("within") + C("leaving") + C("entering") + C("through"))).alias("share"))


@query("agg_segment_ends", "SELECT variant, min(CASE WHEN ars LIKE '%1' THEN seq END) AS first_seq, max(CASE WHEN ars LIKE '%9' OR ars = '00300' THEN seq END) AS last_seq FROM station GROUP BY variant")
def _(v):
    ends = lambda p: F.when(ids.matches_patterns(C("ars"), C("ars"), F.lit(p)), C("seq"))
    return v("station").groupBy("variant").agg(F.min(ends("%1")).alias("first_seq"), F.max(ends("%9|ars:00300")).alias("last_seq"))


@query("agg_crossing", "SELECT route, board_seq, sum(passengers) AS riders, sum(sum(passengers)) OVER (PARTITION BY route ORDER BY board_seq DESC) AS beyond FROM typical WHERE board_seq <= 20 AND alight_seq > 20 GROUP BY route, board_seq")
def _(v):
    riders = v("typical").where("board_seq <= 20 and alight_seq > 20").groupBy("route", "board_seq").agg(F.sum("passengers").alias("riders"))
    return riders.withColumn("beyond", F.sum("riders").over(Window.partitionBy("route").orderBy(F.desc("board_seq"))))


@query("agg_alight_by_stop", "SELECT alight_seq, alight_ars, sum(passengers) AS p FROM typical WHERE route = 'R03' AND board_seq BETWEEN 5 AND 15 GROUP BY 1, 2")
def _(v):
    return v("typical").where("route = 'R03' and board_seq between 5 and 15").groupBy("alight_seq", "alight_ars").agg(F.sum("passengers").alias("p"))


_LEVELS = (25.0, 50.0, 100.0, 200.0)
_COHORT = f"(SELECT s.route, s.seq, t.board_seq, t.alight_seq, t.alight_ars, t.passengers FROM {_STOPS} s JOIN {_ORD} t ON t.route = s.route AND t.board_seq <= s.seq AND t.alight_seq > s.seq)"
_TOPS = "(SELECT route, seq, string_agg(other || ':' || ars || ':' || CAST(p AS BIGINT), ';' ORDER BY p DESC, other) AS top FROM (SELECT *, row_number() OVER (PARTITION BY route, seq ORDER BY p DESC, other) AS n FROM {0}) WHERE n <= {1} GROUP BY route, seq)"
_FROM_TO = "(SELECT t.route, {0} AS seq, {1} AS other, min(s.ars) AS ars, sum(passengers) AS p FROM " + _ORD + " t JOIN " + _STOPS + " s ON s.route = t.route AND s.seq = {1} GROUP BY 1, 2, 3)"
_STILL = f"(SELECT c.route, c.seq, j.seq AS j, sum(CASE WHEN c.alight_seq > j.seq THEN c.passengers ELSE 0e0 END) AS p FROM {_COHORT} c JOIN {_STOPS} j ON j.route = c.route AND j.seq >= c.seq GROUP BY 1, 2, 3)"


@query("dom_stop_detail_reach", f"""SELECT s.route, s.seq, s.ars, coalesce(f.ons, 0e0) AS boardings, coalesce(f.offs, 0e0) AS alightings, coalesce(o.p, 0e0) AS on_board, d.top AS destinations, g.top AS origins, r.reach FROM {_STOPS} s
    LEFT JOIN ({_FLOW.format(_ORD)}) f ON f.route = s.route AND f.seq = s.seq LEFT JOIN (SELECT route, seq, sum(passengers) AS p FROM {_COHORT} GROUP BY 1, 2) o ON o.route = s.route AND o.seq = s.seq
    LEFT JOIN {_TOPS.format(_FROM_TO.format('board_seq', 'alight_seq'), 10)} d ON d.route = s.route AND d.seq = s.seq LEFT JOIN {_TOPS.format(_FROM_TO.format('alight_seq', 'board_seq'), 10)} g ON g.route = s.route AND g.seq = s.seq
    LEFT JOIN (SELECT route, seq, concat_ws(';', {', '.join(f"coalesce(CAST(max(CASE WHEN p > {x}e0 THEN j END) AS VARCHAR), '-')" for x in _LEVELS)}) AS reach FROM {_STILL} GROUP BY 1, 2) r ON r.route = s.route AND r.seq = s.seq""")
def _(v):
    out = cohorts.stop_details(v("typical"), _LEVELS)
    reach = F.array_join(F.transform("reach", lambda x: F.coalesce(x["until"].cast("string"), F.lit("-"))), ";")
    return out.withColumns({"destinations": _listed("destinations", "ars"), "origins": _listed("origins", "ars"), "reach": reach})


_OFFS = "(SELECT DISTINCT route, alight_seq AS j FROM typical)"


@query("dom_stop_load_report", f"""SELECT o.route, o.seq, o.on_board, o.cut_0, o.cut_1, o.early_0, r.reach_0, r.reach_1, d.top AS destinations FROM
    (SELECT route, seq, sum(passengers) AS on_board, sum(CASE WHEN alight_seq > 15 THEN passengers ELSE 0e0 END) AS cut_0, sum(CASE WHEN alight_seq > 22 THEN passengers ELSE 0e0 END) AS cut_1, sum(CASE WHEN board_seq < 12 THEN passengers ELSE 0e0 END) AS early_0 FROM {_COHORT} WHERE seq BETWEEN 10 AND 25 GROUP BY 1, 2) o
    LEFT JOIN (SELECT route, seq, max(CASE WHEN p > 50 THEN j END) AS reach_0, max(CASE WHEN p > 150 THEN j END) AS reach_1 FROM (SELECT c.route, c.seq, j, sum(passengers) AS p FROM {_COHORT} c JOIN {_OFFS} js ON js.route = c.route AND js.j >= c.seq AND c.alight_seq > js.j GROUP BY 1, 2, 3) GROUP BY 1, 2) r ON r.route = o.route AND r.seq = o.seq
    LEFT JOIN {_TOPS.format(f"(SELECT c.route, c.seq, c.alight_seq AS other, min(c.alight_ars) AS ars, sum(passengers) AS p FROM {_COHORT} c GROUP BY 1, 2, 3)", 5)} d ON d.route = o.route AND d.seq = o.seq""")
def _(v):
    ahead = cohorts.load_report(v("typical"), 10, 25, (15, 22), True, 5, (50.0, 150.0))
    behind = cohorts.load_report(v("typical"), 10, 25, (12,), False, 5, ())
    both = ahead.join(behind.select("route", "seq", C("cut_0").alias("early_0")), ["route", "seq"])
    return both.withColumn("destinations", _listed("destinations", "ars"))


@query("dom_busiest_routes", f"SELECT route, max(load) AS most FROM (SELECT route, greatest(sum(ons - offs) OVER (PARTITION BY route ORDER BY seq), 0e0) AS load FROM ({_FLOW.format(_ORD)})) GROUP BY route ORDER BY most DESC, route")
def _(v):
    return route_load.on_board(v("typical")).groupBy("route").agg(F.max("load").alias("most")).orderBy(F.desc("most"), "route")


@query("dom_shadow_check", f"""SELECT route, seq, a.load = b.load AS equal FROM (SELECT route, seq, greatest(sum(ons - offs) OVER (PARTITION BY route ORDER BY seq), 0e0) AS load FROM ({_FLOW.format(_ORD)})) a
    JOIN (SELECT t.route, s.seq, sum(passengers) AS load FROM typical t JOIN (SELECT DISTINCT seq FROM route_stop) s ON s.seq >= board_seq AND s.seq < alight_seq GROUP BY t.route, s.seq) b USING (route, seq)""")
def _(v):
    chart = route_load.on_board(v("typical")).select("route", "seq", C("load").alias("a"))
    return chart.join(route_load.segment_loads(v("typical")), ["route", "seq"]).select("route", "seq", (C("a") == C("load")).alias("equal"))


@query("dom_turnaround_guess", "SELECT route, CAST(median((a.seq + b.seq) / 2) AS DOUBLE) AS turn FROM route_stop a JOIN route_stop b USING (route, ars) WHERE a.seq < b.seq GROUP BY route HAVING count(*) >= 3")
def _(v):
    a = v("route_stop")
    pairs = a.join(a.select("route", "ars", C("seq").alias("b_seq")), ["route", "ars"]).where("seq < b_seq")
    return pairs.groupBy("route").agg(F.median((C("seq") + C("b_seq")) / 2).alias("turn"), F.count(F.lit(1)).alias("n")).where("n >= 3").drop("n")


_POINT = "lng * 1e0 AS lng, lat * 1e0 AS lat"
_PATH = f"""pv AS (SELECT variant, vertex, {_POINT} FROM path_vertex), sn AS (SELECT route, variant, seq, ars, lng, lat, lead(seq) OVER w AS next_seq, lead(ars) OVER w AS to_ars FROM station JOIN stop_point USING (ars) WINDOW w AS (PARTITION BY variant ORDER BY seq)),
    step AS (SELECT variant, vertex, 6371000e0 * sqrt(pow(radians(lng - lag(lng) OVER w) * cos(radians((lat + lag(lat) OVER w) / 2)), 2) + pow(radians(lat - lag(lat) OVER w), 2)) AS m FROM pv WINDOW w AS (PARTITION BY variant ORDER BY vertex)),
    sg AS (SELECT sn.route, sn.variant, seq, next_seq, ars AS from_ars, to_ars, (SELECT sum(m) FROM step WHERE step.variant = sn.variant AND step.vertex > 2 * seq AND step.vertex <= 2 * next_seq) AS metres,
        (SELECT string_agg(printf('%.7f %.7f', lng, lat), ', ' ORDER BY vertex) FROM pv WHERE pv.variant = sn.variant AND pv.vertex BETWEEN 2 * seq AND 2 * next_seq) AS line FROM sn WHERE next_seq IS NOT NULL)"""


def _segments(v):
    """Segments of every variant over the path that its stations are matched to; ``route`` is the variant's name."""
    number = lambda c: C(c).cast("double").alias(c)
    stations = v("station").join(v("stop_point").select("ars", "lng", "lat"), "ars").select(C("variant").alias("route"), C("route").alias("line"), C("seq").cast("long").alias("seq"), "ars", number("lng"), number("lat"))
    path = v("path_vertex").select(C("variant").alias("route"), C("vertex").cast("long").alias("vertex"), number("lng"), number("lat"))
    matched = paths.match_stations(stations, path).select("route", "seq", "vertex")
    return stations, segments.build(stations.join(matched, ["route", "seq"]), path, ["ars"])


@query("dom_build_segments", f"SELECT * FROM (WITH {_PATH} SELECT variant, seq, next_seq, from_ars, to_ars, round(metres, 3) AS metres, 'LINESTRING(' || line || ')' AS wkt FROM sg)")
def _(v):
    return _segments(v)[1].select(C("route").alias("variant"), "seq", "next_seq", "from_ars", "to_ars", F.round("metres", 3).alias("metres"), geo.linestring(C("points")).alias("wkt"))


@query("qry_route_path", f"""SELECT * FROM (WITH {_PATH}, n AS (SELECT route, variant, count(*) AS n FROM station GROUP BY ALL), best AS (SELECT route, arg_min(variant, (-n, variant)) AS variant FROM n GROUP BY route)
    SELECT b.route, b.variant, round((SELECT sum(metres) FROM sg WHERE sg.variant = b.variant), 2) AS metres, (SELECT 'LINESTRING(' || string_agg(printf('%.7f %.7f', lng, lat), ', ' ORDER BY vertex) || ')' FROM pv WHERE pv.variant = b.variant) AS wkt,
        (SELECT min(seq) FROM station s WHERE s.variant = b.variant AND seq >= 20) AS turn_seq, (SELECT count(DISTINCT ars) FROM station s WHERE s.route = b.route) AS stops FROM best b)""")
def _(v):
    stations, built = _segments(v)
    chosen = segments.longest(stations.select("line", C("route").alias("variant")), "line", "variant")
    lines = segments.whole_lines(built).withColumnRenamed("route", "variant")
    turn = segments.turnarounds(stations.withColumn("turn", C("seq") >= 20)).withColumnRenamed("route", "variant")
    stops = stations.groupBy("line").agg(F.count_distinct("ars").alias("stops"))
    out = chosen.join(lines, "variant").join(turn, "variant", "left").join(stops, "line")
    return out.select(C("line").alias("route"), "variant", F.round("metres", 2).alias("metres"), geo.linestring(C("points")).alias("wkt"), C("turn_seq").cast("int").alias("turn_seq"), "stops")


@query("dom_bounds", "SELECT route, min(lng) AS x0, max(lng) AS x1, min(lat) AS y0, max(lat) AS y1 FROM route_stop JOIN stop_point USING (ars) GROUP BY route")
def _(v):
    return v("route_stop").join(v("stop_point"), "ars").groupBy("route").agg(F.min("lng").alias("x0"), F.max("lng").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))


@query("dom_client_load_on", f"SELECT seq, sum(load) AS load FROM (SELECT t.route, s.seq, sum(passengers) AS load FROM typical t JOIN (SELECT DISTINCT seq FROM route_stop) s ON s.seq >= board_seq AND s.seq < alight_seq WHERE route IN ('R01', 'R05', 'R11') GROUP BY t.route, s.seq) GROUP BY seq HAVING sum(load) >= 2000")
def _(v):
    return route_load.segment_loads(v("typical").where(C("route").isin("R01", "R05", "R11"))).groupBy("seq").agg(F.sum("load").alias("load")).where("load >= 2000")


@query("qry_list_stops", f"SELECT route, seq, ons, offs FROM ({_FLOW.format('typical')})")
def _(v):
    return route_load.stop_flows(v("typical"))


# ---------------------------------------------------------------- profiles

@query("agg_month_counts", """SELECT use_ym, %s FROM (SELECT use_ym, CASE WHEN h.date IS NOT NULL THEN 'sun_holiday' ELSE CASE isodow(d) WHEN 1 THEN 'mon' WHEN 2 THEN 'tue' WHEN 3 THEN 'wed' WHEN 4 THEN 'thu' WHEN 5 THEN 'fri' WHEN 6 THEN 'sat' ELSE 'sun_holiday' END END AS t
    FROM (SELECT use_ym, CAST(unnest(generate_series(first, last_day(first), INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT DISTINCT use_ym, make_date(use_ym // 100, use_ym %% 100, 1) AS first FROM boarding_month)) LEFT JOIN holiday h ON h.date = d) GROUP BY use_ym""" % ", ".join(f"CAST(count(*) FILTER (WHERE t = '{d}') AS BIGINT) AS {d}" for d in cal.DAY_TYPES))
def _(v):
    """The months that have counts."""
    return hourly.month_counts(hourly.month_days(v("boarding_month")), v("holiday"))


@query("agg_holiday_coverage", "SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM orders WHERE year(o_orderdate) NOT IN (SELECT year(date) FROM holiday)")
def _(v):
    years = v("orders").select(F.year("o_orderdate").alias("year")).distinct()
    return years.join(v("holiday").select(F.year("date").alias("year")).distinct(), "year", "left_anti")


@query("agg_monthly_hourly", "SELECT use_ym, route, ars, hour, sum(boardings) AS boardings FROM boarding_month GROUP BY ALL")
def _(v):
    return v("boarding_month").groupBy("use_ym", "route", "ars", "hour").agg(F.sum("boardings").alias("boardings"))


@query("agg_merge_visits", """SELECT k.use_ym, k.route, k.ars, visit, h.hour, coalesce(b.boardings, 0e0) AS boardings FROM (SELECT use_ym, route, ars, min(visit) AS visit FROM boarding_month GROUP BY ALL) k CROSS JOIN (SELECT DISTINCT hour FROM boarding_month) h
    LEFT JOIN (SELECT use_ym, route, ars, hour, sum(boardings) AS boardings FROM boarding_month GROUP BY ALL) b ON b.use_ym = k.use_ym AND b.route = k.route AND b.ars = k.ars AND b.hour = h.hour""")
def _(v):
    return hourly.visits_merged(v("boarding_month"))


def _two_classes(v):
    h = v("holiday")
    counts = hourly.month_counts(hourly.calendar(h.sparkSession, "1995-01-01", "2001-08-31"), h)
    work = sum((C(d) for d in cal.DAY_TYPES[1:5]), C("mon"))
    return counts.select("use_ym", work.alias("work"), (C("sat") + C("sun_holiday")).alias("rest"))


_COUNTS2 = "SELECT use_ym, sum(CASE WHEN t THEN 1e0 ELSE 0e0 END) AS w, sum(CASE WHEN t THEN 0e0 ELSE 1e0 END) AS r FROM (SELECT CAST(year(d) * 100 + month(d) AS INT) AS use_ym, h.date IS NULL AND isodow(d) < 6 AS t FROM (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-08-31', INTERVAL 1 DAY)) AS DATE) AS d) LEFT JOIN holiday h ON h.date = d) GROUP BY use_ym"


@query("agg_lstsq_simple", f"""SELECT route, hour, day_type, round(CASE WHEN day_type = 'work' THEN (rr * wb - wr * rb) / (ww * rr - wr * wr) ELSE (ww * rb - wr * wb) / (ww * rr - wr * wr) END, 3) AS x FROM
    (SELECT route, hour, sum(w * w) AS ww, sum(w * r) AS wr, sum(r * r) AS rr, sum(w * b) AS wb, sum(r * b) AS rb FROM (SELECT use_ym, route, hour, sum(boardings) AS b FROM boarding_month GROUP BY ALL) JOIN ({_COUNTS2}) USING (use_ym) GROUP BY route, hour HAVING count(*) >= 3)
    CROSS JOIN (VALUES ('work'), ('rest')) k(day_type)""")
def _(v):
    values = v("boarding_month").groupBy("use_ym", "route", "hour").agg(F.sum("boardings").alias("b"))
    x = hourly.solve(_two_classes(v), values, ["route", "hour"], "b", ["work", "rest"], clip=False)
    return x.withColumn("x", F.round("x", 3))


@query("agg_lstsq_grouped")
def _(v):
    h = v("holiday")
    counts = hourly.month_counts(hourly.calendar(h.sparkSession, "1995-01-01", "2001-08-31"), h)
    values = v("boarding_month").groupBy("use_ym", "route", "hour").agg(F.sum("boardings").alias("b"))
    return hourly.solve(counts, values, ["route", "hour"], "b", list(cal.DAY_TYPES))


_RATIO = "(SELECT route, ars, hour, CASE WHEN sum(sum(boardings)) OVER (PARTITION BY route, ars) = 0 THEN 0e0 ELSE sum(boardings) / sum(sum(boardings)) OVER (PARTITION BY route, ars) END AS ratio FROM boarding_hour GROUP BY route, ars, hour)"


def _ratios(v):
    return hourly.ratios(v("boarding_hour").groupBy("route", "ars", "hour").agg(F.sum("boardings").alias("boardings")), ["route", "ars"], "boardings")


@query("agg_ratio_normalise", f"SELECT * FROM {_RATIO}")
def _(v):
    return _ratios(v).select("route", "ars", "hour", "ratio")


@query("agg_profile_validate", f"SELECT route, ars FROM {_RATIO} GROUP BY route, ars HAVING NOT (count(*) = 24 AND count(DISTINCT hour) = 24)")
def _(v):
    return hourly.bad_profiles(_ratios(v), ["route", "ars"]).select("route", "ars")


@query("val_pattern_sums", """SELECT route, CAST(count(*) AS BIGINT) AS groups, CAST(count(*) FILTER (WHERE s = 0) AS BIGINT) AS zero, CAST(count(*) FILTER (WHERE s <> 0 AND abs(s - 1) > 0.01) AS BIGINT) AS off FROM (SELECT route, ars, coalesce(sum(CASE WHEN hour <> 5 THEN b / nullif(total, 0) END), 0) AS s FROM
    (SELECT route, ars, hour, sum(boardings) AS b, sum(sum(boardings)) OVER (PARTITION BY route, ars) AS total FROM hour_count GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY route""")
def _(v):
    """Profiles of which an hour was lost."""
    sums = v("hour_count").groupBy("route", "ars", "hour").agg(F.sum("boardings").alias("boardings"))
    ratios = hourly.ratios(sums, ["route", "ars"], "boardings").withColumn("ratio", F.when(C("hour") != 5, C("ratio")).otherwise(0.0))
    return hourly.pattern_sums(ratios, ["route", "ars"], ["route"])


_DAYRATIO = """(SELECT route, ars, day_type, hour, CASE WHEN sum(sum(boardings)) OVER w = 0 THEN 0e0 ELSE sum(boardings) / sum(sum(boardings)) OVER w END AS ratio FROM (SELECT route, ars, hour, boardings, CAST(isodow(day) AS INT) AS day_type FROM boarding_hour) GROUP BY route, ars, day_type, hour WINDOW w AS (PARTITION BY route, ars, day_type))"""


@query("agg_weekday_mean", f"SELECT route, ars, hour, round(avg(ratio), 9) AS ratio FROM {_DAYRATIO} WHERE day_type <= 5 AND ratio > 0 GROUP BY route, ars, hour")
def _(v):
    sums = v("boarding_hour").groupBy("route", "ars", cal.weekday_type(C("day")).alias("day_type"), "hour").agg(F.sum("boardings").alias("boardings"))
    profiles = hourly.ratios(sums, ["route", "ars", "day_type"], "boardings").withColumn("fitted", C("ratio") > 0)
    return hourly.weekday_means(profiles).withColumn("ratio", F.round("ratio", 9))


_DEF = "[" + ", ".join(f"{x}e0" for x in hourly.DEFAULT_PROFILE) + "]"
_SUMS = "(SELECT route, ars, hour, sum(boardings) AS b FROM hour_count GROUP BY route, ars, hour)"
_TRIPS = "(SELECT route, coalesce(board_ars, '00000') AS ars, sum(passengers) AS passengers FROM trip GROUP BY 1, 2)"
_FULL = f"(SELECT route, ars, sum(b) AS total FROM {_SUMS} GROUP BY route, ars)"
_SHARE = f"CASE WHEN f.total > 0 THEN coalesce(q.b, 0e0) / f.total ELSE {_DEF}[h.hour + 1] / list_sum({_DEF}) END"
_SPREAD = f"""(SELECT t.route, t.ars, h.hour, CASE WHEN f.total IS NULL THEN 'default_no_key' WHEN f.total = 0 THEN 'default_zero_fit' ELSE 'fitted' END AS method, t.passengers * {_SHARE} AS hourly
    FROM {_TRIPS} t CROSS JOIN (SELECT unnest(range(24)) AS hour) h LEFT JOIN {_FULL} f ON f.route = t.route AND f.ars = t.ars LEFT JOIN {_SUMS} q ON q.route = t.route AND q.ars = t.ars AND q.hour = h.hour)"""


def _boarders(v):
    return v("trip").groupBy("route", ids.ars_or_virtual(C("board_ars")).alias("ars")).agg(F.sum("passengers").alias("passengers"))


def _spread(v):
    return hourly.spread_over(_boarders(v), hourly.day_profiles(v("hour_count")))


@query("dom_estimate_hourly", f"SELECT route, ars, CAST(hour AS INT) AS hour, method, round(hourly, 9) AS hourly FROM {_SPREAD}")
def _(v):
    return _spread(v).select("route", "ars", "hour", "method", F.round("hourly", 9).alias("hourly"))


@query("dom_select_profile", f"SELECT route, ars, any_value(method) AS method, CAST(count(*) AS BIGINT) AS hours FROM {_SPREAD} GROUP BY route, ars")
def _(v):
    chosen = hourly.with_profile(_boarders(v), hourly.day_profiles(v("hour_count")))
    return chosen.select("route", "ars", "method", F.size("used").cast("long").alias("hours"))


@query("agg_method_breakdown", f"SELECT method, count(DISTINCT route || ars) AS stops, round(sum(hourly), 6) AS riders FROM {_SPREAD} GROUP BY method")
def _(v):
    return _spread(v).groupBy("method").agg(F.count_distinct("route", "ars").alias("stops"), F.round(F.sum("hourly"), 6).alias("riders"))


@query("agg_no_dup_methods", f"SELECT route, ars, hour FROM {_SPREAD} GROUP BY 1, 2, 3 HAVING count(DISTINCT method) > 1")
def _(v):
    return _spread(v).groupBy("route", "ars", "hour").agg(F.count_distinct("method").alias("n")).where("n > 1").drop("n")


@query("dom_hourly_share", f"SELECT route, ars, method, round(sum(hourly), 6) AS riders FROM {_SPREAD} WHERE hour BETWEEN 7 AND 9 AND regexp_matches(ars, '^[0-9]{{5}}$') AND ars <> '00000' GROUP BY route, ars, method")
def _(v):
    # written, so that the condition on numbers sees a row per stop: it would move below the sums, to every trip
    boarders = saved(v("trip").groupBy("route", C("board_ars").alias("ars")).agg(F.sum("passengers").alias("passengers")), "boarders")
    return hourly.riders_in_hours(boarders, hourly.day_profiles(v("hour_count")), 7, 9).select("route", "ars", "method", F.round("riders", 6).alias("riders"))


@query("dom_legend_max", f"""SELECT * FROM (WITH {_GAPS}, {_SEG}, hours AS (SELECT unnest(range(24)) AS hour),
    ld AS (SELECT variant, x.pos, board_ars, sum(passengers) AS passengers FROM placed p JOIN (SELECT DISTINCT pos FROM st) x ON x.pos >= from_at AND x.pos < to_at GROUP BY variant, x.pos, board_ars),
    hl AS (SELECT s.from_ars, s.to_ars, s.alone, h.hour, sum({_SHARE} * passengers) AS riders FROM ld p JOIN seg s USING (variant, pos) CROSS JOIN hours h LEFT JOIN {_FULL} f ON f.route = s.route AND f.ars = p.board_ars
        LEFT JOIN {_SUMS} q ON q.route = s.route AND q.ars = p.board_ars AND q.hour = h.hour GROUP BY ALL)
    SELECT CAST(hour AS INT) AS hour, round(max(riders), 4) AS most, round(max(max(riders)) OVER (), 4) AS of_day FROM hl GROUP BY hour)""")
def _(v):
    stations = v("station_gap")
    usable = hourly.day_profiles(v("hour_count")).where("total > 0").select("route", "ars", C("profile").alias("share"))
    loads = route_load.hourly_loads(route_load.place(v("typical"), stations), usable, hourly.default_profile())
    most = route_load.legend(loads, stations)
    return most.select("hour", F.round("most", 4).alias("most"), F.round(F.max("most").over(Window.partitionBy()), 4).alias("of_day"))


@query("qry_profiles_default", f"""SELECT t.route || '|' || t.ars AS key, CAST(h.hour AS INT) AS hour, round({_SHARE}, 9) AS share, NOT coalesce(f.total > 0, false) AS by_default
    FROM (SELECT DISTINCT route, ars FROM route_stop) t CROSS JOIN (SELECT unnest(range(24)) AS hour) h LEFT JOIN {_FULL} f ON f.route = t.route AND f.ars = t.ars LEFT JOIN {_SUMS} q ON q.route = t.route AND q.ars = t.ars AND q.hour = h.hour""")
def _(v):
    """The profile of every stop of every route, by ``route|stop``; the default stands in where a stop has none."""
    found = hourly.with_profile(v("route_stop").select("route", "ars").distinct(), hourly.day_profiles(v("hour_count")))
    rows = found.select(F.concat_ws("|", "route", "ars").alias("key"), F.posexplode("used").alias("hour", "share"), (C("method") != hourly.FITTED).alias("by_default"))
    return rows.withColumn("share", F.round("share", 9))


@query("qry_hourly_pairs", "SELECT ars, sum(boardings) AS boardings FROM boarding_hour WHERE route = 'click' AND hour = 8 GROUP BY ars HAVING sum(boardings) > 0")
def _(v):
    return v("boarding_hour").where("route = 'click' and hour = 8").groupBy("ars").agg(F.sum("boardings").alias("boardings")).where("boardings > 0")


@query("agg_integrated_union", "SELECT mode, hour, count(*) AS rows, CAST(sum(round_even(boardings, 0)) AS BIGINT) AS boardings FROM demand GROUP BY mode, hour")
def _(v):
    return v("demand").groupBy("mode", "hour").agg(F.count(F.lit(1)).alias("rows"), F.sum(num.to_count(C("boardings"))).alias("boardings"))


@query("val_integrated_profile", """SELECT 'rows' AS section, mode, CAST(NULL AS INT) AS hour, NULL AS service, NULL AS node, count(*) AS rows, CAST(NULL AS BIGINT) AS boardings, CAST(NULL AS BIGINT) AS alightings, CAST(NULL AS INT) AS place FROM demand GROUP BY mode
    UNION ALL SELECT 'hours', mode, hour, NULL, NULL, NULL, CAST(sum(round_even(boardings, 0)) AS BIGINT), CAST(sum(round_even(alightings, 0)) AS BIGINT), NULL FROM demand GROUP BY mode, hour
    UNION ALL SELECT 'top', mode, NULL, service, node, NULL, b, NULL, CAST(n AS INT) FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY b DESC, service, node) AS n FROM (SELECT mode, service, node, CAST(sum(round_even(boardings, 0)) AS BIGINT) AS b FROM demand GROUP BY 1, 2, 3)) WHERE n <= 20""")
def _(v):
    return demand.integrated_report(v("demand"))


@query("agg_band_profile", """SELECT band, hour, round(s / sum(s) OVER (PARTITION BY band), 9) AS share FROM (SELECT band, hour, avg(m) AS s FROM (SELECT CASE WHEN CAST(ars AS INT) < 5 THEN '0-4' WHEN CAST(ars AS INT) < 12 THEN '4-12' ELSE '12+' END AS band, ars, hour, avg(boardings) AS m FROM
    (SELECT use_ym, ars, hour, sum(boardings) AS boardings FROM boarding_month GROUP BY ALL) GROUP BY ALL) GROUP BY band, hour)""")
def _(v):
    month = v("boarding_month").groupBy("use_ym", "ars", "hour").agg(F.sum("boardings").alias("b"))
    n = C("ars").cast("int")
    band = F.when(n < 5, "0-4").when(n < 12, "4-12").otherwise("12+").alias("band")
    means = month.groupBy(band, "ars", "hour").agg(F.avg("b").alias("m")).groupBy("band", "hour").agg(F.avg("m").alias("s"))
    return means.select("band", "hour", F.round(C("s") / F.sum("s").over(Window.partitionBy("band")), 9).alias("share"))


@query("agg_monthly_change", "SELECT route, use_ym, s - lag(s) OVER (PARTITION BY route ORDER BY use_ym) AS change, peak FROM (SELECT route, use_ym, sum(b) AS s, arg_max(hour, (b, -hour)) AS peak FROM (SELECT route, use_ym, hour, sum(boardings) AS b FROM boarding_month GROUP BY ALL) GROUP BY ALL)")
def _(v):
    sums = v("boarding_month").groupBy("route", "use_ym", "hour").agg(F.sum("boardings").alias("b"))
    months = sums.groupBy("route", "use_ym").agg(F.sum("b").alias("s"), F.max_by("hour", F.struct("b", -C("hour"))).alias("peak"))
    return months.select("route", "use_ym", (C("s") - F.lag("s").over(Window.partitionBy("route").orderBy("use_ym"))).alias("change"), "peak")


@query("agg_not_empty", "SELECT (SELECT count(*) FROM raw_od) > 0 AS filled, CAST(count(*) FILTER (WHERE NOT regexp_matches(board_ars, '^[0-9]{5}$')) AS BIGINT) AS bad FROM raw_od")
def _(v):
    return v("raw_od").agg((F.count(F.lit(1)) > 0).alias("filled"), F.count_if(~C("board_ars").rlike("^[0-9]{5}$")).alias("bad"))


# ---------------------------------------------------------------- districts and periods

@query("agg_dong_flows", "SELECT CASE WHEN origin = 'outside' THEN origin ELSE left(origin, 5) END AS origin, CASE WHEN dest = 'outside' THEN dest ELSE left(dest, 5) END AS dest, sum(subway) AS subway, sum(bus) AS bus FROM flow GROUP BY 1, 2")
def _(v):
    return districts.flows_to(v("flow"), "gu")


@query("agg_dong_totals", "SELECT day_type, sum(subway) AS subway, sum(bus) AS bus, sum(CASE WHEN origin = dest THEN subway + bus ELSE 0e0 END) AS inside FROM flow GROUP BY day_type")
def _(v):
    return v("flow").groupBy("day_type").agg(F.sum("subway").alias("subway"), F.sum("bus").alias("bus"), F.sum(F.when(C("origin") == C("dest"), C("subway") + C("bus")).otherwise(0.0)).alias("inside"))


def _km(v):
    far = F.when((C("ok") < 20) & (C("dk") < 20), F.abs(C("ok") - C("dk")) * 1.25)
    return v("flow").withColumns({"km": far, "total": C("subway") + C("bus")})


_KM = "(SELECT *, CASE WHEN ok < 20 AND dk < 20 THEN abs(ok - dk) * 1.25e0 END AS km, subway + bus AS total FROM flow)"
_BAND = "CASE WHEN km IS NOT NULL THEN CASE WHEN km = 0 THEN 'same' WHEN km < 1 THEN '0-1' WHEN km < 3 THEN '1-3' WHEN km < 5 THEN '3-5' WHEN km < 10 THEN '5-10' WHEN km < 20 THEN '10-20' ELSE '20+' END WHEN dest = 'outside' THEN 'outside' ELSE 'unknown' END"


@query("agg_reach_bands", f"SELECT origin, {_BAND} AS band, sum(subway) AS subway, sum(bus) AS bus, sum(total) AS total FROM {_KM} GROUP BY 1, 2")
def _(v):
    return districts.reach(_km(v), "origin")


@query("agg_weighted_median", f"SELECT origin, floor(min(km) * 10 + 0.5) / 10 AS median FROM (SELECT origin, km, sum(w) OVER (PARTITION BY origin ORDER BY km) AS run, sum(w) OVER (PARTITION BY origin) AS a FROM (SELECT origin, km, sum(total) AS w FROM {_KM} WHERE km IS NOT NULL GROUP BY 1, 2)) WHERE a > 0 AND run >= a / 2 GROUP BY origin")
def _(v):
    return districts.weighted_median(_km(v), ["origin"], "km", "total")


@query("dom_client_flows", f"SELECT dest, total, total / sum(total) OVER () AS share FROM (SELECT dest, sum(total) AS total FROM {_KM} WHERE origin = '11013003' GROUP BY dest)")
def _(v):
    sums = _km(v).where("origin = '11013003'").groupBy("dest").agg(F.sum("total").alias("total"))
    return sums.withColumn("share", C("total") / F.sum("total").over(Window.partitionBy()))


@query("agg_bus_outside", "SELECT left(origin, 4) AS place, sum(bus) AS bus FROM flow WHERE dest = 'outside' GROUP BY 1 ORDER BY bus DESC, place LIMIT 10")
def _(v):
    return v("flow").where("dest = 'outside'").groupBy(F.left("origin", F.lit(4)).alias("place")).agg(F.sum("bus").alias("bus")).orderBy(F.desc("bus"), "place").limit(10)


@query("agg_route_flows", """SELECT route, string_agg(dong, ',' ORDER BY p DESC, dong) AS top FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY p DESC, dong) AS n FROM (SELECT route, d.dong, sum(passengers) AS p FROM typical JOIN
    (SELECT s.ars, min(dong) AS dong FROM stop_point s JOIN district ON lng BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1 GROUP BY 1) d ON alight_ars = d.ars GROUP BY 1, 2)) WHERE n <= 5 GROUP BY route""")
def _(v):
    of = spatial.covering(v("stop_point"), v("district"), 0.02).groupBy(C("ars").alias("alight_ars")).agg(F.min("dong").alias("dong"))
    sums = v("typical").join(of, "alight_ars").groupBy("route", "dong").agg(F.sum("passengers").alias("p"))
    top = lookups.top_per(sums, ["route"], [F.desc("p"), C("dong").asc()], 5)
    listed = F.sort_array(F.collect_list(F.struct((-C("p")).alias("p"), "dong")))
    return top.groupBy("route").agg(F.array_join(F.transform(listed, lambda x: x["dong"]), ",").alias("top"))


_DONG = "(SELECT s.ars, min(dong) AS dong FROM stop_point s JOIN district ON lng BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1 WHERE s.k % 11 <> 0 GROUP BY 1)"


@query("agg_route_dong_od", f"SELECT route, o.dong AS origin, d.dong AS dest, sum(passengers) AS passengers FROM typical LEFT JOIN {_DONG} o ON board_ars = o.ars LEFT JOIN {_DONG} d ON alight_ars = d.ars GROUP BY 1, 2, 3")
def _(v):
    of = spatial.covering(v("stop_point").where("k % 11 != 0"), v("district"), 0.02).groupBy("ars").agg(F.min("dong").alias("dong"))
    t = v("typical").join(of.select(C("ars").alias("board_ars"), C("dong").alias("origin")), "board_ars", "left")
    t = t.join(of.select(C("ars").alias("alight_ars"), C("dong").alias("dest")), "alight_ars", "left")
    return t.groupBy("route", "origin", "dest").agg(F.sum("passengers").alias("passengers"))


@query("agg_dong_export", "SELECT day_type, coalesce(a.d, 'outside') AS origin, sum(subway + bus) AS rides FROM flow LEFT JOIN (SELECT DISTINCT concat('110', CAST(10 + n_nationkey % 5 AS STRING), lpad(CAST(n_nationkey AS STRING), 3, '0')) AS d FROM nation WHERE n_nationkey < 15) a ON flow.origin = a.d GROUP BY 1, 2")
def _(v):
    n = C("n_nationkey")
    known = v("nation").where("n_nationkey < 15").select(F.concat(F.lit("110"), (n % 5 + 10).cast("string"), F.lpad(n.cast("string"), 3, "0")).alias("origin")).withColumn("d", C("origin"))
    joined = v("flow").join(F.broadcast(known), "origin", "left")
    return joined.groupBy("day_type", F.coalesce("d", F.lit("outside")).alias("origin")).agg(F.sum(C("subway") + C("bus")).alias("rides"))


@query("agg_period_mean", """SELECT route, board_ars, alight_ars, sum(passengers) / (SELECT count(DISTINCT service_date) FROM leg WHERE year(service_date) = 1998) AS passengers, CAST(arg_max(board_seq, (service_date, board_seq)) AS INT) AS board_seq FROM leg WHERE year(service_date) = 1998 GROUP BY 1, 2, 3""")
def _(v):
    legs = v("leg").where("year(service_date) = 1998")
    days = legs.agg(F.count_distinct("service_date").alias("days"))
    sums = legs.groupBy("route", "board_ars", "alight_ars").agg(F.sum("passengers").alias("p"), F.max_by("board_seq", F.struct("service_date", "board_seq")).alias("board_seq"))
    return sums.crossJoin(F.broadcast(days)).select("route", "board_ars", "alight_ars", (C("p") / C("days")).alias("passengers"), "board_seq")


@query("qry_period_days", "SELECT CAST(year(service_date) AS INT) AS year, count(DISTINCT service_date) AS days FROM leg GROUP BY 1")
def _(v):
    return v("leg").groupBy(F.year("service_date").alias("year")).agg(F.count_distinct("service_date").alias("days"))


@query("qry_period_range", "SELECT min(use_ym) AS first_ym, max(use_ym) AS last_ym FROM boarding_month")
def _(v):
    return v("boarding_month").agg(F.min("use_ym").alias("first_ym"), F.max("use_ym").alias("last_ym"))


_TYPED = "(SELECT *, CASE isodow(service_date) WHEN 6 THEN 'saturday' WHEN 7 THEN 'sunday' ELSE 'weekday' END AS day_type FROM leg)"


@query("dom_typical_accuracy", f"""SELECT * FROM (WITH d AS (SELECT day_type, route, board_ars, alight_ars, service_date, sum(passengers) AS p FROM {_TYPED} GROUP BY ALL), days AS (SELECT day_type, count(DISTINCT service_date) AS n, sum(p) AS everything FROM d GROUP BY day_type),
    x AS (SELECT 'route' AS level, day_type, route AS a, '' AS b, '' AS c, service_date, sum(p) AS p FROM d GROUP BY ALL UNION ALL SELECT 'stop', day_type, route, board_ars, '', service_date, sum(p) FROM d GROUP BY ALL UNION ALL SELECT 'pair', day_type, route, board_ars, alight_ars, service_date, p FROM d),
    t AS (SELECT *, sum(p) OVER (PARTITION BY level, day_type, a, b, c) AS total FROM x)
    SELECT level, day_type, service_date, round((sum(abs(p - (total - p) / (n - 1))) + (any_value(everything) - sum(total)) / any_value(n - 1)) / sum(p), 6) AS wape FROM t JOIN days USING (day_type) WHERE n > 1 GROUP BY level, day_type, service_date)""")
def _(v):
    return demand.left_out_accuracy(v("leg")).withColumn("wape", F.round("wape", 6))


@query("dom_stop_demand", "SELECT mode, node, hour, CAST(sum(round_even(boardings, 0)) AS BIGINT) AS boarding_count, 'fitted' AS method FROM demand GROUP BY mode, node, hour")
def _(v):
    sums = v("demand").groupBy("mode", "node", "hour").agg(F.sum(num.to_count(C("boardings"))).alias("boardings"))
    return sums.withColumnsRenamed({"boardings": "boarding_count"}).withColumn("method", F.lit(hourly.FITTED))


@query("qry_node_detail", "SELECT service, CAST(sum(round_even(boardings, 0)) AS BIGINT) AS b, CAST(sum(sum(round_even(boardings, 0))) OVER () AS BIGINT) AS node_total FROM demand WHERE mode = 'bus' AND node = '12' GROUP BY service ORDER BY b DESC, service")
def _(v):
    rows = v("demand").where("mode = 'bus' and node = '12'").groupBy("service").agg(F.sum(num.to_count(C("boardings"))).alias("b"))
    return rows.withColumn("node_total", F.sum("b").over(Window.partitionBy())).orderBy(F.desc("b"), "service")


@query("qry_search_nodes", """SELECT mode, node, name, round(lat, 9) AS lat, round(lng, 9) AS lng FROM (SELECT 'subway' AS mode, name AS node, name, avg(lat) AS lat, avg(lng) AS lng FROM subway_station WHERE contains(lower(name), 'stop 1') GROUP BY name
    UNION ALL SELECT 'bus', ars, min(name), avg(lat), avg(lng) FROM inner_stop WHERE ars = 'stop 1' OR contains(lower(name), 'stop 1') GROUP BY ars
    UNION ALL SELECT 'bus', lpad(node, 5, '0'), min(name), avg(lat), avg(lng) FROM outer_stop JOIN node_map USING (canonical) WHERE contains(lower(name), 'stop 1') AND lpad(node, 5, '0') NOT IN (SELECT ars FROM inner_stop) GROUP BY 2)""")
def _(v):
    found = demand.found_nodes("Stop 1".lower(), v("subway_station"), v("inner_stop"), v("outer_stop"), v("node_map"))
    return found.select("mode", "node", "name", F.round("lat", 9).alias("lat"), F.round("lng", 9).alias("lng"))


@query("qry_dong_points", "SELECT dong, (x0 + x1) / 2 AS lng, (y0 + y1) / 2 AS lat FROM district")
def _(v):
    return v("district").select("dong", ((C("x0") + C("x1")) / 2).alias("lng"), ((C("y0") + C("y1")) / 2).alias("lat"))


# ---------------------------------------------------------------- terrain, masters and checks

@query("agg_terrain_summary", """SELECT dong, count(*) AS stops, CAST(count(slope) AS BIGINT) AS measured, CAST(count(*) FILTER (WHERE slope > 8) AS BIGINT) AS steep, CAST(round(CAST(avg(slope) AS DECIMAL(18, 6)), 2) AS DOUBLE) AS mean, max(slope) AS most,
    CASE WHEN count(slope) > 0 THEN CAST(round(CAST(count(*) FILTER (WHERE slope > 8) * 100 AS DECIMAL(20, 4)) / CAST(count(slope) AS DECIMAL(20, 4)), 1) AS DOUBLE) END AS ratio FROM terrain GROUP BY dong HAVING count(slope) > 0""")
def _(v):
    out = v("terrain").groupBy("dong").agg(
        F.count(F.lit(1)).alias("stops"), F.count("slope").alias("measured"), F.count_if(C("slope") > 8).alias("steep"),
        F.round(F.avg("slope").cast("decimal(18,6)"), 2).cast("double").alias("mean"), F.max("slope").alias("most"),
    ).where("measured > 0")
    return out.withColumn("ratio", num.steep_ratio(C("steep"), C("measured"))).orderBy(F.desc_nulls_last("ratio"), "dong")


@query("val_terrain_diag", "SELECT method, count(*) AS n, CAST(count(*) FILTER (WHERE slope >= 8) AS BIGINT) AS steep FROM terrain GROUP BY method")
def _(v):
    return v("terrain").groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if(C("slope") >= 8).alias("steep"))


@query("val_terrain_source", "SELECT count(DISTINCT dong) AS dongs, count(DISTINCT node) AS nodes, CAST(count(slope) AS BIGINT) AS measured FROM terrain")
def _(v):
    return v("terrain").agg(F.count_distinct("dong").alias("dongs"), F.count_distinct("node").alias("nodes"), F.count("slope").alias("measured"))


@query("val_area_lookup", "SELECT CAST(count(*) FILTER (WHERE b.ars IS NULL) AS BIGINT) AS only_old, CAST(count(*) FILTER (WHERE a.ars IS NULL) AS BIGINT) AS only_new, CAST(count(*) FILTER (WHERE a.ars = b.ars) AS BIGINT) AS same FROM (SELECT DISTINCT ars FROM stop_point JOIN district ON lng > x0 AND lng < x1 AND lat > y0 AND lat < y1) a FULL JOIN (SELECT DISTINCT ars FROM stop_point JOIN district ON lng BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1) b ON a.ars = b.ars")
def _(v):
    old = spatial.covering(v("stop_point"), v("district"), 0.02, edge=False).select("ars").distinct().withColumn("a", F.lit(1))
    new = spatial.covering(v("stop_point"), v("district"), 0.02).select("ars").distinct().withColumn("b", F.lit(1))
    j = old.join(new, "ars", "full")
    return j.agg(F.count_if(C("b").isNull()).alias("only_old"), F.count_if(C("a").isNull()).alias("only_new"), F.count_if(C("a").isNotNull() & C("b").isNotNull()).alias("same"))


@query("val_sigungu", "SELECT left(dong, 5) AS gu, count(*) AS n FROM district d WHERE NOT EXISTS (SELECT 1 FROM nation WHERE lpad(CAST(n_nationkey AS STRING), 3, '0') = substr(dong, 3, 3)) GROUP BY 1")
def _(v):
    listed = v("nation").select(F.lpad(C("n_nationkey").cast("string"), 3, "0").alias("key"))
    return v("district").withColumn("key", F.substring("dong", 3, 3)).join(listed, "key", "left_anti").groupBy(ids.gu_code(C("dong")).alias("gu")).agg(F.count(F.lit(1)).alias("n"))


@query("trf_station_master", "SELECT name, max(k) AS k FROM stop_point WHERE lat IS NOT NULL GROUP BY name")
def _(v):
    rows = v("stop_point").withColumns({"name": F.trim("name"), "lat": C("lat").cast("string").try_cast("double")}).dropna(subset=["lat", "lng"])
    return lookups.first_per(rows, ["name"], [F.desc("k")]).select("name", "k")


@query("trf_stop_master", "SELECT name, min(k) AS k, lpad(CAST(min(k) AS STRING), 5, '0') AS ars FROM stop_point GROUP BY name")
def _(v):
    return lookups.first_per(v("stop_point").dropna(), ["name"], [C("k").asc()]).select("name", "k", ids.zero_fill(C("k").cast("string"), 5).alias("ars"))


@query("trf_holidays", "SELECT date, name FROM (SELECT CAST(trim(day) AS DATE) AS date, trim(name) AS name, row_number() OVER (PARTITION BY trim(day) ORDER BY line % 2 DESC, line DESC) AS r FROM holiday_line WHERE line % 7 > 2) WHERE r = 1")
def _(v):
    """A second list is merged into the days of a first one."""
    lines = v("holiday_line")
    return sinks.upserted(lookups.holidays(lines.where("line % 2 = 0")), lookups.holidays(lines.where("line % 2 = 1")), ["date"])


@query("trf_stop_master_export", "SELECT ars FROM stop_point WHERE k % 2 = 0 UNION SELECT ars FROM route_stop")
def _(v):
    return lookups.fallback_union(v("stop_point").where("k % 2 = 0").select("ars"), v("route_stop").select("ars").distinct(), ["ars"])


@query("src_wide_csv_unpivot", "SELECT node, hour, n FROM (SELECT dong AS node, 0 AS hour, CAST(sum(elev) AS DOUBLE) AS n FROM terrain GROUP BY dong UNION ALL SELECT dong, 1, CAST(count(slope) AS DOUBLE) FROM terrain GROUP BY dong)")
def _(v):
    from ..sources.files import wide_to_long

    wide = v("terrain").groupBy(C("dong").alias("node")).agg(F.sum("elev").alias("h00"), F.count("slope").alias("h01"))
    return wide_to_long(wide, ["node"], {"h00": 0, "h01": 1}, value="n")


@query("src_bigquery", "SELECT route, sum(passengers) AS p FROM leg WHERE service_date >= DATE '1998-01-01' AND route IN ('R01', 'R02') GROUP BY route")
def _(v):
    legs = v("leg")
    return legs.sparkSession.sql(
        "SELECT route, sum(passengers) AS p FROM {legs} WHERE service_date >= :first AND array_contains(:routes, route) GROUP BY route",
        args={"first": __import__("datetime").date(1998, 1, 1), "routes": F.array(F.lit("R01"), F.lit("R02"))}, legs=legs,
    )


@query("snk_upsert", "SELECT stop, day, boardings FROM daily WHERE NOT (stop = 3 AND day < DATE '1996-01-01') UNION ALL SELECT stop, day, boardings + 100 FROM daily WHERE stop = 3 AND day < DATE '1996-01-01'")
def _(v):
    from ..sources.sinks import upserted

    new = v("daily").where("stop = 3 and day < '1996-01-01'").withColumn("boardings", C("boardings") + 100)
    return upserted(v("daily"), new, ["stop", "day"])


@query("dom_train_model")
def _(v):
    model, found = models.train(models.features(v("daily")))
    names = ("mae", "rmse", "r2", "log_mae", "log_rmse", "log_r2")
    return v("holiday").sparkSession.createDataFrame([tuple(float(found[n]) for n in names)], ", ".join(f"{n} double" for n in names))
