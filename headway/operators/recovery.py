"""Recovery and repair of stop codes, with a ledger of the rules that set each value.

``recover`` fills route ids and the codes of both stops of a trip, from strong to weak sources. All that a fill depends on is the
stop's own keys, so the chain runs over the distinct stops of the trips (saved after every step, because later lookups read what
earlier steps found) and meets the trips once at its end. All that trips look up stands in one row per route, as maps by position,
so that they are moved once. ``repair`` corrects codes against stop masters. Both keep per row which
rules set a value; ``rule_counts`` counts them in one aggregate, ``observed`` while the rows are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..sources.files import saved
from .lookups import unambiguous

#: A code that a faulty lookup wrote into rows of other stops, and the stop it belongs to (fixed values).
BAD_CODE, BAD_CODE_STOP = "164000626", "38624"
SIDES = ("board", "alight")
ROUTE_RULES = ("route_by_board", "route_by_alight")
CODE_RULES = ("master", "reference", "same_ars", "name", "cross")
REPAIR_RULES = ("cleared_bad", "refilled", "by_ars", "outside", "virtual_by_name", "virtual_cleared")


def _empty(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


def _filled(rows: DataFrame, found: DataFrame, on: list[str], rule: str, when: Column | None = None) -> DataFrame:
    """Rows whose ``code`` is empty take that of the lookup (keys ``on`` and ``found``), and the name of the rule."""
    keys = found.select(*[F.col(c).alias(f"__{c}") for c in on], "found")
    same = F.lit(True)
    for c in on:
        same = same & (rows[c] == keys[f"__{c}"])
    hit = _empty("code") & F.col("found").isNotNull() & (F.lit(True) if when is None else when)
    joined = rows.join(keys, same, "left")
    return joined.withColumns({"rule": F.when(hit, rule).otherwise(F.col("rule")), "code": F.when(hit, F.col("found")).otherwise(F.col("code"))}).select(*rows.columns)


def _known(rows: DataFrame, keys: list[str]) -> DataFrame:
    return unambiguous(rows, keys, "code").select(*keys, F.col("code").alias("found"))


def _by_route(rows: DataFrame) -> DataFrame:
    """Route labels as they were, and ``__route``, by which rows meet all lookups of their route (empty without a route)."""
    return rows.withColumn("route", ids.route_label(F.col("route"))).withColumn("__route", F.coalesce("route", F.lit("")))


def _ids_of_routes(known: DataFrame) -> DataFrame:
    """Per route a map for each side, from position to the least id."""
    given = _stops(known.where("route is not null"), "__route").where(~_empty("route_id") & F.col("seq").isNotNull())
    least = given.groupBy("__route", "side", "seq").agg(F.min("route_id").alias("id"))
    of = lambda s: F.map_from_entries(F.collect_list(F.when(F.col("side") == s, F.struct("seq", "id")))).alias(f"__{s}_ids")
    return least.groupBy("__route").agg(*map(of, SIDES))


def _identified(rows: DataFrame, found: DataFrame, ends: dict[str, str]) -> DataFrame:
    """``route_id`` of rows without one and ``route_id_rule``, by the positions in the columns ``ends`` of each side."""
    joined = rows.join(found, "__route", "left")
    lacks = _empty("route_id") & F.col("route").isNotNull()
    by = [F.try_element_at(f"__{s}_ids", F.col(ends[s])) for s in SIDES]
    rule = F.when(lacks & by[0].isNotNull(), ROUTE_RULES[0]).when(lacks & by[1].isNotNull(), ROUTE_RULES[1])
    return joined.withColumns({"route_id": F.when(lacks, F.coalesce(*by, "route_id")).otherwise(F.col("route_id")), "route_id_rule": rule}).select(*rows.columns, "route_id_rule")


def route_ids(raw: DataFrame, reference: DataFrame) -> DataFrame:
    """Route labels as they were, and ids of routes by (route, boarding position), then by (route, alighting position) of the
    reference (the least where it has several): sets ``route_id`` and ``route_id_rule``. Rows meet both lookups at once, by route."""
    return _identified(_by_route(raw), _ids_of_routes(_by_route(reference)), {s: f"{s}_seq" for s in SIDES}).drop("__route")


def _stops(rows: DataFrame, *more: str | Column) -> DataFrame:
    """A row per stop of a trip: ``side``, ``route_id``, ``seq``, ``ars``, ``name``, ``code``, and ``more`` of the trip."""
    one = lambda s: F.struct(F.lit(s).alias("side"), *[F.col(f"{s}_{c}").alias(c) for c in ("seq", "ars", "name", "code")])
    return rows.select("route_id", *more, F.explode(F.array(*map(one, SIDES))).alias("x")).select("route_id", *rows.select(*more).columns, "x.*")


def _codes_of_routes(stops: DataFrame) -> DataFrame:
    """Per route a map for each side, from position to the codes found there by (id of the route, number, name). The name is null for
    stops with a number, whose codes don't depend on it."""
    key = ["route_id", "ars", "name"]
    found = stops.where("rule is not null").withColumn("name", F.when(ids.is_placeholder(F.col("ars")), F.col("name"))).repartition("__route")
    each = found.groupBy("__route", "side", "seq", *key).agg(F.min(F.struct("code", "rule")).alias("x"))
    at = each.groupBy("__route", "side", "seq").agg(F.map_from_entries(F.collect_list(F.struct(F.struct(*key), "x"))).alias("at"))
    of = lambda s: F.map_from_entries(F.collect_list(F.when(F.col("side") == s, F.struct(F.struct("seq"), "at")))).alias(f"__{s}_codes")
    return at.groupBy("__route").agg(*map(of, SIDES))


def _coded(side: str) -> Column:
    """``code`` and ``rule`` that ``_codes_of_routes`` has for a row's stop."""
    at = F.try_element_at(f"__{side}_codes", F.struct(F.col(f"{side}_seq").alias("seq")))
    key = lambda name: F.struct("route_id", F.col(f"{side}_ars").alias("ars"), name.alias("name"))
    return F.coalesce(F.try_element_at(at, key(F.lit(None).cast("string"))), F.try_element_at(at, key(F.col(f"{side}_name"))))


def recover(raw: DataFrame, reference: DataFrame, master: DataFrame) -> DataFrame:
    """The rows of ``raw`` with route ids and codes filled, and ``route_id_rule``, ``board_rule`` and ``alight_rule``: null where
    the value was given or none was found. ``master`` has ``ars`` and ``node``.

    Codes come from the master by stop number; from the reference where it has the same number at that position of the
    route; from other rows of the same number and side; of the same name, for rows without a number; and from the other side's
    rows of the same number. No lookup guesses: a key with two codes has none. At the end numbers get five places, codes nine.
    """
    rows, known = _by_route(raw), _ids_of_routes(_by_route(reference))
    own = ["__route", "side", "route_id", "seq", "ars", "name", "given"]
    # distinct before ids are looked up: positions stay only where the id depends on them
    open_at = {s: f"__{s}_at" for s in SIDES}
    first = _stops(rows, "__route", "route", *[F.when(_empty("route_id"), F.col(f"{s}_seq")).alias(c) for s, c in open_at.items()]).distinct()
    stops = _identified(first, known, open_at).withColumnRenamed("code", "given").select(*own).distinct()
    stops = stops.withColumns({"code": F.col("given"), "rule": F.lit(None).cast("string"), "key": F.nullif(ids.ars_key(F.col("ars")), F.lit(""))})
    nodes = master.withColumns({"key": F.nullif(ids.ars_key(F.col("ars")), F.lit("")), "code": F.col("node")})
    old = _stops(reference).withColumn("key", F.nullif(ids.ars_key(F.col("ars")), F.lit("")))
    stops = _filled(stops, _known(nodes, ["key"]), ["key"], "master")
    stops = saved(_filled(stops, _known(old, ["side", "route_id", "seq", "key"]), ["side", "route_id", "seq", "key"], "reference"), "stops")
    real = ~ids.is_placeholder(F.col("ars"))
    stops = saved(_filled(stops, _known(stops.where(real), ["side", "ars"]), ["side", "ars"], "same_ars"), "stops")
    stops = saved(_filled(stops, _known(stops, ["side", "name"]), ["side", "name"], "name", ~real), "stops")
    for source, target in (SIDES, SIDES[::-1]):
        found = _known(stops.where(real & (F.col("side") == source)), ["ars"])
        stops = saved(_filled(stops, found, ["ars"], "cross", F.col("side") == target), "stops")
    # both joins are by route, so that rows move and are sorted once
    rows = _identified(rows, known, {s: f"{s}_seq" for s in SIDES}).join(_codes_of_routes(stops), "__route", "left")
    for side in SIDES:
        code, hit = f"{side}_code", _empty(f"{side}_code") & _coded(side).isNotNull()
        rows = rows.withColumns({code: F.when(hit, _coded(side)["code"]).otherwise(F.col(code)), f"{side}_rule": F.when(hit, _coded(side)["rule"])})
    places = {f"{s}_{c}": F.when(_empty(f"{s}_{c}"), F.col(f"{s}_{c}")).otherwise(ids.zero_fill(F.col(f"{s}_{c}"), n)) for s in SIDES for c, n in (("ars", 5), ("code", 9))}
    return rows.withColumns(places).select(*raw.columns, "route_id_rule", *[f"{s}_rule" for s in SIDES])


def disagreements(rows: DataFrame, master: DataFrame) -> DataFrame:
    """Per side how many codes could be ``checked`` against the master, how many are ``wrong``, and how many rows' numbers it
    lacks or has twice (``unknown``)."""
    nodes = unambiguous(master, ["ars"], "node").select(F.col("ars").alias("__ars"), "node")
    stops = _stops(rows).join(nodes, F.col("ars") == F.col("__ars"), "left")
    checked = F.col("node").isNotNull() & ~_empty("code")
    return stops.groupBy("side").agg(F.count_if(checked).alias("checked"), F.count_if(checked & (F.col("code") != F.col("node"))).alias("wrong"), F.count_if(F.col("node").isNull()).alias("unknown"))


def repair(rows: DataFrame, master: DataFrame, outside: DataFrame) -> DataFrame:
    """Codes of both sides put right, with ``board_rules`` and ``alight_rules``, the rules that changed each in order.

    A code that belongs to one stop is cleared from all others; empty codes are filled from the master (``ars, node, name``)
    by numbers that have one node; codes that differ from the master's are rewritten; so are those of stops that only ``outside``
    (``ars, node``) has; stops without a number keep only the code of the master's one stop of that name.
    """
    single = unambiguous(master, ["ars"], "node")
    beyond = unambiguous(outside.join(master.select("ars").distinct(), "ars", "left_anti"), ["ars"], "node")
    virtual = unambiguous(master.where(F.col("ars") == ids.VIRTUAL), ["name"], "node")
    for side in SIDES:
        ars, name, code = (f"{side}_{c}" for c in ("ars", "name", "code"))
        for table, key, own in ((single, "ars", ars), (beyond, "ars", ars), (virtual, "name", name)):
            alias = {id(single): "__m", id(beyond): "__e", id(virtual): "__v"}[id(table)]
            rows = rows.join(table.select(F.col(key).alias("__key"), F.col("node").alias(alias)), F.col(own) == F.col("__key"), "left").drop("__key")
        is_virtual = F.col(ars) == ids.VIRTUAL
        unlike = lambda node, c=code: F.col(node).isNotNull() & ~F.col(node).eqNullSafe(F.col(c))
        steps = (
            ("cleared_bad", (F.col(code) == BAD_CODE) & (F.col(ars) != BAD_CODE_STOP), F.lit(None)),
            ("refilled", F.col(code).isNull() & F.col("__m").isNotNull(), F.col("__m")),
            ("by_ars", unlike("__m"), F.col("__m")),
            ("outside", unlike("__e"), F.col("__e")),
            ("virtual_by_name", is_virtual & unlike("__v"), F.col("__v")),
            ("virtual_cleared", is_virtual & F.col(code).isNotNull() & F.col("__v").isNull(), F.lit(None)),
        )
        rules = f"{side}_rules"
        rows = rows.withColumn(rules, F.array().cast("array<string>"))
        for rule, when, value in steps:
            hit = F.coalesce(when, F.lit(False))
            rows = rows.withColumns({rules: F.when(hit, F.array_append(rules, F.lit(rule))).otherwise(F.col(rules)), code: F.when(hit, value).otherwise(F.col(code))})
        rows = rows.drop("__m", "__e", "__v")
    return rows


def rule_counts(rows: DataFrame) -> DataFrame:
    """``column``, ``rule`` and ``n`` of every rule that set a value, in one aggregate."""

    def named(column: str, rule: Column) -> Column:
        return F.struct(F.lit(column).alias("column"), rule.alias("rule"))

    parts = [F.array(named(c.removesuffix("_rule"), F.col(c))) for c in rows.columns if c.endswith("_rule")]
    for name in [c.removesuffix("_rules") for c in rows.columns if c.endswith("_rules")]:
        parts.append(F.transform(f"{name}_rules", lambda x: named(name, x)))  # noqa: B023 (used at once)
    return rows.select(F.explode(F.concat(*parts)).alias("x")).select("x.*").where("rule is not null").groupBy("column", "rule").agg(F.count(F.lit(1)).alias("n"))


def observed(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The rows, and an observation that has the count of each (column, rule) once they were written."""
    seen = Observation(name)
    counts = []
    for c in rows.columns:
        if c.endswith("_rule"):
            counts += [F.count_if(F.col(c) == r).alias(f"{c.removesuffix('_rule')}:{r}") for r in (ROUTE_RULES if c == "route_id_rule" else CODE_RULES)]
        elif c.endswith("_rules"):
            counts += [F.count_if(F.array_contains(c, r)).alias(f"{c.removesuffix('_rules')}:{r}") for r in REPAIR_RULES]
    return rows.observe(seen, *counts), seen
