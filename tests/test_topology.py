"""Areas that stay neighbours when they are simplified, activation under a lock, and places in an order."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from headway.operators import demand, ranks, terrain, topology

AREA = "area string, ring array<struct<lng:double,lat:double>>"


def grid(rng, n=4, steps=12):
    """Cells of a grid whose inner sides are bent; neighbours have the same points."""
    bend = {}

    def side(a, b):
        key = (min(a, b), max(a, b))
        if key not in bend:
            pts = [tuple(float(p + (q - p) * t / steps) for p, q in zip(*key)) for t in range(steps + 1)]
            bend[key] = [pts[0], *[(x + rng.uniform(-0.03, 0.03), y + rng.uniform(-0.03, 0.03)) for x, y in pts[1:-1]], pts[-1]]
        return bend[key] if key[0] == a else bend[key][::-1]

    out = []
    for i in range(n):
        for j in range(n):
            c = [(float(i), float(j)), (i + 1.0, float(j)), (i + 1.0, j + 1.0), (float(i), j + 1.0)]
            if (i + j) % 2:
                c = c[::-1]  # rings of both directions
            ring = [p for a, b in zip(c, c[1:] + c[:1]) for p in side(a, b)[:-1]]
            at = rng.randrange(len(ring))
            out.append((f"{i}{j}", ring[at:] + ring[: at + 1]))
    return out


def area_of(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))) / 2


def test_shared_sides_lose_the_same_points(spark):
    cells = grid(random.Random(4))
    df = spark.createDataFrame([(k, [{"lng": float(x), "lat": float(y)} for x, y in r]) for k, r in cells], AREA).repartition(3)
    for tolerance in (0.0, 0.02, 0.2):
        got = {r["area"]: [tuple(p) for p in r["ring"]] for r in topology.simplified(df, tolerance).collect()}
        assert got.keys() == dict(cells).keys()
        edges = {}
        for k, ring in got.items():
            assert ring[0] == ring[-1] and len(ring) >= 4
            for a, b in zip(ring, ring[1:]):
                edges.setdefault((min(a, b), max(a, b)), []).append(k)
        # every side within the grid still has two owners, and those around it one: no gap and no overlap
        for (a, b), owners in edges.items():
            outer = any(abs(a[d] - s) < 0.1 and abs(b[d] - s) < 0.1 for d in (0, 1) for s in (0, 4))
            assert len(owners) == 2 or outer
        outline = [e for e, owners in edges.items() if len(owners) == 1]
        degree = {}
        for a, b in outline:
            degree[a] = degree.get(a, 0) + 1
            degree[b] = degree.get(b, 0) + 1
        assert set(degree.values()) == {2}
        points = sum(map(len, got.values()))
        assert points == sum(len(r) for _, r in cells) if tolerance == 0 else points < sum(len(r) for _, r in cells)
        if tolerance == 0.2:  # every cell keeps its corners
            assert all(len(r) == 5 for r in got.values())
            assert sum(map(area_of, got.values())) == pytest.approx(16)


def test_islands_holes_and_small_rings(spark):
    circle = [(math.cos(t / 50 * math.pi), math.sin(t / 50 * math.pi)) for t in range(100)]
    far = [(x + 10, y) for x, y in circle]
    rings = [("a", circle), ("b", [*far, far[0]]), ("t", [(20.0, 0.0), (20.0, 0.0), (20.001, 0.0), (20.0, 0.001), (20.0, 0.0)]), ("none", []), ("line", [(1.0, 1.0), (2.0, 2.0)])]
    df = spark.createDataFrame([(k, [{"lng": x, "lat": y} for x, y in r]) for k, r in rings] + [("null", None)], AREA)
    got = {r["area"]: [tuple(p) for p in r["ring"]] for r in topology.simplified(df, 0.01).collect()}
    assert set(got) == {"a", "b", "t"} and len(got["t"]) == 4
    assert len(got["a"]) == len(got["b"]) < 40 and area_of(got["a"]) == pytest.approx(math.pi, abs=0.1)
    assert topology.simplified(df.where("false"), 0.01).count() == 0


def test_two_activations_of_one_state_dont_both_succeed(spark, tmp_path):
    raw = spark.createDataFrame([("1", "n", None, "s", "127.0", "37.0", "1", "2")], "node_id string, name string, stop_no string, stop_name string, longitude string, latitude string, elev_m string, slope_pct string")
    areas = spark.createDataFrame([("11001500", 126.0, 36.0, 128.0, 38.0)], "dong string, x0 double, y0 double, x1 double, y1 double")
    for name in ("a", "b"):
        terrain.publish(str(tmp_path), name, terrain.checked_stops(raw), areas, 5.0, active=False)
    seen = terrain.version(spark, str(tmp_path))
    assert seen == 0
    with pytest.raises(ValueError, match="active"):
        terrain.active(spark, str(tmp_path))
    assert terrain.activate(spark, str(tmp_path), "a", seen) == 1
    with pytest.raises(terrain.Conflict):
        terrain.activate(spark, str(tmp_path), "b", seen)
    assert terrain.active_name(spark, str(tmp_path)) == "a"
    assert terrain.activate(spark, str(tmp_path), "b") == 2 and terrain.active_name(spark, str(tmp_path)) == "b"
    (tmp_path / "ACTIVE-000000000003").write_text("")  # an activation that ended before its pointer was written
    assert terrain.active_name(spark, str(tmp_path)) == "b" and terrain.activate(spark, str(tmp_path), "a") == 4
    with pytest.raises(ValueError, match="published"):
        terrain.activate(spark, str(tmp_path), "c")


def test_places_and_quantiles(spark):
    rng = random.Random(1)
    values = [rng.choice([None, *range(50)]) for _ in range(3000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int").repartition(9)
    got = sorted(((r["place"], r["v"], r["i"]) for r in ranks.placed(df, [F.col("v").asc_nulls_last(), F.col("i").asc()]).collect()))
    assert [g[0] for g in got] == list(range(3000)) and [g[1:] for g in got] == sorted(((v, i) for i, v in enumerate(values)), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    known = sorted(v for v in values if v is not None)
    for q in (0.0, 0.3, 0.995, 1.0):
        assert ranks.quantile(df, "v", q) == pytest.approx(np.quantile(known, q))
    assert ranks.class_limits(df, "v", 5) == [known[k * len(known) // 5] for k in range(1, 5)]
    by = ranks.class_limits_by(df.withColumn("g", F.col("i") % 3), "g", "v", 4)
    for r in by.collect():
        own = sorted(v for i, v in enumerate(values) if v is not None and i % 3 == r["g"])
        assert r["breaks"] == [own[k * len(own) // 4] for k in range(1, 4)]
    assert ranks.quantile(df.where("v is null"), "v", 0.5) is None and ranks.class_limits(df.where("false"), "v", 3) == []


def test_accuracy_of_days_left_out(spark):
    rng = random.Random(2)
    legs = [(f"2024-01-{d:02d}", rng.choice("AB"), rng.choice("xy"), rng.choice("xy"), float(rng.randrange(1, 9))) for d in range(1, 15) for _ in range(rng.randrange(1, 12))]
    df = spark.createDataFrame(legs, "d string, route string, board_ars string, alight_ars string, passengers double").withColumn("service_date", F.to_date("d"))
    kind = lambda d: {5: "saturday", 6: "sunday"}.get((int(d[-2:]) - 1) % 7, "weekday")  # 1 January 2024 was a Monday
    want = {}
    for level, n in (("route", 1), ("stop", 2), ("pair", 3)):
        for d in {x[0] for x in legs}:
            days = {x[0] for x in legs if kind(x[0]) == kind(d)}
            if len(days) > 1:
                cells = {x[1 : 1 + n] for x in legs if kind(x[0]) == kind(d)}
                total = lambda c, day: sum(x[4] for x in legs if x[0] == day and x[1 : 1 + n] == c)  # noqa: B023, E731
                error = sum(abs(total(c, d) - sum(total(c, o) for o in days - {d}) / (len(days) - 1)) for c in cells)
                want[level, kind(d), d] = error / sum(x[4] for x in legs if x[0] == d)
    got = {(r["level"], r["day_type"], str(r["service_date"])): r["wape"] for r in demand.left_out_accuracy(df).collect()}
    assert got == pytest.approx(want)


def test_rings_are_made_once(spark):
    """What makes the areas ends at a written table, so that no step repeats it for the rows below it."""
    at = lambda dx, dy: F.struct((F.col("id") + dx).cast("double").alias("lng"), F.lit(float(dy)).alias("lat"))
    cells = spark.range(1000).select((F.col("id") % 4).alias("id")).distinct().select(F.col("id").cast("string").alias("area"), F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1)).alias("ring"))
    done = topology.simplified(cells, 0.01)
    assert "Range (" not in done._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["area"], len(r["ring"])) for r in done.collect()) == [(str(k), 5) for k in range(4)]
