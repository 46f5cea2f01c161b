"""Segments on paths, cohorts on board and hourly loads against brute-force versions."""

import collections
import math
import random

import numpy as np
import pytest

from headway.operators import cohorts, hourly, paths, route_load, segments

LEGS = "route string, board_seq int, board_ars string, alight_seq int, alight_ars string, passengers double"


def metres(a, b):
    x = math.radians(b[0] - a[0]) * math.cos(math.radians((a[1] + b[1]) / 2))
    return 6371000 * math.hypot(x, math.radians(b[1] - a[1]))


def test_segments_of_matched_stations(spark):
    rng = random.Random(2)
    stations, path = [], []
    for k in range(12):
        route = f"r{k}"
        line = [(127 + i * 0.001 + rng.random() * 0.0004, 37 + rng.random() * 0.002) for i in range(rng.randrange(2, 60))]
        path += [(route, 10 * i, *p) for i, p in enumerate(line)]
        at = sorted(rng.choice(line) for _ in range(rng.randrange(2, 9)))  # several stops may share a vertex
        stations += [(route, s, f"{s:05d}", p[0] + 1e-5, p[1]) for s, p in enumerate(at)]
    stations += [("alone", 1, "00001", 127.0, 37.0), ("no path", 1, "00001", 127.0, 37.0), ("no path", 2, "00002", 127.1, 37.0), ("r0", None, "00009", None, None)]
    path += [("alone", 1, 127.0, 37.0), ("r1", 5, None, 37.0)]
    s = spark.createDataFrame(stations, "route string, seq long, ars string, lng double, lat double")
    p = spark.createDataFrame(path, "route string, vertex long, lng double, lat double").repartition(3)
    vertex = {(r["route"], r["seq"]): r["vertex"] for r in paths.match_stations(s, p).collect()}
    matched = s.join(paths.match_stations(s, p).select("route", "seq", "vertex"), ["route", "seq"])
    got = {(r["route"], r["seq"]): r for r in segments.build(matched, p, ["ars"]).collect()}
    want = {}
    for route in {x[0] for x in stations} - {"alone", "no path"}:
        own = sorted((x[1], x[3], x[4]) for x in stations if x[0] == route and x[3])
        line = [x for x in path if x[0] == route and x[2]]
        for a, b in zip(own, own[1:]):
            part = [x[2:] for x in line if vertex[route, a[0]] <= x[1] <= vertex[route, b[0]]]
            want[route, a[0]] = (b[0], len(part) < 2, part if len(part) > 1 else [a[1:], b[1:]])
    assert got.keys() == want.keys() and any(w[1] for w in want.values()) and not all(w[1] for w in want.values())
    for key, (after, straight, points) in want.items():
        r = got[key]
        assert (r["next_seq"], r["straight"], [tuple(x) for x in r["points"]]) == (after, straight, points)
        assert r["metres"] == pytest.approx(sum(metres(a, b) for a, b in zip(points, points[1:])), abs=1e-6)
        assert (r["from_ars"], r["to_ars"]) == (f"{key[1]:05d}", f"{after:05d}")


def test_whole_lines_turnarounds_and_points_at_a_distance(spark):
    path = spark.createDataFrame([("a", i, 127 + 0.001 * i, 37.0) for i in range(5)], "route string, vertex long, lng double, lat double")
    stations = spark.createDataFrame([("a", s, v, 127 + 0.001 * v, 37.0, s >= 2) for s, v in ((1, 0), (2, 2), (3, 2), (4, 4))], "route string, seq long, vertex long, lng double, lat double, turn boolean")
    line = segments.whole_lines(segments.build(stations, path, [])).first()
    assert [round(p["lng"], 6) for p in line["points"]] == [127.0, 127.001, 127.002, 127.003, 127.004]
    assert segments.turnarounds(stations).first()["turn_seq"] == 2
    step = metres((127, 37), (127.001, 37))
    wanted = spark.createDataFrame([("a", x) for x in (0.0, 1.5 * step, 4 * step * (1 - 1e-7), -1.0, 9 * step)] + [("none", 1.0)], "route string, metres double")
    got = {(r["route"], round(r["metres"] / step, 3)): r["lng"] for r in segments.located(path, wanted).collect()}
    assert got["a", 0.0] == 127 and got["a", 1.5] == pytest.approx(127.0015) and got["a", 4.0] == pytest.approx(127.004)
    assert got["a", 9.0] is None and got["none", round(1 / step, 3)] is None and got["a", round(-1 / step, 3)] is None
    sizes = spark.createDataFrame([("g", "x", 1), ("g", "x", 2), ("g", "b", 1), ("g", "b", 2), ("h", "z", 1)], "g string, v string, seq int")
    assert {(r["g"], r["v"]) for r in segments.longest(sizes, "g", "v").collect()} == {("g", "b"), ("h", "z")}


def random_legs(rng, n=400):
    return [(rng.choice("AB"), b, f"{b:05d}", a, f"{a:05d}", float(rng.randrange(1, 40))) for b, a in ((rng.randrange(0, 30, 3), rng.randrange(0, 33, 3)) for _ in range(n))]


def top(flows, n=10):
    return sorted(flows.items(), key=lambda x: (-x[1], x[0]))[:n]


def test_stop_details(spark):
    legs = random_legs(random.Random(5))
    got = {(r["route"], r["seq"]): r for r in cohorts.stop_details(spark.createDataFrame(legs, LEGS), (25.0, 200.0, 25.0, 1e6)).collect()}
    for route in "AB":
        own = [x for x in legs if x[0] == route]
        stops = sorted({x[1] for x in own} | {x[3] for x in own})
        assert {s for r, s in got if r == route} == set(stops)
        for k in stops:
            fine = [x for x in own if x[3] > x[1]]
            to, of = collections.Counter(), collections.Counter()
            for x in fine:
                to[x[3]] += x[5] * (x[1] == k)
                of[x[1]] += x[5] * (x[3] == k)
            still = lambda j: sum(x[5] for x in fine if x[1] <= k and x[3] > max(j, k))
            r = got[route, k]
            assert (r["boardings"], r["alightings"], r["on_board"]) == (sum(to.values()), sum(of.values()), still(k))
            for name, flows in (("destinations", to), ("origins", of)):
                assert [(x["seq"], x["riders"]) for x in r[name] or []] == top({s: p for s, p in flows.items() if p})
            far = lambda level: max((j for j in stops if j >= k and still(j) > level), default=None)
            assert {x["level"]: x["until"] for x in r["reach"] or []} == ({x: far(x) for x in (25.0, 200.0, 1e6)} if still(k) else {})


def test_load_report_cuts(spark):
    legs = random_legs(random.Random(8))
    df = spark.createDataFrame(legs, LEGS)
    for toward in (True, False):
        got = {(r["route"], r["seq"]): r for r in cohorts.load_report(df, 6, 21, (9, 15), toward, 3, (100.0,)).collect()}
        for (route, k), r in got.items():
            on = [x for x in legs if x[0] == route and x[1] <= k < x[3]]
            assert [r["cut_0"], r["cut_1"]] == [sum(x[5] for x in on if (x[3] > c if toward else x[1] < c)) for c in (9, 15)]
            offs = {x[3] for x in legs if x[0] == route}
            assert r["reach_0"] == max((j for j in offs if j >= k and sum(x[5] for x in on if x[3] > j) > 100), default=None)
        assert len(got) == 2 * len(range(6, 22, 3))


def test_segment_report_of_no_trips_and_of_some(spark):
    df = spark.createDataFrame([], LEGS)
    assert cohorts.segment_report(df, 1, 2).count() == 0 and cohorts.stop_details(df).count() == 0
    df = spark.createDataFrame([("A", 1, "1", 5, "5", 2.0), ("A", 3, "3", 9, "9", 4.0), ("A", 3, "3", 4, "4", 8.0), ("A", 1, "1", 9, "9", 16.0), ("A", 4, "4", 3, "3", 32.0)], LEGS)
    rows = {r["seq"]: r for r in cohorts.segment_report(df, 3, 5).collect()}
    assert {s: (r["boardings"], r["alightings"], r["load"], r["leaving"], r["leaving_so_far"]) for s, r in rows.items()} == {3: (12, 0, 30, 4, 4), 4: (0, 8, 22, 0, 4), 5: (0, 2, 20, 0, 4)}
    r = rows[3]
    assert (r["within"], r["out"], r["entering"], r["through"]) == (8, 4, 2, 16)
    assert [tuple(x) for x in r["beyond"]] == [(9, 4)] and [tuple(x) for x in r["earlier"]] == [(1, 2)]


def test_hourly_loads_and_their_legend(spark):
    rng = random.Random(3)
    stations = [("A", v, s, None if v == "A|2" and s == 4 else f"{s:05d}") for v in ("A|1", "A|2") for s in range(1, 8)]
    shares = {f"{s:05d}": np.array([rng.random() for _ in range(24)]) for s in (1, 2)}
    shares = {k: v / v.sum() for k, v in shares.items()}
    placed = []
    for _ in range(200):
        b, a = sorted(rng.sample(range(7), 2))
        placed.append(("A", [f"{b + 1:05d}", "00000", None, "x"][rng.choice([0, 0, 0, 1, 2, 3])], float(rng.randrange(1, 9)), rng.choice(["A|1", "A|2"]), b, a))
    df = spark.createDataFrame(placed, "route string, board_ars string, passengers double, variant string, from_at int, to_at int")
    known = spark.createDataFrame([("A", k, v.tolist()) for k, v in shares.items()], "route string, ars string, share array<double>")
    st = spark.createDataFrame(stations, "route string, variant string, seq int, ars string")
    loads = route_load.hourly_loads(df, known, hourly.default_profile())
    want = collections.defaultdict(lambda: np.zeros(24))
    for _, ars, p, variant, b, a in placed:
        if ars and ars.isdigit() and ars != "00000":
            for at in range(b, a):
                want[variant, at] += p * shares.get(ars, np.array(hourly.default_profile()))
    got = {(r["variant"], r["at"], r["hour"]): r["load"] for r in loads.collect()}
    assert got == pytest.approx({(*k, h): v[h] for k, v in want.items() for h in range(24)})
    merged = collections.defaultdict(lambda: np.zeros(24))
    for (variant, at), v in want.items():
        ends = {s: x for _, w, s, x in stations if w == variant}
        merged[(ends[at + 1], ends[at + 2]) if ends[at + 1] and ends[at + 2] else (variant, at)] += v
    most = np.max(list(merged.values()), axis=0)
    assert {r["hour"]: r["most"] for r in route_load.legend(loads, st).collect()} == pytest.approx(dict(enumerate(most)))


def test_hours_stay_in_one_row_until_loads_are_known(spark):
    placed = spark.createDataFrame([("A", "00001", 1.0, "A|1", 0, 2)], "route string, board_ars string, passengers double, variant string, from_at int, to_at int")
    known = spark.createDataFrame([("A", "00001", [1.0 / 24] * 24)], "route string, ars string, share array<double>")
    plan = route_load.hourly_loads(placed, known, hourly.default_profile())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("Window [")  # above the running sums
