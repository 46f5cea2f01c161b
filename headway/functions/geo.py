"""Distances, points in polygons and line strings as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M, SPHERE_M = 6_371_000.0, 6_370_986.0


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    dp, dl = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    a = F.sin(dp / 2) * F.sin(dp / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dl / 2) * F.sin(dl / 2)
    return EARTH_M * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def sphere_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    dp, dl = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    a = F.sin(dp / 2) * F.sin(dp / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dl / 2) * F.sin(dl / 2)
    return 2 * SPHERE_M * F.asin(F.least(F.lit(1.0), F.sqrt(a))) / 1000


def flat_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres on a plane whose east is scaled by the mean latitude."""
    x = F.radians(lng2 - lng1) * F.cos(F.radians((lat1 + lat2) / 2))
    return EARTH_M * F.hypot(x, F.radians(lat2 - lat1))


def path_m(points: Column) -> Column:
    """Length of an array of structs ``lng``, ``lat``."""
    ends = F.zip_with(
        F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(2), F.size(points)),
        lambda a, b: F.coalesce(flat_m(a["lat"], a["lng"], b["lat"], b["lng"]), F.lit(0.0)),
    )
    return F.aggregate(ends, F.lit(0.0), lambda s, x: s + x)


def in_rectangle(lng: Column, lat: Column, x0: Column, y0: Column, x1: Column, y1: Column, edge: bool = True) -> Column:
    if edge:
        return lng.between(x0, x1) & lat.between(y0, y1)
    return (lng > x0) & (lng < x1) & (lat > y0) & (lat < y1)


def _edges(ring: Column) -> Column:
    return F.zip_with(ring, F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, F.lit(1), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def on_boundary(lng: Column, lat: Column, ring: Column) -> Column:
    def hit(e: Column) -> Column:
        a, b = e["a"], e["b"]
        level = (b["lng"] - a["lng"]) * (lat - a["lat"]) == (b["lat"] - a["lat"]) * (lng - a["lng"])
        return level & lng.between(F.least(a["lng"], b["lng"]), F.greatest(a["lng"], b["lng"])) & lat.between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))

    return F.exists(_edges(ring), hit)


def contains(lng: Column, lat: Column, ring: Column) -> Column:
    """Whether a point is strictly inside a ring of structs ``lng``, ``lat`` (even-odd rule)."""

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        x = a["lng"] + (lat - a["lat"]) * (b["lng"] - a["lng"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0))
        return ((a["lat"] > lat) != (b["lat"] > lat)) & (lng < x)

    return (F.size(F.filter(_edges(ring), crossed)) % 2 == 1) & ~on_boundary(lng, lat, ring)


def covers(lng: Column, lat: Column, ring: Column) -> Column:
    """Whether a point is inside a ring or on it."""
    return on_boundary(lng, lat, ring) | contains(lng, lat, ring)


def crosses_itself(ring: Column) -> Column:
    """Whether two sides of a closed ring that aren't neighbours meet, or a point occurs twice."""
    sides = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def turn(p: Column, q: Column, r: Column) -> Column:
        return F.signum((q["lng"] - p["lng"]) * (r["lat"] - p["lat"]) - (q["lat"] - p["lat"]) * (r["lng"] - p["lng"]))

    def within(p: Column, q: Column, r: Column) -> Column:
        return r["lng"].between(F.least(p["lng"], q["lng"]), F.greatest(p["lng"], q["lng"])) & r["lat"].between(F.least(p["lat"], q["lat"]), F.greatest(p["lat"], q["lat"]))

    def meet(s: Column, t: Column) -> Column:
        a, b, c, d = s["a"], s["b"], t["a"], t["b"]
        touch = [(turn(p, q, r) == 0) & within(p, q, r) for p, q, r in ((a, b, c), (a, b, d), (c, d, a), (c, d, b))]
        return (turn(a, b, c) != turn(a, b, d)) & (turn(c, d, a) != turn(c, d, b)) | touch[0] | touch[1] | touch[2] | touch[3]

    # the sides as one value, so that each pair only looks them up
    numbered = F.transform(sides, lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    pairs = F.transform(F.array(numbered), lambda all_: F.exists(all_, lambda x: F.exists(all_, lambda y: (y["i"] > x["i"] + 1) & ((x["i"] > 0) | (y["i"] < F.size(all_) - 1)) & meet(x["s"], y["s"]))))
    return F.get(pairs, F.lit(0))


def is_valid_ring(ring: Column) -> Column:
    """A closed ring of four or more points that are longitudes and latitudes, and whose sides don't cross; null isn't one."""
    good = F.forall(ring, lambda p: F.coalesce(p["lng"].between(-180, 180) & p["lat"].between(-90, 90), F.lit(False)))
    closed = (F.size(ring) >= 4) & (F.get(ring, F.lit(0)) == F.element_at(ring, -1)) & good
    return F.coalesce(F.when(closed, ~crosses_itself(ring)), F.lit(False))


def linestring(points: Column) -> Column:
    """Well-known text with seven decimals."""
    return F.concat(F.lit("LINESTRING("), F.array_join(F.transform(points, lambda p: F.format_string("%.7f %.7f", p["lng"], p["lat"])), ", "), F.lit(")"))


def parse_linestring(text: Column) -> Column:
    """Points of a line string, rounded to six decimals."""
    pairs = F.regexp_extract_all(text, F.lit(r"-?[0-9.]+ -?[0-9.]+"), F.lit(0))
    return F.transform(pairs, lambda p: F.struct(F.round(F.split(p, " ")[0].cast("double"), 6).alias("lng"), F.round(F.split(p, " ")[1].cast("double"), 6).alias("lat")))


def joined_lines(lines: Column) -> Column:
    """Several lines as one, without the vertex that two neighbours share."""
    return F.aggregate(
        lines, F.expr("cast(array() as array<struct<lng: double, lat: double>>)"),
        lambda done, line: F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) == F.try_element_at(line, F.lit(1))), F.concat(done, F.slice(line, F.lit(2), F.size(line)))).otherwise(F.concat(done, line)),
    )


def point_on_surface(ring: Column) -> Column:
    """A point inside a ring: the middle of the widest stretch inside it at half its height; null where there is none."""
    lats = F.transform(ring, lambda p: p["lat"])
    level = (F.array_min(lats) + F.array_max(lats)) / 2
    crossed = F.filter(_edges(ring), lambda e: (e["a"]["lat"] > level) != (e["b"]["lat"] > level))
    xs = F.sort_array(F.transform(crossed, lambda e: e["a"]["lng"] + (level - e["a"]["lat"]) * (e["b"]["lng"] - e["a"]["lng"]) / (e["b"]["lat"] - e["a"]["lat"])))
    spans = F.filter(F.transform(xs, lambda x, i: F.when(i % 2 == 0, F.struct((F.try_element_at(xs, i + 2) - x).alias("width"), x.alias("x")))), lambda s: s.isNotNull())
    widest = F.array_max(spans)
    return F.when(F.size(xs) > 1, F.struct((widest["x"] + widest["width"] / 2).alias("lng"), level.alias("lat")))


def geojson_polygon(rings: Column) -> Column:
    """A GeoJSON polygon of rings, with six decimals."""
    one = lambda p: F.format_string("[%.6f,%.6f]", p["lng"], p["lat"])
    text = F.transform(rings, lambda r: F.concat(F.lit("["), F.array_join(F.transform(r, one), ","), F.lit("]")))
    return F.concat(F.lit('{"type":"Polygon","coordinates":['), F.array_join(text, ","), F.lit("]}"))


def kept_points(lng, lat, tolerance: float):
    """Which points of a line stay when those closer than ``tolerance`` to what is left of it go (numpy arrays)."""
    keep = np.zeros(len(lng), dtype=bool)
    if len(lng):
        keep[[0, -1]] = True
    spans = [(0, len(lng) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        dx, dy = lng[b] - lng[a], lat[b] - lat[a]
        x, y = lng[a + 1 : b] - lng[a], lat[a + 1 : b] - lat[a]
        square = dx * dx + dy * dy
        along = np.clip((x * dx + y * dy) / square, 0, 1) if square else np.zeros(len(x))
        off = np.hypot(x - along * dx, y - along * dy)
        far = int(off.argmax())
        if off[far] > tolerance:
            keep[a + 1 + far] = True
            spans += [(a, a + 1 + far), (a + 1 + far, b)]
    return keep


def simplified(points: Column, tolerance: float) -> Column:
    """A line (array of structs ``lng``, ``lat``) without the points that hardly bend it; ends stay. Null stays null."""
    @F.pandas_udf("array<boolean>")
    def kept(lines: pd.Series) -> pd.Series:
        def one(line):
            if line is None:
                return None
            pair = np.array([(p["lng"], p["lat"]) for p in line], dtype=float).reshape(-1, 2)
            return kept_points(pair[:, 0], pair[:, 1], tolerance).tolist()

        return lines.map(one)

    pairs = F.arrays_zip(points.alias("p"), kept(points).alias("k"))
    return F.transform(F.filter(pairs, lambda x: x["k"]), lambda x: x["p"])
