"""Stops on the paths of their routes.

Both operators work through one route at a time, in the order of its stops; a route has some hundred stops and some
thousand path vertices.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M
from ..functions.identifiers import compact_id, compact_name
from .lookups import first_per


def ordered_vertices(stops: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each stop (lng, lat) a vertex of the path, none before the vertex of the stop before it, so that the summed
    distance is smallest; ties go to the earlier vertex. Also the distances in metres."""
    lng, lat = stops[:, :1], stops[:, 1:]
    x = np.radians(path[:, 0] - lng) * np.cos(np.radians((lat + path[:, 1]) / 2))
    metres = EARTH_M * np.hypot(x, np.radians(path[:, 1] - lat))
    n, m = metres.shape
    before = np.zeros((n, m), dtype=np.int64)
    total = metres[0]
    for i in range(1, n):
        low = np.minimum.accumulate(total)
        # the first vertex that reaches the running minimum
        fresh = np.r_[True, low[1:] < low[:-1]]
        before[i] = np.maximum.accumulate(np.where(fresh, np.arange(m), 0))
        total = metres[i] + low
    at = np.empty(n, dtype=np.int64)
    at[-1] = int(total.argmin())
    for i in range(n - 1, 0, -1):
        at[i - 1] = before[i][at[i]]
    return at, metres[np.arange(n), at]


def match_stations(stations: DataFrame, path: DataFrame) -> DataFrame:
    """The path vertex of each station of a route: ``route, seq, vertex, metres``.

    ``stations`` has ``route, seq, lng, lat``; ``path`` has ``route, vertex, lng, lat``. Routes without a path have nulls.
    """

    def one(s: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        s, p = s.sort_values("seq", kind="stable"), p.sort_values("to_vertex", kind="stable")
        out = pd.DataFrame({"route": s["route"], "seq": s["seq"], "vertex": pd.array([pd.NA] * len(s), "Int64"), "metres": np.nan})
        if len(s) and len(p):
            at, metres = ordered_vertices(s[["lng", "lat"]].to_numpy(float), p[["to_lng", "to_lat"]].to_numpy(float))
            out["vertex"], out["metres"] = pd.array(p["to_vertex"].to_numpy()[at], "Int64"), metres
        return out

    known = stations.where("route is not null and lng is not null and lat is not null").select("route", F.col("seq").cast("long").alias("seq"), "lng", "lat")
    vertices = path.where("route is not null and lng is not null and lat is not null").select(
        F.col("route").alias("to_route"), F.col("vertex").cast("long").alias("to_vertex"), F.col("lng").alias("to_lng"), F.col("lat").alias("to_lat")
    )
    return known.groupBy("route").cogroup(vertices.groupBy("to_route")).applyInPandas(one, "route string, seq long, vertex long, metres double").withColumn(
        "metres", F.when(F.col("vertex").isNotNull(), F.col("metres"))
    )


def place_stops(stops: DataFrame, points: DataFrame) -> DataFrame:
    """A point for each stop of a route: that of its number, or else the one of its name that is nearest to the point of
    the stop before it. Stops without either are left out.

    ``stops`` has ``route, seq, ars, name``; ``points`` has ``k`` (their order), ``ars, name, lng, lat``.
    """
    usable = points.where("lng is not null and lat is not null and not isnan(lng) and not isnan(lat)")
    ids = first_per(usable.withColumn("__id", compact_id(F.col("ars"))).where("__id != ''"), ["__id"], [F.col("k").asc()])
    ids = ids.select("__id", F.struct("lng", "lat").alias("__own"))
    named = usable.withColumn("__name", compact_name(F.col("name"))).where("__name != ''")
    names = named.groupBy("__name").agg(F.sort_array(F.collect_list(F.struct("k", "lng", "lat"))).alias("__same"))
    keyed = stops.withColumns({"__id": compact_id(F.col("ars")), "__name": compact_name(F.col("name"))}).join(ids, "__id", "left")
    # only stops without a point of their own need the points of their name
    wanted = keyed.withColumn("__name", F.when(F.col("__own").isNull(), F.col("__name"))).join(names, "__name", "left")
    lists = wanted.groupBy("route").agg(F.sort_array(F.collect_list(F.struct("seq", "ars", "name", "__own", "__same"))).alias("s"))

    def nearest(same: Column, last: Column) -> Column:
        def off(p: Column) -> Column:
            x = (p["lng"] - last["lng"]) * F.cos(F.radians(p["lat"]))
            y = p["lat"] - last["lat"]
            return F.struct(F.coalesce(x * x + y * y, F.lit(0.0)).alias("off"), p["k"].alias("k"), p["lng"].alias("lng"), p["lat"].alias("lat"))

        best = F.array_min(F.transform(same, off))
        return F.when(F.size(same) > 0, F.struct(best["lng"].alias("lng"), best["lat"].alias("lat")))

    def step(done: Column, stop: Column) -> Column:
        point = F.coalesce(stop["__own"], nearest(stop["__same"], F.try_element_at(done, F.lit(-1))))
        entry = F.struct(stop["seq"].alias("seq"), stop["ars"].alias("ars"), stop["name"].alias("name"), point["lng"].alias("lng"), point["lat"].alias("lat"))
        return F.when(point.isNotNull(), F.array_append(done, entry)).otherwise(done)

    kind = {f.name: f.dataType.simpleString() for f in stops.schema.fields}
    none = F.expr(f"cast(array() as array<struct<seq: {kind['seq']}, ars: string, name: string, lng: double, lat: double>>)")
    return lists.select("route", F.inline(F.aggregate("s", none, step)))
