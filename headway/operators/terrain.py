"""Terrain at stops as immutable, checked snapshots with one active dataset.

A snapshot is a folder ``dataset=<id>`` with the tables ``stops`` and ``assignment`` and, written last, its counts; the
active dataset is named by the last of the numbered pointer files.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import measured_or_null
from ..sources.files import create_text, get_text, names_in, path_exists, put_text
from .lookups import first_per
from .quality import assert_unique
from .spatial import covering


def checked_stops(raw: DataFrame, nodata: float = -9999.0) -> DataFrame:
    """Typed stops of text rows (``node_id, stop_no, stop_name, longitude, latitude, elev_m, slope_pct``). A padded or
    empty id, a missing name, a coordinate out of range, a number that isn't one or a negative slope fails."""
    c = F.col
    bad = F.lit(False)
    for name in ("longitude", "latitude", "elev_m", "slope_pct"):
        number = c(name).cast("string").try_cast("double")
        empty = c(name).isNull() | (F.trim(c(name).cast("string")) == "")
        broken = ~empty & (number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")))
        bad = bad | (broken | empty if name in ("longitude", "latitude") else broken)
    typed = raw.select(
        c("node_id").cast("string").alias("node_id"), F.when(c("stop_no") != "", c("stop_no")).alias("stop_no"), "stop_name", c("longitude").cast("string").try_cast("double").alias("lng"),
        c("latitude").cast("string").try_cast("double").alias("lat"), measured_or_null(c("elev_m").cast("string"), nodata).alias("elev_m"),
        measured_or_null(c("slope_pct").cast("string"), nodata).alias("slope_pct"), bad.alias("__bad"),
    )
    wrong = c("__bad") | (c("node_id") == "") | (c("node_id") != F.trim("node_id")) | (F.trim("stop_name") == "") | ~c("lng").between(-180, 180) | ~c("lat").between(-90, 90)
    wrong = F.coalesce(wrong, F.lit(True)) | F.coalesce(c("slope_pct") < 0, F.lit(False))
    found = typed.where(wrong).select("node_id").limit(5).collect()
    if found:
        raise ValueError(f"stops that can't be published: {[r[0] for r in found]}")
    assert_unique(typed, ["node_id"])
    return typed.drop("__bad")


def assigned(stops: DataFrame, areas: DataFrame, size: float) -> DataFrame:
    """The area of each stop: one that holds it inside, or else the smallest code of those it borders on. A stop inside
    two areas fails, because then the areas overlap."""
    inside = (F.col("lng") > F.col("x0")) & (F.col("lng") < F.col("x1")) & (F.col("lat") > F.col("y0")) & (F.col("lat") < F.col("y1"))
    pairs = covering(stops.select("node_id", "lng", "lat"), areas, size).withColumn("interior", inside)
    counts = pairs.groupBy("node_id").agg(F.count(F.lit(1)).cast("int").alias("candidates"), F.count_if("interior").alias("interiors"))
    overlaps = counts.where("interiors > 1").count()
    if overlaps:
        raise ValueError(f"{overlaps} stops lie inside several areas")
    best = first_per(pairs, ["node_id"], [F.desc("interior"), F.col("dong").asc()]).select("node_id", "dong", "interior")
    out = stops.select("node_id").join(best, "node_id", "left").join(counts, "node_id", "left")
    method = F.when(F.col("dong").isNull(), "unmatched").when(F.col("interior"), "interior").otherwise("boundary")
    return out.select("node_id", "dong", method.alias("method"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


def counts(stops: DataFrame, assignment: DataFrame) -> dict[str, int]:
    measured = stops.agg(F.count(F.lit(1)).alias("stops"), F.count("slope_pct").alias("measured")).first()
    placed = assignment.agg(F.count(F.lit(1)).alias("rows"), F.count("dong").alias("assigned"), F.count_if(F.col("candidates") > 1).alias("ambiguous")).first()
    return measured.asDict() | placed.asDict()


def publish(root: str, dataset: str, stops: DataFrame, areas: DataFrame, size: float, active: bool = True) -> dict[str, int]:
    """Writes a dataset, counts it as it was written and publishes it; an existing id fails. Returns its counts."""
    spark = stops.sparkSession
    folder = f"{root}/dataset={dataset}"
    if path_exists(spark, folder):
        raise ValueError(f"{dataset} is published, and datasets don't change")
    stops.write.parquet(f"{folder}/stops")
    held = spark.read.parquet(f"{folder}/stops")
    assigned(held, areas, size).write.parquet(f"{folder}/assignment")
    found = counts(held, spark.read.parquet(f"{folder}/assignment"))
    if found["rows"] != found["stops"]:
        raise ValueError(f"{found['rows']} assignments of {found['stops']} stops")
    put_text(spark, f"{folder}/counts.json", json.dumps(found))
    if active:
        activate(spark, root, dataset)
    return found


class Conflict(ValueError):
    """Another activation came first."""


def _pointers(spark: SparkSession, root: str) -> list[int]:
    return [int(x.removeprefix("ACTIVE-")) for x in names_in(spark, root) if x.startswith("ACTIVE-") and x[7:].isdigit()]


def version(spark: SparkSession, root: str) -> int:
    """The number of the last activation; 0 before the first."""
    return max(_pointers(spark, root), default=0)


def activate(spark: SparkSession, root: str, dataset: str, seen: int | None = None) -> int:
    """Makes a published dataset the active one and returns the number of this activation.

    Every activation writes the pointer of the next number, which only one can create: of two that saw the same state (``seen``,
    by default the latest now) one fails, and nothing is overwritten."""
    if not path_exists(spark, f"{root}/dataset={dataset}/counts.json"):
        raise ValueError(f"{dataset} isn't published")
    number = (version(spark, root) if seen is None else seen) + 1
    if not create_text(spark, f"{root}/ACTIVE-{number:012d}", dataset):
        raise Conflict(f"activation {number} was made by another")
    return number


def active_name(spark: SparkSession, root: str) -> str:
    """The dataset of the last activation that was completed."""
    for number in sorted(_pointers(spark, root), reverse=True):
        name = get_text(spark, f"{root}/ACTIVE-{number:012d}").strip()
        if name:
            return name
    raise ValueError(f"no dataset of {root} is active")


def active(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Stops and assignment of the active dataset."""
    folder = f"{root}/dataset={active_name(spark, root)}"
    return spark.read.parquet(f"{folder}/stops"), spark.read.parquet(f"{folder}/assignment")


def steep(spark: SparkSession, root: str, over: float = 8.0) -> DataFrame:
    """Stops of the active dataset that are steeper than ``over`` percent, with their area, the ``dataset``, and the dataset's
    numbers of ``stops`` and ``measured`` ones."""
    stops, assignment = active(spark, root)
    name = active_name(spark, root)
    held = json.loads(get_text(spark, f"{root}/dataset={name}/counts.json"))
    rows = stops.where(F.col("slope_pct") > over).join(assignment.select("node_id", "dong"), "node_id", "left")
    return rows.select("node_id", "dong", "slope_pct", F.lit(name).alias("dataset"), F.lit(held["stops"]).cast("long").alias("stops"), F.lit(held["measured"]).cast("long").alias("measured"))


def retirement(master: DataFrame, root: str) -> DataFrame:
    """Whether the master's own readings (``node_id, elev_m, slope_pct``) may go because the active dataset has them: one row
    ``master_measured``, ``snapshot_measured``, ``mismatched`` (stops of both that disagree, nulls being values) and ``ok``."""
    held = active(master.sparkSession, root)[0].select("node_id", F.col("elev_m").alias("__elev"), F.col("slope_pct").alias("__slope"))
    both = master.select("node_id", "elev_m", "slope_pct", F.lit(True).alias("__m")).join(held.withColumn("__s", F.lit(True)), "node_id", "full")
    same = F.col("slope_pct").eqNullSafe(F.col("__slope")) & F.col("elev_m").eqNullSafe(F.col("__elev"))
    found = both.agg(
        F.count("slope_pct").alias("master_measured"), F.count("__slope").alias("snapshot_measured"), F.count_if(F.col("__m") & F.col("__s") & ~same).alias("mismatched")
    )
    return found.withColumn("ok", (F.col("master_measured") == F.col("snapshot_measured")) & (F.col("mismatched") == 0))


def retire(master: DataFrame, root: str) -> DataFrame:
    """The master without its readings; fails unless the active dataset has them all."""
    found = retirement(master, root).first()
    if not found["ok"]:
        raise ValueError(f"readings would be lost: {found.asDict()}")
    return master.drop("elev_m", "slope_pct")
