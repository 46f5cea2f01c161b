"""Mixing sources to target weights along a time-varying curriculum, with DataFrame expressions only.

1. Targets: sources share the budget by weight; no source gets more than ``max_repeats`` times its size, and what it
   leaves goes to the others by weight (water filling over one row per source).
2. Taking: the documents of a source stand in a fixed pseudo-random order, repeated until the target is met; the
   last one is taken in part, so that a source's taken words equal its rounded target.
3. Positions: a source's weight schedule is piecewise linear over training time 0..1. Its integral, scaled to the
   target, is the source's cumulative demand; inverting it at a copy's place among the source's taken words (pass after
   pass over the source) gives the copy's training position, and copies are range-sorted by it.

Running sums are two-level (hash buckets of a bounded number of rows, then rows in a bucket), so that no task holds a
whole source. Null and empty texts have size 0: nothing is taken from them, and they have no position. Null sources
are a source of their own, the last. Repeated rows count as often as they occur. Other columns are kept as they are
where ``keep`` names them; those that have the name of an added one give way to it. Rows of one id, or without one, are told
apart by their texts, so that they are spread over buckets and reruns agree whatever the order of the input. Sources are ranked in
one task, a row each: some millions of them, not one per page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3.0
#: Schedules by rank of the source: (time, weight) knots of a piecewise linear function.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))
ADDED = ("size", "source_size", "target", "taken", "copies", "positions", "position")
#: Rows in a bucket of the running sums, on average.
BUCKET_ROWS = 5000


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _by_rank(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget_share: float = 1.0, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """From one row per source (``source``, ``source_size``; a small table): its ``rank``, ``weight`` and ``target``."""
    everything = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", _by_rank(weights, F.col("rank"))).withColumn("cap", max_repeats * F.col("source_size"))
    # sources by the water level at which they are full; the level is the first at which all after it fit
    order = everything.orderBy((F.col("cap") / F.col("weight")), "rank")
    filled = (
        ranked.withColumn("budget", budget_share * F.sum("source_size").over(everything))
        .withColumn("full_before", F.sum("cap").over(order) - F.col("cap"))
        .withColumn("weight_from", F.sum("weight").over(everything) - F.sum("weight").over(order) + F.col("weight"))
        .withColumn("level", (F.col("budget") - F.col("full_before")) / F.col("weight_from"))
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("first_open", F.min(F.when(F.col("open"), F.col("cap") / F.col("weight"))).over(everything))
        .withColumn("water", F.max(F.when(F.col("open") & (F.col("cap") / F.col("weight") == F.col("first_open")), F.col("level"))).over(everything))
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).cast("double")
    return filled.select("source", "source_size", "rank", "weight", target.alias("target"))


def _knots(schedules: tuple, rank: Column) -> Column:
    """The rank's schedule as an array of pieces: times t, u, weights v, w, and the integral before t."""
    built = []
    for knots in schedules:
        done, pieces = 0.0, []
        for (t, v), (u, w) in zip(knots[:-1], knots[1:]):
            pieces.append(F.struct(*[F.lit(float(x)).alias(n) for x, n in ((t, "t"), (u, "u"), (v, "v"), (w, "w"), (done, "before"))]))
            done += (u - t) * (v + w) / 2
        built.append(F.struct(F.array(*pieces).alias("pieces"), F.lit(done).alias("total")))
    return F.element_at(F.array(*built), (F.pmod(rank - 1, F.lit(len(built))) + 1).cast("int"))


def position(schedule: Column, share: Column) -> Column:
    """The training time at which the integral of the schedule reaches ``share`` of its total."""
    want = share * schedule["total"]
    piece = F.element_at(F.filter(schedule["pieces"], lambda p: (p["before"] <= want) | (p["before"] == 0)), -1)
    rest = F.greatest(F.lit(0.0), want - piece["before"])
    slope = (piece["w"] - piece["v"]) / (piece["u"] - piece["t"])
    root = F.sqrt(F.greatest(F.lit(0.0), piece["v"] * piece["v"] + 2 * slope * rest))
    # the solution of v x + slope x^2 / 2 = rest that stays exact for a slope near zero
    return F.least(F.lit(1.0), piece["t"] + F.coalesce(F.try_divide(2 * rest, piece["v"] + root), F.lit(0.0)))


def narrow_columns(id_col: str, text_col: str, source_col: str) -> list[Column]:
    """What the running sums need of a row: id, source, size and its place in the pseudo-random order."""
    place = F.xxhash64(F.col(id_col), F.xxhash64(text_col), F.lit("mix"))  # rows of one id, or without one, are spread by their texts
    return [F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), place.alias("hash")]


def mix(
    docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple = WEIGHTS, schedules: tuple = SCHEDULES, budget_share: float = 1.0, max_repeats: float = MAX_REPEATS,
) -> DataFrame:
    """The columns ``keep`` of every row with ``size``, ``source_size``, ``target``, ``taken`` (words, repeats
    counted), ``copies`` (taken / size, rounded), ``positions`` (training time of every copy, the one taken in part
    included; null if none) and ``position`` (the first of them)."""
    keep = [c for c in keep if c.lower() not in ADDED]
    kept = [F.col(c).alias(f"__{c}") for c in keep]
    sized = saved(docs.select(*narrow_columns(id_col, text_col, source_col)), "sized")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sizes, weights, budget_share, max_repeats).withColumn("schedule", _knots(schedules, F.col("rank")))
    buckets = max(1, -(-sized.count() // BUCKET_ROWS))
    in_bucket = F.pmod("hash", F.lit(buckets)).alias("bucket")
    sums = sized.select("*", in_bucket).groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = sums.withColumn("bucket_start", F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size"))
    plan = before.join(goals, before["source"].eqNullSafe(goals["source"])).select(
        before["source"].alias("b_source"), F.col("bucket").alias("b_bucket"), "bucket_start", "source_size", "target", "schedule"
    )
    if set(keep) <= {id_col, source_col}:
        own = {id_col: "id", source_col: "source"}
        spread = sized.select("*", in_bucket, *[F.col(own[c]).alias(f"__{c}") for c in keep])
    else:  # wide rows are read again rather than written once more
        spread = docs.select(*narrow_columns(id_col, text_col, source_col), *kept).select("*", in_bucket)
    inner = Window.partitionBy("source", "bucket").orderBy("hash", "id", "size", *[f"__{c}" for c in keep if c != text_col]).rowsBetween(Window.unboundedPreceding, 0)
    rows = spread.withColumn("in_bucket", F.sum("size").over(inner) - F.col("size"))
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["b_source"]) & (rows["bucket"] == plan["b_bucket"]))
    start = F.col("bucket_start") + F.col("in_bucket")
    goal = F.round("target").cast("long")
    whole = F.coalesce(F.expr("try_divide(round(target), source_size)"), F.lit(0.0))
    rows = rows.withColumn("start", start).withColumn("rounds", F.floor(whole)).withColumn("goal", goal)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - F.col("rounds") * F.col("source_size") - F.col("start")))
    rows = rows.withColumn("taken", (F.col("rounds") * F.col("size") + part).cast("long"))
    # pass k over the source begins at k times its size; the last one takes the document in part
    passes = F.sequence(F.lit(0).cast("long"), F.ceil(F.expr("try_divide(taken, size)")) - 1)
    share = lambda k: F.try_divide(F.col("start") + k * F.col("source_size") + F.least(F.col("size"), F.col("taken") - k * F.col("size")) / 2, F.col("goal").cast("double"))
    rows = rows.withColumn("positions", F.when(F.col("taken") > 0, F.transform(passes, lambda k: position(F.col("schedule"), share(k)))))
    return rows.select(
        *[F.col(f"__{c}").alias(c) for c in keep],
        "size",
        "source_size",
        "target",
        "taken",
        F.coalesce(F.round(F.expr("try_divide(taken, size)")), F.lit(0)).cast("int").alias("copies"),
        "positions",
        F.get("positions", F.lit(0)).alias("position"),
    )


def each_copy(mixed: DataFrame) -> DataFrame:
    """A row per copy of the rows of ``mix``, each with its own ``position``."""
    return mixed.where("copies > 0").withColumn("position", F.explode(F.slice("positions", F.lit(1), F.col("copies"))))


def in_training_order(mixed: DataFrame) -> DataFrame:
    """Range-sorted by position; rows that the mix leaves out come last, spread over tasks by a hash."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), F.xxhash64(*[c for c in mixed.columns if c != "text"]))
