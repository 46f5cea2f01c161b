"""Day-type hourly profiles from monthly counts, and daily trips spread over hours.

A month's count is a weighted sum of seven day-type patterns; the weights are the numbers of such days in the month.
The minimum-norm least-squares solution is linear in the counts, so the pseudo-inverse is computed once per distinct
set of observed months, inside tasks, and applied by a join and a sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendars import DAY_TYPES, month_of, with_day_type
from ..functions.identifiers import ars_or_virtual, is_real_ars
from ..functions.numbers import normalised, to_places

#: Shares of a day's boardings by hour where no profile is known, before they are scaled to 1 (fixed values).
DEFAULT_PROFILE = (
    0.01, 0.005, 0.003, 0.002, 0.01, 0.04, 0.08, 0.11, 0.09, 0.05, 0.04, 0.04,
    0.05, 0.05, 0.05, 0.06, 0.08, 0.10, 0.09, 0.06, 0.04, 0.025, 0.015, 0.005,
)
#: The same for alightings (fixed values).
DEFAULT_ALIGHTING = (
    0.005, 0.003, 0.002, 0.002, 0.008, 0.03, 0.07, 0.10, 0.10, 0.055, 0.045, 0.045,
    0.05, 0.05, 0.05, 0.06, 0.085, 0.105, 0.095, 0.065, 0.045, 0.03, 0.015, 0.005,
)
WEEKDAYS = DAY_TYPES[:5]
FITTED, ZERO_FIT, NO_KEY = "fitted", "default_zero_fit", "default_no_key"


def default_profile(of: tuple = DEFAULT_PROFILE) -> list[float]:
    return [x / sum(of) for x in of]


def distributed(daily: DataFrame, profiles: DataFrame, value: str, key: str = "stop") -> DataFrame:
    """A daily ``value`` of each row over 24 hours: ``hour``, ``boarding`` and ``alighting``, two decimals. ``profiles`` has
    ``hour``, ``boardings`` and ``alightings`` of keys; a key without 24 hours of a measure or a sum of it gets its default."""
    pairs = F.sort_array(F.collect_list(F.struct("hour", "boardings", "alightings")))
    shares = lambda name: normalised(F.transform("hours", lambda x: x[name].cast("double"))).alias(f"__{name}")
    known = profiles.groupBy(key).agg(pairs.alias("hours")).select(key, shares("boardings"), shares("alightings"))
    of = lambda name, default: F.coalesce(name, F.array(*map(F.lit, default_profile(default))))
    rows = daily.join(known, key, "left").withColumn("share", F.arrays_zip(of("__boardings", DEFAULT_PROFILE).alias("b"), of("__alightings", DEFAULT_ALIGHTING).alias("a")))
    spread_out = rows.select(*daily.columns, F.posexplode("share").alias("hour", "share"))
    part = lambda x: to_places(F.col(value) * F.col(f"share.{x}"), 2)
    return spread_out.select(*daily.columns, "hour", part("b").alias("boarding"), part("a").alias("alighting"))


def month_counts(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """Days of each type in each month: one column per day type. ``days`` has ``day``."""
    typed = with_day_type(days.select("day").distinct(), holidays)
    counts = typed.groupBy(month_of(F.col("day")).cast("int").alias("use_ym")).agg(*[F.count_if(F.col("day_type") == d).alias(d) for d in DAY_TYPES])
    return counts


def month_days(months: DataFrame, ym: str = "use_ym") -> DataFrame:
    """All days of the months (numbers as 202401) that occur in a table; nulls are left out."""
    number = F.col(ym).cast("int")
    first = F.make_date(F.floor(number / 100).cast("int"), number % 100, F.lit(1))
    return months.select(ym).distinct().select(F.explode(F.sequence(first, F.last_day(first))).alias("day"))


def calendar(spark, first: str, last: str) -> DataFrame:
    """All days from the first to the last date."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))


def solve(counts: DataFrame, values: DataFrame, keys: list[str], value: str, columns: list[str], min_months: int = 3, clip: bool = True) -> DataFrame:
    """Least squares per group of ``keys``: ``day_type`` and ``x`` for each of ``columns`` of the month counts.

    ``values`` has ``use_ym`` and the measure, one row per key and month. Groups with fewer than ``min_months`` months
    are left out. The month counts are a small table (a row per month) and go to the tasks, which invert each distinct set
    of months that occurs.
    """
    design = {r["use_ym"]: [float(r[c]) for c in columns] for r in counts.select("use_ym", *columns).collect()}
    rows = values.where(F.col("use_ym").isin(sorted(design)))
    masks = rows.groupBy(*keys).agg(F.sort_array(F.collect_set("use_ym")).alias("mask")).where(F.size("mask") >= min_months)

    def inverted(batches):
        for batch in batches:
            mask, month, name, coef = [], [], [], []
            for months in batch.column(0).to_pylist():
                a = np.array([design[m] for m in months])
                p = np.linalg.pinv(a, rcond=np.finfo(float).eps * max(a.shape))
                mask += [months] * p.size
                month += [m for m in months for _ in columns]
                name += list(columns) * len(months)
                coef += p.T.ravel().tolist()
            arrays = [pa.array(mask, pa.list_(pa.int32())), pa.array(month, pa.int32()), pa.array(name, pa.string()), pa.array(coef, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["mask", "use_ym", "day_type", "coef"])

    table = masks.select(F.col("mask").cast("array<int>").alias("mask")).distinct().mapInArrow(inverted, "mask array<int>, use_ym int, day_type string, coef double")
    joined = rows.join(masks, keys).join(table, ["mask", "use_ym"])
    x = F.sum(F.col("coef") * F.col(value))
    return joined.groupBy(*keys, "day_type").agg((F.greatest(F.lit(0.0), x) if clip else x).alias("x"))


def ratios(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``ratio``, the value's share of its group; 0 where the group has none."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return values.withColumn("ratio", F.when(total == 0, 0.0).otherwise(F.col(value) / total))


def bad_profiles(profiles: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose ratios aren't 24 distinct hours of finite numbers of 0 or more that sum to 0 or 1."""
    finite = F.col("ratio").isNotNull() & ~F.isnan("ratio") & (F.abs("ratio") < float("inf"))
    checks = profiles.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("hour").alias("hours"), F.count_if(~finite | (F.col("ratio") < 0)).alias("bad"), F.sum("ratio").alias("total")
    )
    whole = (F.abs("total") <= 1e-6) | (F.abs(F.col("total") - 1) <= 1e-6)
    return checks.where(~((F.col("n") == 24) & (F.col("hours") == 24) & (F.col("bad") == 0) & F.coalesce(whole, F.lit(False))))


def pattern_sums(profiles: DataFrame, keys: list[str], by: list[str], tolerance: float = 0.01) -> DataFrame:
    """Per ``by``: ``groups`` of ``keys``, those whose ratios sum to 0 (``zero``), and those of the rest whose sum is off 1 by more
    than the tolerance (``off``). Sums are taken to 12 decimals, so that one at the limit doesn't depend on the order of its rows."""
    sums = profiles.groupBy(*keys).agg(F.sum("ratio").alias("s"))
    zero = F.coalesce(F.col("s") == 0, F.lit(True))
    return sums.groupBy(*by).agg(F.count(F.lit(1)).alias("groups"), F.count_if(zero).alias("zero"), F.count_if(~zero & (F.abs(F.round("s", 12) - 1) > tolerance)).alias("off"))


def weekday_means(profiles: DataFrame) -> DataFrame:
    """Mean of the fitted Monday to Friday profiles of each route and stop; ``profiles`` has ``fitted``."""
    fitted = profiles.where(F.col("day_type").isin(*WEEKDAYS) & F.col("fitted"))
    return fitted.groupBy("route", "ars", "hour").agg(F.avg("ratio").alias("ratio"))


def day_profiles(counts: DataFrame, value: str = "boardings") -> DataFrame:
    """From counts by ``route``, ``ars`` and ``hour``, several rows or none for an hour: ``profile``, the day's 24 shares, and
    ``total``, which is 0 where the counts are (the shares are 0 too)."""
    known = counts.where("route is not null and ars is not null and hour between 0 and 23")
    sums = known.groupBy("route", "ars", "hour").agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("n"))
    days = sums.groupBy("route", "ars").agg(F.map_from_entries(F.collect_list(F.struct("hour", "n"))).alias("hours"), F.sum("n").alias("total"))
    share = lambda h: F.when(F.col("total") == 0, 0.0).otherwise(F.coalesce(F.try_element_at("hours", h), F.lit(0.0)) / F.col("total"))
    return days.select("route", "ars", F.transform(F.sequence(F.lit(0), F.lit(23)), share).alias("profile"), "total")


def spread(trips: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each trip row (``route``, ``ars``, ``passengers``) over 24 hours, with the ``method`` used; totals are kept.
    ``profiles`` has ``route``, ``ars``, ``hour``, ``ratio``; a profile that sums to 0 gives way to the default."""
    hours = F.transform(F.sort_array(F.collect_list(F.struct("hour", "ratio"))), lambda x: x["ratio"])
    return spread_over(trips, profiles.groupBy("route", "ars").agg(hours.alias("profile"), F.sum("ratio").alias("total")))


def spread_over(trips: DataFrame, profiles: DataFrame) -> DataFrame:
    """As ``spread``, with a row per profile (``route``, ``ars``, ``profile``, ``total``), as ``day_profiles`` gives them."""
    joined = with_profile(trips, profiles)
    hours = joined.select(*trips.columns, "method", F.posexplode("used").alias("hour", "share"))
    return hours.withColumn("hourly", F.col("passengers") * F.col("share")).drop("share")


def with_profile(trips: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds ``method`` and ``used``, the 24 shares: the stop's own, or the default where it has none or one that sums to 0."""
    default = F.array(*map(F.lit, default_profile()))
    joined = trips.join(profiles.select("route", "ars", "profile", "total"), ["route", "ars"], "left")
    method = F.when(F.col("profile").isNull(), NO_KEY).when(F.col("total") == 0, ZERO_FIT).otherwise(FITTED)
    return joined.select(*trips.columns, method.alias("method"), F.when(method == FITTED, F.col("profile")).otherwise(default).alias("used"))


def riders_in_hours(trips: DataFrame, profiles: DataFrame, first: int, last: int) -> DataFrame:
    """Riders of each trip row that board from hour ``first`` to ``last``, as ``riders``. Stops without a number of five digits
    can't be split over hours and are dropped; there is no fallback for them."""
    usable = trips.withColumn("ars", ars_or_virtual(F.col("ars"))).where(is_real_ars(F.col("ars")))
    share = F.aggregate(F.slice("used", first + 1, last - first + 1), F.lit(0.0), lambda s, x: s + x)
    return with_profile(usable, profiles).withColumn("riders", F.col("passengers") * share).drop("used")


def visits_merged(monthly: DataFrame) -> DataFrame:
    """Rows of one month, route, stop and hour summed over visits; every key gets 24 hours, with 0 where unseen."""
    sums = monthly.groupBy("use_ym", "route", "ars", "hour").agg(F.sum("boardings").alias("boardings"))
    keys = monthly.groupBy("use_ym", "route", "ars").agg(F.min("visit").alias("visit"))
    hours = keys.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return hours.join(sums, ["use_ym", "route", "ars", "hour"], "left").fillna(0.0, ["boardings"])
