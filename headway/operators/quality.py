"""Checks of tables: coverage, multiset differences, fingerprints, noise floors and publication gates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with ``side``."""
    right = right.select(*left.columns)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows and a digest that doesn't depend on their order: a sum of row hashes. Doubles count by their exact bits."""
    row = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("digest"))


def coverage(rows: DataFrame, reference: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Rows whose key the reference has, and the percent, per group."""
    known = reference.select(key).distinct().withColumn("__hit", F.lit(True))
    joined = rows.join(known, key, "left")
    out = joined.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count("__hit").alias("matched"))
    return out.withColumn("percent", F.round(F.col("matched") * 100.0 / F.col("rows"), 2))


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    """Raises where a key occurs twice or is null."""
    bad = df.groupBy(*keys).count().where("count > 1 or " + " or ".join(f"{k} is null" for k in keys)).limit(3).collect()
    if bad:
        raise ValueError(f"keys that are repeated or empty: {bad}")


def log_factorial(k: Column) -> Column:
    """ln k! of whole numbers of 0 or more: from a table below 10, else by Stirling's series (error below 1e-12)."""
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(10)])
    x = k.cast("double")
    series = x * F.ln(x) - x + 0.5 * F.ln(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(k < 10, F.get(table, k.cast("int"))).otherwise(series)


def poisson_floor(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Expected mean absolute deviation of Poisson counts with each key's mean: 2 e^-m m^(k+1) / k!, k = floor(m)."""
    means = rows.groupBy(*key).agg(F.avg(value).alias("__m"))
    k = F.floor("__m")
    floor = 2 * F.exp(-F.col("__m") + (k + 1) * F.ln("__m") - log_factorial(k))
    return means.select(*key, F.col("__m").alias("mean"), F.when(F.col("__m") > 0, floor).otherwise(0.0).alias("floor"))


def quality_report(df: DataFrame) -> DataFrame:
    """Per column: nulls, empty strings and distinct lengths of the text form. One pass; the lengths of a column are few."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.length(F.col(c).cast("string")).alias("chars")) for c in df.columns])).alias("x"))
    return cells.groupBy(F.col("x.column").alias("column")).agg(
        F.count_if(F.col("x.chars").isNull()).alias("nulls"), F.count_if(F.col("x.chars") == 0).alias("empty"), F.size(F.collect_set("x.chars")).cast("long").alias("lengths")
    )
