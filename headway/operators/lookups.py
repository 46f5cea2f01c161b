"""Lookups that never guess, and first-row picks with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def holidays(lines: DataFrame) -> DataFrame:
    """``date`` and ``name`` from lines of text (``line``, ``day``, ``name``): both trimmed, a line whose day isn't YYYY-MM-DD left
    out, and the last line of a date taken."""
    dated = lines.select("line", F.try_to_date(F.trim("day"), "yyyy-MM-dd").alias("date"), F.trim("name").alias("name")).where("date is not null")
    return dated.groupBy("date").agg(F.max_by("name", "line").alias("name"))


def unambiguous(table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with exactly one distinct non-empty value: ``keys`` and ``value``."""
    rows = table.where(F.col(value).isNotNull() & (F.col(value) != ""))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return rows.groupBy(*keys).agg(F.count_distinct(value).alias("__n"), F.min(value).alias(value)).where("__n = 1").drop("__n")


def fill(rows: DataFrame, table: DataFrame, on: dict[str, str], value: str, source: str, when: Column | None = None) -> DataFrame:
    """Fills a null or empty ``value`` from an unambiguous lookup of ``source``; ``on`` maps row columns to its keys.
    The number of rows stays."""
    found = unambiguous(table, list(on.values()), source)
    found = found.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(on.values())], F.col(source).alias("__v"))
    same = F.lit(True)
    for i, c in enumerate(on):
        same = same & (rows[c] == found[f"__k{i}"])
    joined = rows.join(found, same, "left")
    missing = F.col(value).isNull() | (F.col(value) == "")
    if when is not None:
        missing = missing & when
    return joined.withColumn(value, F.when(missing, F.coalesce("__v", value)).otherwise(F.col(value))).select(*rows.columns)


def first_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by a total order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def top_per(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def cascade(rows: DataFrame, table: DataFrame, row_id: str, stages: list[list[str]], value: str) -> DataFrame:
    """Matches rows on the keys of each stage in turn: a row found by one stage isn't tried again. Per row ``row_id``,
    ``value`` (null where a stage finds several), ``stage`` from 1 and ``candidates``."""
    left, found = rows, None
    for i, keys in enumerate(stages, 1):
        values = table.groupBy(*keys).agg(F.count_distinct(value).alias("candidates"), F.min(value).alias(value))
        hit = left.join(values, keys).select(row_id, F.when(F.col("candidates") == 1, F.col(value)).alias(value), F.lit(i).alias("stage"), "candidates")
        found = hit if found is None else found.unionByName(hit)
        left = left.join(hit.select(row_id), row_id, "left_anti")
    return found


def two_forms(keys: DataFrame, column: str) -> DataFrame:
    """Each padded key with itself and with its form without leading zeros, as ``form``."""
    short = F.regexp_replace(F.col(column), "^0+(?!$)", "")
    return keys.withColumn("form", F.explode(F.array_distinct(F.array(F.col(column), short))))


def fallback_union(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the first table, and those of the second whose keys it lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def update_from(rows: DataFrame, fixes: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Takes ``column`` from the fix of the same keys where there is one that isn't null; keys of fixes are unique."""
    fix = fixes.select(*keys, F.col(column).alias("__fix"))
    return rows.join(fix, keys, "left").withColumn(column, F.coalesce("__fix", column)).select(*rows.columns)


def values_of(rows: DataFrame, on: dict[str, str], table: DataFrame, values: list[str], hit: str = "hit") -> DataFrame:
    """``values`` of the table row whose keys equal the row's (``on`` maps row columns to keys; nulls match nothing),
    and whether there is one. Keys that occur twice in the table fail when the join meets them."""
    keys = list(on.values())
    found = table.dropna(subset=keys).groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    once = found.agg(*[F.first(v).alias(f"__v{i}") for i, v in enumerate(values)], F.count(F.lit(1)).alias("__n"))
    same = F.lit(True)
    for i, c in enumerate(on):
        same = same & (rows[c] == once[f"__k{i}"])
    n = F.when(F.col("__n") > 1, F.raise_error(F.lit(f"the lookup's keys {keys} are not unique")).cast("long")).otherwise(F.col("__n"))
    joined = rows.join(once, same, "left").withColumn(hit, n.isNotNull())
    return joined.select(*rows.columns, *[F.col(f"__v{i}").alias(v) for i, v in enumerate(values)], hit)


def voted(rows: DataFrame, reference: DataFrame, key: str, choice: str, on: list[str]) -> DataFrame:
    """For each ``key`` of ``rows`` the ``choice`` of the reference that shares most of its distinct ``on`` values, ties to the
    smallest; ``votes`` is their number."""
    mine = rows.select(key, *on).dropna().distinct()
    theirs = reference.select(choice, *on).dropna().distinct()
    votes = mine.join(theirs, on).groupBy(key, choice).agg(F.count(F.lit(1)).alias("votes"))
    return first_per(votes, [key], [F.desc("votes"), F.col(choice).asc()])
