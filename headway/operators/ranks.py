"""Places of rows in an order over a whole table, and exact quantiles from them.

Rows are range-sorted into files once; a row's place is its place in its file plus the rows of the files before. No task sees
more than its range, and only a row per file is ever brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import saved


def placed(rows: DataFrame, order: list[Column], place: str = "place") -> DataFrame:
    """The rows with their ``place`` in the order, from 0; rows that the order doesn't tell apart stand in any order."""
    sorted_rows = saved(rows.orderBy(*order), "sorted")
    number = lambda k: F.regexp_extract("_metadata.file_name", r"^part-(\d+)-.*-c(\d+)\.", k).cast("long")
    with_file = sorted_rows.select("*", (number(1) * (1 << 20) + number(2)).alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = with_file.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy().orderBy("__file")) - F.col("__n")  # a row per file
    shifts = files.select("__file", before.alias("__before"))
    return with_file.join(shifts, "__file").select(*rows.columns, (F.col("__before") + F.col("__row")).alias(place))


def at_places(rows: DataFrame, column: str, wanted) -> list:
    """The values of a column, nulls left out, at places of its order: ``wanted(n)`` gives them for ``n`` values. What is
    brought together are those values."""
    order = placed(rows.where(F.col(column).isNotNull()).select(column), [F.col(column).asc()])
    n = order.agg(F.max("place")).first()[0]
    if n is None:
        return []
    places = wanted(n + 1)
    found = {r["place"]: r[column] for r in order.where(F.col("place").isin(sorted(set(places)))).collect()}
    return [found[p] for p in places]


def quantile(rows: DataFrame, column: str, share: float) -> float | None:
    """The exact quantile, between neighbours by proportion; null without values."""
    at = []

    def wanted(n: int) -> list[int]:
        at.append(share * (n - 1))
        return [int(at[0]), min(n - 1, int(at[0]) + 1)]

    found = at_places(rows, column, wanted)
    return found[0] + (at[0] - int(at[0])) * (found[1] - found[0]) if found else None


def class_limits(rows: DataFrame, column: str, classes: int) -> list:
    """Limits of ``classes`` classes of about equal numbers of rows: the value at place floor(k n / classes) for k from 1."""
    return at_places(rows, column, lambda n: [min(n - 1, k * n // classes) for k in range(1, classes)])


def class_limits_by(rows: DataFrame, group: str, column: str, classes: int, limits: str = "breaks") -> DataFrame:
    """``class_limits`` of every group, as an array: equal values are counted first, and their counts summed in order."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(group, column).agg(F.count(F.lit(1)).alias("__n"))
    run = Window.partitionBy(group).orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    so_far = counts.select(group, column, F.sum("__n").over(run).alias("__upto"), F.sum("__n").over(Window.partitionBy(group)).alias("__all"))
    place = lambda k: F.least(F.col("__all") - 1, F.floor(F.lit(k) * F.col("__all") / classes))
    return so_far.groupBy(group).agg(F.array(*[F.min(F.when(F.col("__upto") > place(k), F.col(column))) for k in range(1, classes)]).alias(limits))
