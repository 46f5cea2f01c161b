"""Dates, months and day types as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_TYPES = ("mon", "tue", "wed", "thu", "fri", "sat", "sun_holiday")


def parse_day(c: Column) -> Column:
    """A day written with two or four digits of the year, with or without separators, as ``YYMMDD``; else null."""
    digits = F.regexp_replace(F.trim(c), "[-/.]", "")
    short = F.when(digits.rlike("^[0-9]{8}$"), F.substring(digits, 3, 6)).when(digits.rlike("^[0-9]{6}$"), digits)
    return F.when(F.try_to_date(F.concat(F.lit("20"), short), "yyyyMMdd").isNotNull(), short)


def parse_day_strict(c: Column) -> Column:
    """As ``parse_day``, but a value that is no day fails the query."""
    day = parse_day(c)
    return F.when(c.isNull() | day.isNotNull(), day).otherwise(F.raise_error(F.concat(F.lit("no day: "), c)))


def month_of(c: Column) -> Column:
    return F.date_format(c, "yyyyMM")


def month_range(first: Column, last: Column) -> Column:
    """All months from ``YYYYMM`` to ``YYYYMM``, both included; empty when they are in the wrong order."""
    day = lambda c: F.to_date(F.concat(c, F.lit("01")), "yyyyMMdd")
    months = F.transform(F.sequence(F.least(day(first), day(last)), day(last), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyyMM"))
    return F.when(first <= last, months).otherwise(F.expr("cast(array() as array<string>)"))


def previous_month(day: Column) -> Column:
    return month_of(F.add_months(day, -1))


def months_to_collect(loaded: Column, today: Column, most: int = 12) -> Column:
    """Months after the last loaded one up to the month before today, the earliest ``most``."""
    after = month_of(F.add_months(F.to_date(F.concat(loaded, F.lit("01")), "yyyyMMdd"), 1))
    return F.slice(month_range(after, previous_month(today)), 1, most)


def weekday_type(day: Column) -> Column:
    """Day type of a date that is no holiday."""
    return F.element_at(F.array(*map(F.lit, DAY_TYPES)), F.weekday(day) + 1)


def with_day_type(days: DataFrame, holidays: DataFrame, day_col: str = "day") -> DataFrame:
    """Adds ``day_type``; a holiday counts as a Sunday. ``holidays`` has a column ``date``, at most a few a month."""
    marks = holidays.select(F.col("date").alias("__holiday")).distinct()
    joined = days.join(F.broadcast(marks), F.col(day_col) == F.col("__holiday"), "left")
    kind = F.when(F.col("__holiday").isNotNull(), "sun_holiday").otherwise(weekday_type(F.col(day_col)))
    return joined.withColumn("day_type", kind).drop("__holiday")


def day_group(day: Column, holiday: Column) -> Column:
    """2 for a holiday, 1 for a weekend, 0 for other days."""
    return F.when(holiday, 2).when(F.weekday(day) >= 5, 1).otherwise(0)


def typical_day_type(day_type: Column) -> Column:
    """weekday, saturday or sunday_holiday."""
    return F.when(day_type == "sat", "saturday").when(day_type == "sun_holiday", "sunday_holiday").otherwise("weekday")


def ratio_day_type(label: Column, day_type: Column) -> Column:
    """Day type of the ratio model: that of a typical label, or that of the date."""
    name = F.regexp_extract(label, "^typical_(.*)$", 1)
    known = F.when(name == "saturday", "sat").when(name == "sunday_holiday", "sun_holiday").when(name == "weekday", "weekday")
    return F.when(label.startswith("typical_"), known).otherwise(day_type)


def month_after(ym: Column, months) -> Column:
    """The month (``YYYYMM`` as a number) that many months later, or earlier where negative."""
    months = months if isinstance(months, Column) else F.lit(months)
    total = F.floor(ym / 100) * 12 + ym % 100 - 1 + months
    return (F.floor(total / 12) * 100 + F.pmod(total, F.lit(12)) + 1).cast("int")


def months_between(first: Column, last: Column) -> Column:
    """Number of months from one to another (numbers), both included."""
    return ((F.floor(last / 100) - F.floor(first / 100)) * 12 + last % 100 - first % 100 + 1).cast("int")


def clamped_period(first: Column, last: Column, low: Column, high: Column, changed: str = "to", most: int = 12) -> Column:
    """A period inside the data, in order and of at most ``most`` months; the end that wasn't changed gives way."""
    first, last = F.greatest(first, low), F.least(last, high)
    if changed == "from":
        last = F.greatest(first, last)
        last = F.when(months_between(first, last) > most, month_after(first, most - 1)).otherwise(last)
    else:
        first = F.least(first, last)
        first = F.when(months_between(first, last) > most, month_after(last, 1 - most)).otherwise(first)
    return F.struct(first.alias("first"), last.alias("last"))


def district_day_type(days: Column) -> Column:
    """The day type of district flows that a list of chosen days stands for."""
    only = lambda day: F.coalesce((F.size(days) > 0) & F.forall(days, lambda d: d == day), F.lit(False))
    return F.when(only("sat"), "saturday").when(only("sun_holiday"), "sunday_holiday").otherwise("weekday")
