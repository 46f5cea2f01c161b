"""Checks of request parameters as column expressions.

Each check gives the text of what is wrong, or null; blank optional parameters are right. They serve logs of requests as
well as single ones (``require``).
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MOST_MONTHS, MOST_NODES = 12, 10_000
#: Catchment radii in metres, and the area of service (latitudes, longitudes).
RADII, LATITUDES, LONGITUDES = (400, 800, 1000), (33.0, 39.5), (124.0, 132.5)
MODES, DAY_TYPES, PREFIX = ("bus", "subway"), ("weekday", "saturday", "sunday_holiday"), "typical_"

_MONTH = "[0-9]{4}-(0[1-9]|1[0-2])"


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def _wrong(bad: Column, text: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), F.lit(text))


def first_error(*checks: Column) -> Column:
    return F.coalesce(*checks)


def mode_error(c: Column) -> Column:
    return _wrong(~c.isin(*MODES), "mode must be bus or subway")


def node_limit_error(c: Column) -> Column:
    return F.when(c.isNotNull(), _wrong(~c.between(1, MOST_NODES), f"limit must be 1 to {MOST_NODES}"))


def radius_error(c: Column) -> Column:
    return _wrong(~c.isin(*RADII), "radius must be one of " + ", ".join(map(str, RADII)))


def district_error(c: Column) -> Column:
    return _wrong(~c.rlike("^[0-9]{8,10}$"), "district must have 8 to 10 digits")


def coordinate_error(lat: Column, lng: Column) -> Column:
    return _wrong(~(lat.between(*LATITUDES) & lng.between(*LONGITUDES)), "coordinate is outside the area of service")


def keyword_error(c: Column) -> Column:
    return _wrong(F.length(F.trim(c)) < 2, "keyword must have 2 characters or more")


def period(c: Column) -> Column:
    """``from`` and ``to`` (``YYYYMM``) of ``YYYY-MM`` or ``YYYY-MM..YYYY-MM``; null where blank or malformed."""
    text = F.trim(c)
    ends = F.split(text, r" *\.\. *")
    month = lambda x: F.replace(x, F.lit("-"))
    return F.when(text.rlike(rf"^{_MONTH}( *\.\. *{_MONTH})?$"), F.struct(month(ends[0]).alias("from"), month(F.element_at(ends, -1)).alias("to")))


def month_index(ym: Column) -> Column:
    """Months since year 0 of ``YYYYMM``."""
    number = ym.cast("int")
    return F.floor(number / 100).cast("int") * 12 + number % 100 - 1


def period_error(c: Column) -> Column:
    p = period(c)
    months = month_index(p["to"]) - month_index(p["from"]) + 1
    wrong = F.when(p.isNull(), "period must be YYYY-MM or YYYY-MM..YYYY-MM").when(months < 1, "the first month comes after the last").when(months > MOST_MONTHS, f"no more than {MOST_MONTHS} months at once")
    return F.when(~blank(c), wrong)


def hours(c: Column) -> Column:
    """``from`` and ``to`` of ``H`` or ``H-H``; null where blank or malformed."""
    text = F.trim(c)
    ends = F.split(text, "-")
    number = lambda x: F.trim(x).try_cast("int")
    return F.when(text.rlike(r"^[0-9]{1,9}( *- *[0-9]{1,9})?$"), F.struct(number(ends[0]).alias("from"), number(F.element_at(ends, -1)).alias("to")))


def hours_error(c: Column) -> Column:
    h = hours(c)
    wrong = F.when(h.isNull(), "hours must be H or H-H").when((h["from"] > 23) | (h["to"] > 23), "hours must be 0 to 23").when(h["to"] < h["from"], "hours must run forward")
    return F.when(~blank(c), wrong)


def typical_label(c: Column) -> Column:
    """The label of a typical day: of a day type or a label; the weekday where blank, null for anything else."""
    kind = F.regexp_replace(F.trim(c), f"^{PREFIX}", "")
    return F.when(blank(c), PREFIX + DAY_TYPES[0]).when(kind.isin(*DAY_TYPES), F.concat(F.lit(PREFIX), kind))


def page_rows(limit: Column, usual: int = 100, most: int = 1000) -> Column:
    """Rows of a page: the usual number where none or less than one is asked for, and never more than ``most``."""
    return F.when(limit.isNull() | (limit <= 0), usual).otherwise(F.least(limit, F.lit(most)))


def require(spark: SparkSession, *checks: Column) -> None:
    """Raises the first error of a single request, whose checks are over literals."""
    error = spark.range(1).select(first_error(*checks, F.lit(None).cast("string"))).first()[0]
    if error:
        raise ValueError(error)
