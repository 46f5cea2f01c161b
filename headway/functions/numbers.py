"""Rounding, shares, classes and colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column, digits: int = 0) -> Column:
    """Rounded half up (towards positive infinity)."""
    scale = 10.0**digits
    return F.floor(c * scale + 0.5) / scale


def to_places(c: Column, digits: int) -> Column:
    """Rounded half away from zero as SQL engines do it, by the scaled number: 0.575 is just below the half once it is scaled."""
    scale = 10.0**digits
    return F.round(c * scale) / scale


def to_count(c: Column) -> Column:
    """A measure as a whole number, ties to even."""
    return F.rint(c).cast("long")


def relative_congestion(occupancy: Column, most: Column) -> Column:
    """Percent of the route's largest occupancy, one decimal; 0 without one."""
    return F.when(most <= 0, 0.0).otherwise(half_up(occupancy * 100.0 / most, 1))


def congestion_level(percent: Column) -> Column:
    return F.when(percent < 20, "very_low").when(percent < 40, "low").when(percent < 60, "medium").when(percent < 80, "high").otherwise("very_high")


def gradient_color(percent: Column) -> Column:
    """Green over yellow to red as ``#RRGGBB``; channels are cut to whole numbers."""
    scaled = F.greatest(F.lit(0.0), F.least(percent / 100.0, F.lit(1.0))) * 4
    index = F.least(scaled, F.lit(3.0)).cast("int")
    weight = scaled - index

    def channel(stops: Column) -> Column:
        low, high = F.element_at(stops, index + 1), F.element_at(stops, index + 2)
        return F.lpad(F.hex((low + (high - low) * weight).cast("long")), 2, "0")

    red, green, blue = (F.array(*map(F.lit, x)) for x in ((0, 128, 255, 255, 255), (255, 255, 255, 128, 0), (0, 0, 0, 0, 0)))
    return F.concat(F.lit("#"), channel(red), channel(green), channel(blue))


def slope_band(slope: Column) -> Column:
    return F.when(slope.isNull(), "none").when(slope <= 4, "0-4").when(slope <= 8, "4-8").when(slope <= 12, "8-12").otherwise("12+")


def quantile_breaks(values: Column, classes: int) -> Column:
    """Class limits of a sorted array: element floor(k n / classes) for k from 1."""
    n = F.size(values)
    at = lambda k: F.least(n - 1, F.floor(F.lit(k) * n / classes).cast("int")) + 1
    return F.array(*[F.element_at(values, at(k).cast("int")) for k in range(1, classes)])


def class_of(value: Column, breaks: Column) -> Column:
    """The number of limits that a value reaches."""
    return F.size(F.filter(breaks, lambda b: value >= b))


def log_breaks(low: float, high: Column, classes: int) -> Column:
    """Limits spaced by equal factors, one decimal."""
    step = F.ln(high / low) / classes
    return F.array(*[F.round(low * F.exp(step * k), 1) for k in range(1, classes)])


def shade(value: Column, most: Column) -> Column:
    return 0.08 + 0.67 * F.sqrt(value / most)


def fixed_scale(most_of_hour: Column, first: Column, last: Column, fixed: Column) -> Column:
    """Top of a scale that stays the same for every window of hours as wide as the one shown: the busiest hour's largest load
    times the hours shown. Null unless the scale is fixed, hours are chosen and there is a load."""
    return F.when(fixed & first.isNotNull() & last.isNotNull() & (most_of_hour > 0), most_of_hour * (last - first + 1))


def percent_text(part: Column, total: Column) -> Column:
    return F.when(total > 0, F.format_string("%.1f%%", half_up(part * 100.0 / total, 1))).otherwise("-")


def steep_ratio(steep: Column, measured: Column) -> Column:
    """Percent of measured stops, one decimal half up; null without any."""
    return F.when(measured != 0, F.round(steep.cast("decimal(20,4)") * 100 / measured.cast("decimal(20,4)"), 1).cast("double"))


def hours_share(profile: Column, first: Column, last: Column) -> Column:
    """The part of a 24-hour profile that lies in hours ``first`` to ``last``."""
    return F.aggregate(F.slice(profile, first + 1, last - first + 1), F.lit(0.0), lambda a, x: a + x)


def normalised(vector: Column) -> Column:
    """A vector divided by its sum; null unless it has 24 numbers of 0 or more and a positive sum."""
    total = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x)
    good = (F.size(vector) == 24) & F.forall(vector, lambda x: x >= 0) & (total > 0)
    return F.when(good, F.transform(vector, lambda x: x / total))


def measured_or_null(text: Column, nodata: float = -9999.0, least: float | None = None) -> Column:
    """A finite number that isn't the no-data mark, nor below ``least``; else null."""
    x = text.try_cast("double")
    good = ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))) & (x != nodata)
    return F.when(good & (x >= least) if least is not None else good, x)


def number_or_zero(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))
