"""Stop numbers, route labels, names and area codes as column expressions.

A stop number (ARS) is an identifier of five digits whose leading zeros matter. Sources write it in several ways, and
each consumer has a rule of its own for what can't be a number; the rules are separate functions on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VIRTUAL = "00000"
NULL_WORDS = ("nan", "None", "", "<NA>")
VIRTUAL_MARKS = ("가상", "기점가상", "경유")
#: Labels that a spreadsheet turned into dates or stripped of zeros, and what they were (fixed values).
ROUTE_LABELS = {"Jan-01": "101", "411": "0411", "40": "040"}


def clean_text(c: Column) -> Column:
    """Without byte-order marks and outer space; words that mean null are null."""
    t = F.trim(F.replace(c, F.lit("﻿"), F.lit("")))
    return F.when(~t.isin(*NULL_WORDS), t)


def strip_all_dot0(c: Column) -> Column:
    return F.replace(c, F.lit(".0"), F.lit(""))


def strip_dot0(c: Column) -> Column:
    return F.regexp_replace(c, r"\.0$", "")


def zero_fill(c: Column, width: int) -> Column:
    """Zeros on the left up to ``width``; longer values stay whole."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def ars_or_virtual(c: Column) -> Column:
    """Blank or ``nan`` is the virtual stop; digits get five places; other text stays."""
    t = F.trim(c)
    return F.when(t.isNull() | (t == "") | (F.lower(t) == "nan"), VIRTUAL).when(t.rlike("^[0-9]+$"), zero_fill(t, 5)).otherwise(t)


def ars_or_null(c: Column) -> Column:
    """Five or more digits, or null for blanks, zeros and other text."""
    t = F.trim(c)
    return F.when(t.rlike("^[0-9]+$") & ~t.rlike("^0+$"), zero_fill(t, 5))


def ars_as_keyed(c: Column) -> Column:
    """Short digit strings get five places; anything else is only trimmed."""
    t = F.trim(c)
    return F.when(t.rlike("^[0-9]{1,4}$"), F.lpad(t, 5, "0")).otherwise(t)


def is_placeholder(c: Column) -> Column:
    """Whether a stop number is missing or all zeros."""
    return strip_dot0(F.trim(F.coalesce(c, F.lit("")))).rlike("^0*$")


def ars_key(c: Column) -> Column:
    """Join key: five places, or empty for placeholders."""
    return F.when(is_placeholder(c), "").otherwise(zero_fill(strip_dot0(F.trim(c)), 5))


def ars_id(c: Column) -> Column:
    """Cleaned identifier: digits get five places, placeholder codes such as ``0000~`` stay."""
    t = F.trim(strip_dot0(clean_text(c)))
    t = F.when(t.rlike("^[0-9]+$"), zero_fill(t, 5)).otherwise(t)
    return F.when(~t.isin("nan", "none", "", "<na>"), t)


def is_real_ars(c: Column) -> Column:
    return c.rlike("^[0-9]{5}$") & (c != VIRTUAL)


def strip_zeros(c: Column) -> Column:
    """Without leading zeros, but at least one digit."""
    return F.regexp_replace(c, "^0+(?!$)", "")


def match_name(c: Column) -> Column:
    """A stop name for equality matching: lower case, no space, no separators."""
    t = F.lower(F.trim(F.replace(c, F.lit("﻿"), F.lit(""))))
    t = F.translate(F.regexp_replace(t, r"\s+", ""), ".·ㆍ-_", "")
    return F.when(~t.isin("nan", "none", "", "<na>"), t)


def without_parens(c: Column) -> Column:
    return F.regexp_replace(c, r"\([^)]*\)", "")


def route_label(c: Column) -> Column:
    out = c
    for wrong, right in ROUTE_LABELS.items():
        out = F.when(c == wrong, right).otherwise(out)
    return out


def stop_id(ars: Column, name: Column) -> Column:
    return F.coalesce(ars, F.concat(F.lit("name:"), name))


def escape_like(c: Column) -> Column:
    for x in ("\\", "%", "_"):
        c = F.replace(c, F.lit(x), F.lit("\\" + x))
    return c


def has_virtual_mark(name: Column) -> Column:
    """Whether a stop's name says that it is virtual; null names don't."""
    return F.coalesce(name.rlike("|".join(VIRTUAL_MARKS)), F.lit(False))


def gu_code(dong: Column) -> Column:
    return F.left(dong, F.lit(5))


def sigungu_key(dong: Column) -> Column:
    """The first four characters of a district code; null for a shorter one."""
    return F.when(F.length(dong) >= 4, F.left(dong, F.lit(4)))


def area_unit(dong: Column, level: str) -> Column:
    """The unit of a district code at a level: dong, gu or city; ``outside`` stays."""
    unit = {"dong": dong, "gu": gu_code(dong), "city": F.lit("11")}[level]
    return F.when(dong == "outside", dong).otherwise(unit)


def in_area(dong: Column, level: str, codes: list[str]) -> Column:
    """Whether a district lies in an area: one dong, one gu, the city, or a group of dongs."""
    if level == "gu":
        return (dong >= codes[0]) & (dong < str(int(codes[0]) + 1))
    if level == "city":
        return dong != "outside"
    return dong.isin(*codes)


def variant_route(variant: Column) -> Column:
    """The route of a variant key ``route|suffix``."""
    return F.split(variant, "[|]")[0]


def route_type(name: Column) -> Column:
    """Kind of bus route by the pattern of its number."""
    t = F.upper(F.trim(F.coalesce(name, F.lit(""))))
    rest = F.when(t.startswith("A"), F.substring(t, 2, 100)).otherwise(t)
    digits = F.regexp_extract(rest, "^[0-9]+", 0)
    return (
        F.when(F.contains(t, F.lit("한강")), "ferry").when(t == "", "other").when(t == "A21", "trunk").when(t.startswith("N"), "night")
        .when(rest.rlike("^[가-힣]+[0-9]"), "village").when(F.length(digits) == 3, "trunk").when(F.length(digits) == 2, "circular")
        .when((F.length(digits) == 4) & digits.rlike("^[1-7]"), "branch").when((F.length(digits) == 4) & digits.startswith("9"), "express")
        .otherwise("other")
    )


def matches_patterns(name: Column, ars: Column, patterns: Column) -> Column:
    """Whether a stop matches one of several LIKE patterns or ``ars:NNNNN``, separated by bars."""
    return F.exists(
        F.split(patterns, "[|]"),
        lambda p: F.when(p.startswith("ars:"), ars == F.substring(p, 5, 100)).otherwise(F.call_function("like", name, p)),
    )


def natural_key(c: Column, width: int = 20) -> Column:
    """A sort key under which numbers in names order by value: runs of digits are filled with zeros."""
    runs = F.regexp_extract_all(c, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]") & (F.length(r) < width), F.lpad(r, width, "0")).otherwise(r)), "")


def compact_id(c: Column) -> Column:
    """An identifier without blanks around it and without leading zeros; the last digit stays."""
    return F.regexp_replace(F.trim(c), "^0+(?=[0-9])", "")


def compact_name(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def file_name(*parts: Column, otherwise: str = "table") -> Column:
    """A file name of the parts that aren't empty: letters, digits, dots and dashes stay, other runs become one _."""
    clean = [F.regexp_replace(F.regexp_replace(p, r"[^\p{L}\p{N}.-]+", "_"), "^_+|_+$", "") for p in parts]
    name = F.concat_ws("-", *[F.when(p != "", p) for p in clean])
    return F.concat(F.when(name == "", otherwise).otherwise(name), F.lit(".csv"))
