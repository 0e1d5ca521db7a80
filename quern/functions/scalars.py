"""Scalar functions of prices, times and calendars, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def significant(x: Column, digits: int) -> Column:
    """Rounded to so many significant digits; 0 stays 0."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) + 1 - digits)
    return F.when(x == 0, 0.0).otherwise(F.round(x / scale) * scale)


def round_to(x: Column, step: float) -> Column:
    """The multiple of step nearest to x, halves away from zero."""
    return F.round(x / step) * step


def truncate(x: Column, places: int) -> Column:
    """Digits beyond so many places cut off."""
    m = F.pow(F.lit(10.0), F.lit(places))
    return F.when(x >= 0, F.floor(x * m)).otherwise(F.ceil(x * m)) / m


def smart_round(x: Column) -> Column:
    """Whole from 1,000 on, two places from 1 on, else seven significant digits."""
    a = F.abs(x)
    return F.when(a >= 1000, F.round(x)).when(a >= 1, F.round(x, 2)).otherwise(significant(x, 7))


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0))), F.lit(default))


def floor_time(us: Column, step: int) -> Column:
    return us - F.pmod(us, F.lit(step))


def ceil_time(us: Column, step: int) -> Column:
    return us + F.pmod(-us, F.lit(step))


def round_time(us: Column, step: int) -> Column:
    """The nearest multiple, halves up."""
    return floor_time(us + step // 2, step)


def is_business_day(d: Column) -> Column:
    return ~F.dayofweek(d).isin(1, 7)


def end_of_week(d: Column) -> Column:
    """The Monday after."""
    return F.next_day(d, "Mon")


def end_of_month(d: Column) -> Column:
    """The first of the next month."""
    return F.date_add(F.last_day(d), 1)


def end_of_quarter(d: Column) -> Column:
    return F.add_months(F.date_trunc("quarter", d).cast("date"), 3)


def end_of_year(d: Column) -> Column:
    return F.add_months(F.date_trunc("year", d).cast("date"), 12)


def next_business_day(d: Column) -> Column:
    day = F.dayofweek(d)
    return F.date_add(d, F.when(day == 6, 3).when(day == 7, 2).otherwise(1))


def previous_business_day(d: Column) -> Column:
    day = F.dayofweek(d)
    return F.date_sub(d, F.when(day == 2, 3).when(day == 1, 2).otherwise(1))


def plain_ticker(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), "[-_/]", "")


def column_name(s: Column) -> Column:
    """Only letters, digits and underscores."""
    return F.regexp_replace(F.lower(s), "[^a-z0-9_]", "_")
