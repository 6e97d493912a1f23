"""Dates as signed years with optional months and days (0: unknown), and Julian day numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: int) -> Column:
    """Integer division towards zero."""
    return F.call_function("div", a.cast("long"), F.lit(b).cast("long"))


def julian_day(year: Column, month: Column, day: Column) -> Column:
    """Julian day number of a proleptic Gregorian date; an unknown month or day counts as the first."""
    m = F.when(month == 0, 1).otherwise(month).cast("long")
    d = F.when(day == 0, 1).otherwise(day).cast("long")
    a = div(14 - m, 12)
    y = year.cast("long") + 4800 - a
    return d + div(153 * (m + 12 * a - 3) + 2, 5) + 365 * y + div(y, 4) - div(y, 100) + div(y, 400) - 32045


def leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def month_days(year: Column, month: Column) -> Column:
    return F.when(month == 2, F.when(leap(year), 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def jd_bounds(year: Column, month: Column, day: Column) -> tuple[Column, Column]:
    """First and last Julian day that a date, known to the year, month or day, can mean."""
    low = julian_day(year, month, F.when(month == 0, 0).otherwise(day))
    last_month = F.when(month == 0, 12).otherwise(month)
    last_day = F.when((month != 0) & (day != 0), day).otherwise(month_days(year, last_month))
    return low, julian_day(year, last_month, last_day)


def format_partial_date(year: Column, month: Column, day: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD; empty if all parts are unknown."""
    text = F.concat(F.when(year < 0, "-").otherwise(""), F.format_string("%04d", F.abs(year)))
    text = F.concat(text, F.when(month > 0, F.format_string("-%02d", month)).otherwise(""), F.when((month > 0) & (day > 0), F.format_string("-%02d", day)).otherwise(""))
    return F.when((year == 0) & (month == 0) & (day == 0), "").otherwise(text)


def parse_range(token: Column) -> Column:
    """-1: up to the date, 1: from the date on, 0: at the date."""
    t = F.lower(F.trim(token))
    return F.when(t.isin("lt", "lte", "<", "<=", "-1"), -1).when(t.isin("gt", "gte", ">", ">=", "+1", "1"), 1).otherwise(0)


def clamp_month_day(month: Column, day: Column) -> tuple[Column, Column]:
    """Parts outside the calendar are unknown."""
    return F.when(month.between(1, 12), month).otherwise(0), F.when(day.between(1, 31), day).otherwise(0)


def parse_time(text: Column) -> tuple[Column, Column, Column]:
    """Year, month and day of "+1879-03-14T00:00:00Z"; years of any length, a part that can't be read is 0."""
    part = lambda k: F.coalesce(F.regexp_extract(text, r"^([+-]?\d+)-(\d{2})-(\d{2})", k).try_cast("int"), F.lit(0))
    return part(1), part(2), part(3)
