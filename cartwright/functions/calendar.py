"""Dates, months and fixed-step time series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(moment: Column) -> Column:
    """Calendar date of a timestamp, a date, or their text form."""
    return F.to_date(moment)


def moment(value: Column) -> Column:
    """Wall-clock timestamp. Zone-free, so its month never depends on the session's time zone."""
    return value.cast("timestamp_ntz")


def month_start(value: Column) -> Column:
    """First day of the month, used as the partition value of month-partitioned tables."""
    return F.trunc(F.to_date(value), "month")


def in_month(value: Column, month: int, year: int | None = None) -> Column:
    """Month-of-year predicate; every year matches unless one is given."""
    matches = F.month(value) == month
    return matches if year is None else matches & (F.year(value) == year)


def step(start: str, index: Column, seconds: int) -> Column:
    """The ``index``-th point of a series with a fixed step, counted from ``start``."""
    return F.timestamp_add("SECOND", index * F.lit(seconds), F.lit(start).cast("timestamp_ntz"))
