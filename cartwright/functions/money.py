"""Exact money arithmetic.

A double sum depends on the order in which partitions arrive. Here an amount is split into its whole
units and its millionths, and both are summed as 64-bit integers: the total is exact for amounts of
up to six decimals, the same under any partitioning or retry, and several times faster than summing
decimals, whose buffers are BigDecimals. Only the total is rounded. NULL and NaN amounts are left
out. A sum beyond 9.2e18 units raises an overflow error (ANSI mode) instead of wrapping.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MILLION = 1_000_000


def known(amount: Column) -> Column:
    """The amount, or NULL for NaN."""
    return F.nanvl(amount, F.lit(None).cast("double"))


def whole(amount: Column) -> Column:
    return F.floor(known(amount)).cast("bigint")


def millionths(amount: Column) -> Column:
    """What stands above the whole units, from 0 to a million."""
    amount = known(amount)
    return F.floor((amount - F.floor(amount)) * MILLION + 0.5).cast("bigint")


def from_parts(units: Column, parts: Column) -> Column:
    """Summed whole units and millionths as a double."""
    exact = units.cast("decimal(20,0)") + parts.cast("decimal(20,0)") * F.lit("0.000001").cast("decimal(7,6)")
    return exact.cast("double")


def total(amount: Column) -> Column:
    """Sum of the known amounts; NULL if there are none."""
    return from_parts(F.sum(whole(amount)), F.sum(millionths(amount)))


def rounded_total(amount: Column) -> Column:
    return F.round(total(amount), 2)


def mean(amount: Column) -> Column:
    """Average of the known amounts, two decimals."""
    return F.round(total(amount) / F.count(known(amount)), 2)
