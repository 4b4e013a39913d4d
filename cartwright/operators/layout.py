"""A layout in which filters on several columns skip row groups: rows along a Z-order curve."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a column's ordinal; seven columns fit a 64-bit key.
BITS = 8


def hashed_ordinal(column: str, bits: int = BITS) -> Column:
    """For columns that are compared for equality: equal values have equal ordinals; NULL has 0."""
    return F.coalesce(F.pmod(F.xxhash64(column), F.lit(1 << bits)), F.lit(0)).cast("bigint")


def ranged_ordinal(df: DataFrame, column: str, bits: int = BITS) -> Column:
    """For numbers, dates and times that are compared by range: equally many rows to each ordinal, about.

    The bounds are approximate percentiles of all rows, fewer than 2**bits numbers. A value's ordinal is the
    number of bounds that it reaches. NULL and NaN have 0.
    """
    kind = dict(df.dtypes)[column]
    value = F.col(column).cast("timestamp").cast("double") if kind in ("date", "timestamp_ntz") else F.col(column).cast("double")
    cuts = (1 << bits) - 1
    shares = F.array(*[F.lit((i + 1) / (cuts + 1)) for i in range(cuts)])
    known = F.nanvl(value, F.lit(None).cast("double"))
    bounds = df.agg(F.percentile_approx(known, shares, 4 << bits).alias("bounds")).first()["bounds"]
    if not bounds:
        return F.lit(0).cast("bigint")
    reached = F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda bound: bound <= known)
    return F.size(reached).cast("bigint")


def z_key(ordinals: list[Column], bits: int = BITS) -> Column:
    """The bits of the ordinals in turn, the first ordinal's highest bit first, as one 64-bit integer."""
    if len(ordinals) * bits > 63:
        raise ValueError(f"{len(ordinals)} ordinals of {bits} bits don't fit a 64-bit key")
    placed = [
        F.shiftleft(F.shiftright(ordinal, bit).bitwiseAND(F.lit(1).cast("bigint")), bit * len(ordinals) + len(ordinals) - 1 - n)
        for n, ordinal in enumerate(ordinals) for bit in range(bits)
    ]
    return reduce(Column.bitwiseOR, placed)


def write_z_ordered(df: DataFrame, path: str, equal: list[str], ranged: list[str] = (), files: int | None = None,
                    bits: int = BITS) -> str:
    """Parquet whose files each hold one stretch of the curve through the columns.

    A filter on any of the columns then meets few files and row groups: the others are skipped by their
    bounds and dictionaries. Rows with equal keys may be split over files by a hash of the row, so a value
    that fills a third of the table makes no giant file. ``df`` is read more than once, so it should be stored.
    """
    key, tie = "z_key", "z_tie"
    ordinals = [hashed_ordinal(c, bits) for c in equal] + [ranged_ordinal(df, c, bits) for c in ranged]
    keyed = df.withColumns({key: z_key(ordinals, bits), tie: F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])})
    spread = keyed.repartitionByRange(files, key, tie) if files else keyed.repartitionByRange(key, tie)
    spread.sortWithinPartitions(key).drop(key, tie).write.mode("overwrite").parquet(path)
    return path
