"""Bounded batches and non-empty fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_batch(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows in column order.

    A bare ``limit`` would give other rows on every run. Sorting by all columns makes the batch
    repeatable, and Spark keeps only ``n`` rows per task while doing it.
    """
    return df.orderBy(*[F.col(c) for c in df.columns]).limit(n)


def batch_or_fallback(rows: DataFrame, in_batch: Column) -> DataFrame:
    """The rows of the batch, or all rows if none is in it.

    One plan: whether there is a batch is a scalar of the same query, which reads only the columns
    of the condition. ``rows`` should be a stored table, as it is read twice.
    """
    chosen = F.coalesce(in_batch, F.lit(False))
    present = rows.select(chosen.alias("chosen")).agg(F.coalesce(F.bool_or("chosen"), F.lit(False)))
    return rows.where(chosen | ~present.scalar())


def sample_per_group(df: DataFrame, group: str, n: int, drawn: Column) -> DataFrame:
    """Exactly ``n`` rows of every group, or all of a smaller one: those with the smallest ``drawn``.

    ``drawn`` is a draw from the row's own key, so the sample is the same under any partitioning, and a
    larger ``n`` adds rows to it. Ties go by all columns. Each task keeps its ``n`` best rows of a group
    before the shuffle, so a group that holds much of the table sends no more than others.
    """
    draw, place = "sample_draw", "sample_place"
    order = Window.partitionBy(group).orderBy(draw, *[F.col(f"`{c}`") for c in df.columns])
    return (
        df.withColumn(draw, drawn).withColumn(place, F.row_number().over(order))
        .where(F.col(place) <= n).drop(draw, place)
    )
