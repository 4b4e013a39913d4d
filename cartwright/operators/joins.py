"""Left joins to a dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one in so many rows of the fact side; so there are fewer hot keys.
HOT_SHARE = 256


def left_join(fact: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Spark broadcasts the dimension if its own size check allows, and sort-merges it if not.

    Beyond the threshold adaptive execution splits a hot or NULL key's partition on the fact side.
    """
    return fact.join(dimension, key, "left")


def left_join_sort_merge(fact: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Both sides shuffled and sorted by the key, whatever the dimension's size."""
    return fact.join(dimension.hint("merge"), key, "left")


def hot_keys(fact: DataFrame, key: str, share: int = HOT_SHARE) -> list:
    """The keys, NULL aside, that hold more than one in ``share`` rows; fewer than ``share``, by counting all.

    Counts are combined before the shuffle, so a hot key is a row for each task there.
    """
    counts = fact.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).scalar()
    hot = counts.where(F.col(key).isNotNull() & (F.col("rows") * share > total))
    return [row[0] for row in hot.select(key).collect()]


def left_join_salted(fact: DataFrame, dimension: DataFrame, key: str, salts: int, share: int = HOT_SHARE) -> DataFrame:
    """The left join with the rows of hot keys dealt over ``salts`` tasks.

    A fact row of a hot key, or without a key, gets a salt from a hash of its columns; the hot keys' rows
    of the dimension are repeated for every salt, all others have salt 0. Unlike splitting skewed
    partitions at run time this also works where the fact side is shuffled once for the join and what comes
    after it. Fact rows that are equal in every column share a salt. ``fact`` is read twice, so it
    should be a stored table; columns named ``salt`` on either side stay as they are.
    """
    salt = "join_salt"
    hot = hot_keys(fact, key, share)
    mixed = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in fact.columns]), F.lit(salts)).cast("int")
    is_hot = F.col(key).isNull() | F.col(key).isin(hot)
    salted = fact.withColumn(salt, F.when(is_hot, mixed).otherwise(0))
    copies = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    spread = dimension.withColumn(salt, F.explode(copies))
    return salted.join(spread.hint("merge"), [key, salt], "left").drop(salt)
