"""Places of rows in a total order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwright.llm.common import stored


def ranked(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with each row's place from 0 on when sorted by the columns ``order``, nulls first.

    Rows are dealt out by ranges and written; a row's place is the number of rows in earlier ranges, of
    which the driver holds one number a range, and its place in its own. Rows equal in all of ``order``
    meet in one task, so ``order`` should end in a column that tells them apart. An empty table stays
    empty.
    """
    parts = stored(df.repartitionByRange(*order).withColumn("rank_part", F.spark_partition_id()), "ranges")
    starts, before = [], 0
    for row in sorted(parts.groupBy("rank_part").count().collect()):
        starts.append((row["rank_part"], before))
        before += row["count"]
    first = df.sparkSession.createDataFrame(starts, "rank_part int, rank_start long")
    inside = F.row_number().over(Window.partitionBy("rank_part").orderBy(*order)) - 1
    return (
        parts.join(F.broadcast(first), "rank_part")
        .withColumn(name, F.col("rank_start") + inside)
        .drop("rank_part", "rank_start")
    )
