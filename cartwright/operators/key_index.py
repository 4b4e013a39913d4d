"""A stored index of the keys that earlier batches hold, for checking a new batch without reading them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "batch_id"


def create_index(spark: SparkSession, name: str, path: str, key: str, kind: str = "string", buckets: int | None = None) -> str:
    """An empty index by batch and, inside, by hash of the key, if there is none of that name.

    It has as many buckets as the session has shuffle partitions, if not said otherwise: then a batch that has
    been summed by key meets it as it is. With fewer, Spark would rather shuffle the index.
    """
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({key} {kind}, copies BIGINT, {BATCH} INT) USING parquet"
        f" PARTITIONED BY ({BATCH}) CLUSTERED BY ({key}) SORTED BY ({key}) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )
    return name


def add_batch(spark: SparkSession, name: str, batch: DataFrame, batch_id: int) -> None:
    """Adds the batch's keys with their copies, in place of those of an earlier batch of this number.

    NULL is no key. Copies are counted before the shuffle, so a hot key is a row per task there.
    """
    key = spark.table(name).columns[0]
    keys = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
    view = f"keys_{int(batch_id)}_of_{name.replace('.', '_')}"
    keys.createOrReplaceTempView(view)
    spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION ({BATCH} = {int(batch_id)}) SELECT * FROM {view}")
    spark.catalog.dropTempView(view)


def violations(spark: SparkSession, name: str, batch: DataFrame, batch_id: int) -> DataFrame:
    """Keys of a batch that it holds more than once or that another batch holds: value, copies, earlier_copies.

    The batch is summed by key and so shuffled to the index's buckets; the index is not shuffled, and the
    other batches themselves are not read. The batch may be in the index already.
    """
    index = spark.table(name)
    key = index.columns[0]
    new = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
    others = index.where(F.col(BATCH) != int(batch_id)).groupBy(key).agg(F.sum("copies").alias("earlier_copies"))
    found = new.join(others.hint("merge"), key, "left")
    return found.select(
        F.col(key).alias("value"), "copies", F.coalesce("earlier_copies", F.lit(0)).alias("earlier_copies")
    ).where((F.col("copies") > 1) | (F.col("earlier_copies") > 0))
