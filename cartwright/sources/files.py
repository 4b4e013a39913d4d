"""What is on disk, from file listings. File contents are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEGABYTE = 1024**2


def listing(spark: SparkSession, path: str) -> DataFrame:
    """One row per data file below ``path``: path, bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"))


def first_files(spark: SparkSession, path: str, n: int) -> list[str]:
    """The first ``n`` data files by name."""
    return [row["path"] for row in listing(spark, path).orderBy("path").limit(n).collect()]


def megabytes(size):
    return size / F.lit(MEGABYTE)


def input_readiness(spark: SparkSession, folder: str, required: list[str]) -> DataFrame:
    """OK or MISSING per required table of a folder, with its size.

    A table is a ``<name>.parquet`` file or folder.
    """
    table = F.regexp_extract("path", r"/([^/]+)\.parquet(/|$)", 1)
    present = (
        listing(spark, folder)
        .groupBy(table.alias("table_name"))
        .agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    )
    wanted = spark.createDataFrame([(name,) for name in required], "table_name string")
    return wanted.join(present, "table_name", "left").select(
        "table_name",
        F.when(F.col("files").isNull(), "MISSING").otherwise("OK").alias("status"),
        F.coalesce("files", F.lit(0)).alias("files"),
        F.round(F.coalesce(megabytes(F.col("bytes")), F.lit(0.0)), 2).alias("size_mb"),
    )
