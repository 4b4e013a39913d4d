"""Writers. Each returns the path or table it wrote, so that a plan can read it back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F

from cartwright.sources.readers import TIMESTAMP_FORMAT


def counted(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` whose rows are counted as they are written, as ``rows``, and further aggregates by name.

    Counting has to be the last step before the writer: the tasks of the writing stage count once each,
    while a stage before a shuffle may run again for a lost executor. After the write the observation's
    ``get`` has the values; what was written is not read.
    """
    seen = Observation()
    own = [metric.alias(name) for name, metric in metrics.items()]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *own), seen


def write_counted(df: DataFrame, write: Callable[[DataFrame], str]) -> tuple[str, int]:
    """What ``write`` returns for ``df``, and the number of rows that it wrote."""
    watched, seen = counted(df)
    return write(watched), seen.get["rows"]


def named_values(spark: SparkSession, values: dict, key: str, value: str, kind: str = "bigint") -> DataFrame:
    """A row per entry of a small dict, as literals of the plan."""
    rows = [F.struct(F.lit(k).alias(key), F.lit(v).cast(kind).alias(value)) for k, v in values.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _csv_writer(df: DataFrame) -> DataFrameWriter:
    """Blanks around values are kept."""
    return (
        df.write.option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("timestampNTZFormat", TIMESTAMP_FORMAT)
    )


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with a header in every part file. Blanks around values are kept."""
    _csv_writer(df).mode("overwrite").option("header", True).csv(path)
    return path


#: Folder of a part in a CSV of a fixed number of parts.
CSV_PART = "csv_part"


def write_csv_in_parts(df: DataFrame, path: str, parts: int) -> str:
    """CSV in a fixed number of parts with a header each, at any size and also without rows.

    A part is a folder: a file with the header and those of the tasks that are dealt to it. Rows are written
    where they are, so there are as many writing tasks as ``df`` has partitions, and none reads a whole part.
    """
    part = F.pmod(F.spark_partition_id(), F.lit(parts)).alias(CSV_PART)
    _csv_writer(df.select("*", part)).mode("overwrite").partitionBy(CSV_PART).csv(path)
    names = [F.lit(name).alias(name) for name in df.columns]
    headers = df.sparkSession.range(parts).select(*names, F.col("id").cast("int").alias(CSV_PART))
    _csv_writer(headers).mode("append").partitionBy(CSV_PART).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, codec: str | None = None) -> str:
    """Replaces whatever is at ``path``; ``codec`` None means the session's default."""
    writer = df.write.mode("overwrite")
    if codec is not None:
        writer = writer.option("compression", codec)
    writer.parquet(path)
    return path


def rebalanced(df: DataFrame, *columns: str) -> DataFrame:
    """Rows of one partition value together, for a partitioned write.

    Unlike ``repartition`` it lets adaptive execution split a value that holds much of the data
    over several tasks, and merge small ones.
    """
    return df.hint("rebalance", *columns)


def write_partitioned(df: DataFrame, path: str, *columns: str, codec: str | None = None) -> str:
    """One directory per partition value, without a small file per task and value."""
    writer = rebalanced(df, *columns).write.mode("overwrite").partitionBy(*columns)
    if codec is not None:
        writer = writer.option("compression", codec)
    writer.parquet(path)
    return path


def create_table_as(df: DataFrame, name: str, path: str) -> str:
    """Catalog table ``name`` with the rows of ``df``, replacing an earlier one."""
    df.write.mode("overwrite").option("path", path).saveAsTable(name)
    return name


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int, key: str) -> str:
    """Catalog table ``name`` in ``buckets`` files by hash of ``key``, each sorted by it.

    Tables bucketed alike by their join key are joined, or summed by it, without a shuffle. The rows are
    dealt by bucket first, so every bucket is one file. Buckets can't be split at read time: for keys of
    which one may hold much of the table see ``joins.left_join_salted``.
    """
    (
        df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
        .option("path", path).saveAsTable(name)
    )
    return name


def create_view(df: DataFrame, name: str) -> str:
    df.createOrReplaceTempView(name)
    return name


def schema_rows(df: DataFrame, table_name: str) -> DataFrame:
    """The schema as rows: table, column, type."""
    spark = df.sparkSession
    rows = [(table_name, f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")


def display_number(value):
    """Whole number with thousands separators."""
    return F.format_number(value, 0)
