"""Storage formats: conversion, size and write-time comparison, loading of raw tables."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwright.operators import sinks
from cartwright.sources import files, readers, schemas

BASE_FORMAT = "csv"
FORMATS = {
    "csv": lambda df, path: sinks.write_csv(df, path),
    "parquet_zstd": lambda df, path: sinks.write_parquet(df, path, "zstd"),
    "parquet_snappy": lambda df, path: sinks.write_parquet(df, path, "snappy"),
}
OPTIONAL_FORMATS = {"parquet_snappy"}


@dataclass(frozen=True)
class FormatRun:
    """How long writing a format took and how many rows went in; None if its codec is missing."""

    seconds: float | None
    rows: int | None


def write_formats_counted(df: DataFrame, folder: str) -> dict[str, FormatRun]:
    """Writes ``df`` in every format, counting rows on the way.

    A codec this cluster lacks is reported as None, if the format is an optional one.
    """
    runs: dict[str, FormatRun] = {}
    for name, write in FORMATS.items():
        began = time.perf_counter()
        try:
            _, rows = sinks.write_counted(df, lambda watched, write=write, name=name: write(watched, f"{folder}/{name}"))
        except IllegalArgumentException as error:
            if name not in OPTIONAL_FORMATS or "codec" not in str(error).lower():
                raise
            runs[name] = FormatRun(None, None)
        else:
            runs[name] = FormatRun(round(time.perf_counter() - began, 2), rows)
    return runs


def write_formats(df: DataFrame, folder: str) -> dict[str, float | None]:
    """The same; seconds per format."""
    return {name: run.seconds for name, run in write_formats_counted(df, folder).items()}


def counted_format_report(spark: SparkSession, folder: str, runs: dict[str, FormatRun]) -> DataFrame:
    """``storage_format_report`` with the rows that each write counted."""
    report = storage_format_report(spark, folder, {name: run.seconds for name, run in runs.items()})
    rows = sinks.named_values(spark, {name: run.rows for name, run in runs.items()}, "format", "row_count")
    return report.join(F.broadcast(rows), "format")


def storage_format_report(spark: SparkSession, folder: str,
                          seconds: dict[str, float | None]) -> DataFrame:
    """Per format: files, size, size reduction against CSV, write time.

    Sizes come from one listing of the folder. The timings are one row per format.
    """
    data_files = files.listing(spark, folder).where(F.col("path").rlike(r"/part-[^/]*$"))
    name = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)
    sizes = data_files.groupBy(name.alias("format")).agg(
        F.count("*").alias("files"), F.sum("bytes").alias("bytes")
    )
    timings = sinks.named_values(spark, seconds, "format", "write_seconds", "double")
    base = sizes.where(F.col("format") == BASE_FORMAT).select(F.col("bytes").alias("base_bytes"))
    measured = timings.join(sizes, "format", "left").withColumn(
        "base_bytes", base.scalar()
    )
    reduction = (1 - F.col("bytes") / F.col("base_bytes")) * 100
    return measured.select(
        "format",
        "files",
        "bytes",
        F.round(files.megabytes(F.col("bytes")), 1).alias("size_mb"),
        F.when(F.col("format") != BASE_FORMAT, F.round(reduction, 1)).alias("size_reduction_pct"),
        "write_seconds",
    )


def format_row_counts(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Rows read back from every format."""
    counts = []
    for name in FORMATS:
        path = f"{folder}/{name}"
        stored = readers.read_csv(spark, path, schema) if name == BASE_FORMAT else spark.read.parquet(path)
        counts.append(stored.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("format"), "row_count"
        ))
    return reduce(DataFrame.unionAll, counts)


@dataclass(frozen=True)
class Parted:
    """A CSV's good rows in its declared columns, its malformed lines with their file, and how many of each."""

    good: DataFrame
    malformed: DataFrame
    good_rows: int
    malformed_rows: int


def part_csv(spark: SparkSession, csv_path: str, folder: str, schema) -> Parted:
    """Reads a CSV once and stores good rows and malformed lines apart, as Parquet below ``folder``.

    One write, partitioned by the verdict, so neither part is parsed again; the counts come with the
    write. A file of bad lines alone is no error here: what to do with many of them is the caller's choice.
    """
    rows = readers.read_csv_permissive(spark, csv_path, schema).withColumns(
        {"source_file": F.col("_metadata.file_name"), "is_malformed": F.col(readers.MALFORMED).isNotNull()}
    )
    watched, seen = sinks.counted(rows, malformed=F.count(readers.MALFORMED))
    watched.write.mode("overwrite").partitionBy("is_malformed").parquet(folder)
    malformed = seen.get["malformed"]
    stored = spark.read.schema(rows.schema).parquet(folder)
    return Parted(
        stored.where(~F.col("is_malformed")).select(*schema.names),
        stored.where("is_malformed").select("source_file", readers.MALFORMED),
        seen.get["rows"] - malformed,
        malformed,
    )


def write_seed_csv(tables: dict[str, DataFrame], folder: str) -> str:
    for name, df in tables.items():
        sinks.write_csv(df, f"{folder}/{name}.csv")
    return folder


def convert_csv_to_columnar(spark: SparkSession, csv_paths: dict[str, str], parquet_folder: str,
                            tables=schemas.SEED_TABLES) -> DataFrame:
    """Each CSV table as Parquet; one row per table with the number of rows that the write counted."""
    counts = {}
    for name, csv_path in csv_paths.items():
        path = f"{parquet_folder}/{name}.parquet"
        rows = readers.read_csv(spark, csv_path, tables[name])
        _, counts[name] = sinks.write_counted(rows, lambda watched, path=path: sinks.write_parquet(watched, path))
    return sinks.named_values(spark, counts, "table_name", "row_count")


def load_raw_tables(tables: dict[str, DataFrame], folder: str, prefix: str = "raw_",
                    suffix: str = "") -> dict[str, str]:
    """Catalog tables with the rows of ``tables``, replacing earlier ones. Names by key."""
    return {
        key: sinks.create_table_as(df, f"{prefix}{key}{suffix}", f"{folder}/{prefix}{key}")
        for key, df in tables.items()
    }


def load_raw_tables_counted(tables: dict[str, DataFrame], folder: str, prefix: str = "raw_",
                            suffix: str = "") -> tuple[dict[str, str], dict[str, int]]:
    """The same, and the number of rows that went into each; the tables are not read again."""
    watched = {key: sinks.counted(df) for key, df in tables.items()}
    names = load_raw_tables({key: df for key, (df, _) in watched.items()}, folder, prefix, suffix)
    return names, {key: seen.get["rows"] for key, (_, seen) in watched.items()}


def table_counts(spark: SparkSession, names: dict[str, str]) -> DataFrame:
    """Rows per table; ``names`` maps a label to a catalog table."""
    return reduce(DataFrame.unionAll, [
        spark.table(name).agg(F.count("*").alias("row_count")).select(
            F.lit(label).alias("table_name"), "row_count"
        )
        for label, name in names.items()
    ])


def table_schemas(spark: SparkSession, names: dict[str, str]) -> DataFrame:
    """Columns and types of the tables, one row per column."""
    return reduce(DataFrame.unionAll, [
        sinks.schema_rows(spark.table(name), label) for label, name in names.items()
    ])
