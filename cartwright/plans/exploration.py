"""First looks at a new table, and the filtered revenue of the format benchmark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwright.functions import money
from cartwright.sources import files, readers


def line_count(lines: DataFrame, header: str) -> DataFrame:
    """Lines in all, header lines, and the data lines that remain.

    A distributed CSV has one header per part file, so data lines are counted rather than taken as
    lines minus one.
    """
    is_header = F.col("value") == header
    return lines.agg(
        F.count("*").alias("lines"),
        F.count_if(is_header).alias("header_lines"),
        F.count_if(~is_header).alias("data_lines"),
    )


def head(spark: SparkSession, path: str, n: int = 5) -> DataFrame:
    """The first lines of the file, or of the part files of a folder in the order of their names.

    A scan of many files has no first line: Spark packs them into tasks by size. So files are taken
    by name, the first one, then four times as many until they hold ``n`` lines, and of each no more
    than ``n`` lines are read.
    """
    taken = 1
    while True:
        names = files.first_files(spark, path, taken)
        parts = [
            readers.read_lines(spark, name).limit(n)
            .select("value", F.lit(i).alias("file"), F.monotonically_increasing_id().alias("line"))
            for i, name in enumerate(names)
        ]
        lines = reduce(DataFrame.unionAll, parts).orderBy("file", "line").limit(n).select("value")
        if len(names) < taken or lines.count() >= n:
            return lines
        taken *= 4


def category_frequency(lines: DataFrame, header: str, position: int = 4) -> DataFrame:
    """How often each value of a field occurs, straight from the text lines, by value."""
    return (
        lines.where(F.col("value") != header)
        .groupBy(readers.field(F.col("value"), position).alias("category"))
        .agg(F.count("*").alias("transactions"))
        .orderBy("category")
    )


def category_avg_amount(transactions: DataFrame) -> DataFrame:
    return (
        transactions.groupBy("category")
        .agg(money.mean(F.col("amount")).alias("avg_amount"))
        .orderBy(F.desc("avg_amount"), "category")
    )


def filtered_revenue(transactions: DataFrame, category: str, country_code: str) -> DataFrame:
    """Total amount of one category in one country."""
    chosen = (F.col("category") == category) & (F.col("country_code") == country_code)
    return transactions.where(chosen).agg(money.total(F.col("amount")).alias("revenue"))
