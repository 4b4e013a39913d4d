"""Revenue summaries of the transactions table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright.functions import calendar, money
from cartwright.operators import joins


def category_country_summary(transactions: DataFrame) -> DataFrame:
    """Revenue and orders of completed transactions by category and country.

    Only NULL amounts are left out; zero and negative amounts count.
    """
    return (
        transactions.where(F.col("status") == "completed")
        .where(F.col("amount").isNotNull())
        .groupBy("category", "country_code")
        .agg(
            money.rounded_total(F.col("amount")).alias("total_revenue"),
            F.count("transaction_id").alias("order_count"),
        )
        .orderBy("category", "country_code")
    )


def _clean_sales(transactions: DataFrame) -> DataFrame:
    amount = F.col("amount")
    return (
        transactions.where(F.col("transaction_id").isNotNull())
        .where(money.known(amount) > 0)
        .select(
            calendar.day(F.col("txn_timestamp")).alias("sale_date"),
            "category",
            "product_id",
            money.whole(amount).alias("units"),
            money.millionths(amount).alias("parts"),
            F.lit(1).alias("tx"),
        )
    )


def _summed(rows: DataFrame, *group: str) -> DataFrame:
    return rows.groupBy(*group).agg(*[F.sum(c).alias(c) for c in ("units", "parts", "tx")])


def _priced(sums: DataFrame) -> DataFrame:
    return sums.select(
        "sale_date", "category", money.from_parts(F.col("units"), F.col("parts")).alias("total_revenue"),
        F.col("tx").alias("tx_count"),
    )


def daily_summary_by_product_category(
    transactions: DataFrame, products: DataFrame,
    join: Callable[[DataFrame, DataFrame, str], DataFrame] = joins.left_join,
) -> DataFrame:
    """Revenue and transactions by day and the *product's* category.

    A transaction without a known product counts under a NULL category. The sales are summed by day
    and product before the join, so it sees sums: a product with a third of all sales is one row per
    day. The transaction's own category goes with that sum.
    """
    sums = _summed(_clean_sales(transactions), "sale_date", "product_id")
    joined = join(sums, products.select("product_id", "category"), "product_id")
    return _priced(_summed(joined, "sale_date", "category"))


def daily_summary_by_fact_category(transactions: DataFrame) -> DataFrame:
    """Revenue and transactions by day and the *transaction's* category, in that order."""
    sums = _summed(_clean_sales(transactions), "sale_date", "category")
    return _priced(sums).orderBy("sale_date", "category")


def daily_summary_by_fact_category_joined(transactions: DataFrame, products: DataFrame) -> DataFrame:
    """The same over transactions that are sort-merged with their products first."""
    names = products.select("product_id", "product_name")
    joined = joins.left_join_sort_merge(_clean_sales(transactions), names, "product_id")
    return _priced(_summed(joined, "sale_date", "category")).orderBy("sale_date", "category")


def write_daily_summary(summary: DataFrame, path: str) -> str:
    """A directory per day, each written by one task.

    A day has one row per category, so the work is the number of files, not their bytes; with the
    session's number of shuffle partitions adaptive execution doesn't merge it all into one task.
    """
    tasks = int(summary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    summary.repartition(tasks, "sale_date").write.mode("overwrite").partitionBy("sale_date").parquet(path)
    return path


def write_daily_summary_by_month(summary: DataFrame, path: str) -> str:
    """A directory per month, one file each, its days in order.

    Some thirty times fewer files than a directory per day, which is most of the time of that write; a day
    is still found by its month's directory and the row groups' bounds.
    """
    tasks = int(summary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dated = summary.withColumn("sale_month", calendar.month_start(F.col("sale_date")))
    (
        dated.repartition(tasks, "sale_month").sortWithinPartitions("sale_month", "sale_date")
        .write.mode("overwrite").partitionBy("sale_month").parquet(path)
    )
    return path


def summary_of_days(daily: DataFrame, days: DataFrame) -> DataFrame:
    """The rows of a summary stored by month for the days that another table lists in ``sale_date``.

    Joined by month too, so that a broadcast list of days tells the scan at run time which months to read.
    """
    wanted = days.select(calendar.month_start(F.col("sale_date")).alias("sale_month"), "sale_date").distinct()
    return daily.join(wanted, ["sale_month", "sale_date"], "left_semi").drop("sale_month")
