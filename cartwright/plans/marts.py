"""Marts built from the staging models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright.functions import money


def fct_daily_revenue(stg_transactions: DataFrame) -> DataFrame:
    """Orders and gross revenue by day, category and country, whoever the customer is."""
    return (
        stg_transactions.groupBy(F.col("txn_date").alias("sale_date"), "category", "country_code")
        .agg(
            F.count("transaction_id").alias("order_count"),
            money.rounded_total(F.col("amount")).alias("gross_revenue"),
        )
        .orderBy("sale_date", "category", "country_code")
    )


def customer_orders(stg_transactions: DataFrame) -> DataFrame:
    """Lifetime figures per customer with at least one order."""
    return stg_transactions.groupBy("customer_id").agg(
        F.min("txn_date").alias("first_order_date"),
        F.max("txn_date").alias("most_recent_order_date"),
        F.count("transaction_id").alias("number_of_orders"),
        money.rounded_total(F.col("amount")).alias("lifetime_value"),
    )


def dim_customers(stg_customers: DataFrame, stg_transactions: DataFrame) -> DataFrame:
    """One row per active customer; no orders means NULL dates, 0 orders and a value of 0.0.

    Orders are summed per customer before the join, and the sum is already partitioned by the
    join key, so the transactions are shuffled once.
    """
    return stg_customers.join(customer_orders(stg_transactions), "customer_id", "left").select(
        *stg_customers.columns,
        "first_order_date",
        "most_recent_order_date",
        F.coalesce("number_of_orders", F.lit(0)).alias("number_of_orders"),
        F.coalesce("lifetime_value", F.lit(0.0)).alias("lifetime_value"),
    )
