"""Aggregates over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwright.functions import money as exact
from cartwright.queries.base import store_query
from cartwright.queries.canonical import money, over_store

@store_query("sum_filtered", "A1 F2", over_store(
    f"SELECT {money()} AS revenue FROM transactions WHERE status = 'completed' AND category = '5-LOW'"))
def sum_filtered(store):
    chosen = (F.col("status") == "completed") & (F.col("category") == "5-LOW")
    return store.transactions.where(chosen).agg(exact.total(F.col("amount")).alias("revenue"))


@store_query("sum_grouped", "A2 A10", over_store(
    f"SELECT category, {money()} AS revenue FROM transactions GROUP BY 1"))
def sum_grouped(store):
    return store.transactions.groupBy("category").agg(exact.total(F.col("amount")).alias("revenue"))


@store_query("sum_rounded", "A3 X5", over_store(
    f"SELECT country_code, ROUND({money()}, 2) AS revenue FROM transactions GROUP BY 1"))
def sum_rounded(store):
    return store.transactions.groupBy("country_code").agg(
        F.round(exact.total(F.col("amount")), 2).alias("revenue"))


@store_query("count_column", "A4", over_store(
    "SELECT category, COUNT(transaction_id) AS identified FROM transactions GROUP BY 1"))
def count_column(store):
    return store.transactions.groupBy("category").agg(F.count("transaction_id").alias("identified"))


@store_query("count_rows_grouped", "A5", over_store(
    "SELECT category, status, COUNT(*) AS n FROM transactions GROUP BY 1, 2"))
def count_rows_grouped(store):
    return store.transactions.groupBy("category", "status").agg(F.count("*").alias("n"))


@store_query("count_rows", "A6 A12 K13", over_store("SELECT COUNT(*) AS row_count FROM transactions"))
def count_rows(store):
    return store.transactions.agg(F.count("*").alias("row_count"))


@store_query("average_rounded", "A7", over_store(
    "SELECT country_code, ROUND(AVG(amount), 2) AS avg_amount FROM transactions GROUP BY 1"))
def average_rounded(store):
    return store.transactions.groupBy("country_code").agg(
        exact.mean(F.col("amount")).alias("avg_amount"))


@store_query("first_and_last_date", "A8", over_store(
    "SELECT customer_id, MIN(CAST(txn_timestamp AS DATE)) AS first_date,"
    " MAX(CAST(txn_timestamp AS DATE)) AS last_date FROM transactions GROUP BY 1"))
def first_and_last_date(store):
    day = F.to_date("txn_timestamp")
    return store.transactions.groupBy("customer_id").agg(
        F.min(day).alias("first_date"), F.max(day).alias("last_date"))


@store_query("value_frequency", "A9", over_store(
    "SELECT product_id, COUNT(*) AS n FROM transactions GROUP BY 1"))
def value_frequency(store):
    return store.transactions.groupBy("product_id").agg(F.count("*").alias("n"))


@store_query("group_by_three_keys", "A10", over_store(
    "SELECT category, country_code, status, COUNT(*) AS n FROM transactions GROUP BY 1, 2, 3"))
def group_by_three_keys(store):
    return store.transactions.groupBy("category", "country_code", "status").agg(F.count("*").alias("n"))


@store_query("group_by_position", "A11 O2", over_store(
    "SELECT currency, status, COUNT(transaction_id) AS n FROM transactions GROUP BY 1, 2"))
def group_by_position(store):
    return store.spark.sql(
        "SELECT currency, status, COUNT(transaction_id) AS n FROM {transactions}"
        " GROUP BY 1, 2 ORDER BY 1, 2",
        transactions=store.transactions,
    )
