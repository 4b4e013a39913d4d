"""Sorts over whole tables, and the limits that are a report's feature.

A range sort sends equal keys to one task. Every sort here ends in distinguishing columns, so that
a key with much of the data is spread, and every limit has a total order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwright.functions import money as exact
from cartwright.operators import sampling
from cartwright.queries.base import query, seed_csv, store_query
from cartwright.queries.canonical import money, over_store
from cartwright.sources import readers, schemas

DETAIL = ["transaction_id", "product_id", "amount", "txn_timestamp"]


@store_query("sort_by_keys", "O1", over_store("SELECT * FROM transactions"))
def sort_by_keys(store):
    return store.transactions.orderBy("category", "country_code", *DETAIL)


@store_query("sort_by_positions", "O2 A11", over_store(
    "SELECT category, country_code, status, COUNT(*) AS n FROM transactions GROUP BY 1, 2, 3"))
def sort_by_positions(store):
    return store.spark.sql(
        "SELECT category, country_code, status, COUNT(*) AS n FROM {transactions}"
        " GROUP BY 1, 2, 3 ORDER BY 1, 2, 3",
        transactions=store.transactions,
    )


@store_query("sort_by_aggregate", "O3", over_store(
    f"SELECT product_id, {money()} AS revenue FROM transactions GROUP BY 1"))
def sort_by_aggregate(store):
    revenue = store.transactions.groupBy("product_id").agg(exact.total(F.col("amount")).alias("revenue"))
    return revenue.orderBy(F.desc("revenue"), "product_id")


@store_query("sort_nulls_last", "O4", over_store("SELECT transaction_id, amount FROM transactions"))
def sort_nulls_last(store):
    return store.transactions.select("transaction_id", "amount").orderBy(
        F.col("amount").desc_nulls_last(), "transaction_id")


@store_query("top_amounts", "O6 O4", over_store(
    "SELECT transaction_id, product_id, amount, txn_timestamp FROM transactions"
    " ORDER BY amount DESC NULLS LAST, transaction_id NULLS FIRST, product_id, txn_timestamp LIMIT 15"))
def top_amounts(store):
    return store.transactions.select(*DETAIL).orderBy(
        F.col("amount").desc_nulls_last(), "transaction_id", "product_id", "txn_timestamp").limit(15)


@store_query("sample_rows", "O7", over_store(
    "SELECT * FROM customers ORDER BY customer_id LIMIT 10"))
def sample_rows(store):
    return sampling.sample_batch(store.customers, 10)


@query("sort_lines", "O9 S6", over_store("SELECT category AS value FROM transactions"))
def sort_lines(spark, sf_dir):
    """One field of every line, sorted; the whole line breaks ties."""
    lines = readers.read_lines(spark, seed_csv(spark, sf_dir, "transactions"))
    line = F.col("value")
    data = lines.where(line != ",".join(schemas.TRANSACTIONS.names))
    fields = data.select(readers.field(line, 4).alias("category"), line.alias("line"))
    return fields.orderBy("category", "line").select(F.col("category").alias("value"))
