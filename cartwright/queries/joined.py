"""Left joins returning every enriched row."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwright.operators import joins, sinks
from cartwright.plans import marts, staging
from cartwright.queries.base import (
    prepared,
    query,
    store_query,
    stored_transactions,
    table_name,
    tables,
)
from cartwright.queries.canonical import over_store, rounded_money


@store_query("join_left_sort_merge", "J1", over_store(
    "SELECT t.transaction_id, t.product_id, t.amount, p.product_name, p.unit_price"
    " FROM transactions t LEFT JOIN products p ON t.product_id = p.product_id"))
def join_left_sort_merge(store):
    fact = store.transactions.select("transaction_id", "product_id", "amount")
    dimension = store.products.select("product_id", "product_name", "unit_price")
    return joins.left_join_sort_merge(fact, dimension, "product_id")


@store_query("join_left_broadcast", "J2", over_store(
    "SELECT t.transaction_id, t.product_id, t.amount, p.product_name"
    " FROM transactions t LEFT JOIN products p ON t.product_id = p.product_id"))
def join_left_broadcast(store):
    fact = store.transactions.select("transaction_id", "product_id", "amount")
    return joins.left_join(fact, store.products.select("product_id", "product_name"), "product_id")


@store_query("join_left_to_aggregate", "J3 X10", over_store(
    "SELECT c.customer_id, COALESCE(o.orders, 0) AS orders, COALESCE(o.value, 0.0) AS value"
    " FROM customers c LEFT JOIN o USING (customer_id)",
    o=f"SELECT customer_id, COUNT(transaction_id) AS orders, {rounded_money()} AS value"
      " FROM stg_transactions GROUP BY 1"))
def join_left_to_aggregate(store):
    orders = marts.customer_orders(staging.stg_transactions(store.transactions))
    return store.customers.join(orders, "customer_id", "left").select(
        "customer_id",
        F.coalesce("number_of_orders", F.lit(0)).alias("orders"),
        F.coalesce("lifetime_value", F.lit(0.0)).alias("value"),
    )


@store_query("join_shared_column_name", "J4 P6", over_store(
    "SELECT t.transaction_id, t.product_id, p.category"
    " FROM transactions t LEFT JOIN products p ON t.product_id = p.product_id"))
def join_shared_column_name(store):
    """Both sides have a category; the transaction's is dropped first."""
    fact = store.transactions.select("transaction_id", "product_id", "category").drop("category")
    return joins.left_join(fact, store.products.select("product_id", "category"), "product_id")


def _bucketed(spark, sf_dir, name, rows, key):
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.table(prepared(spark, sf_dir, name, lambda folder: sinks.write_bucketed(
        rows, table_name(spark, sf_dir, name), folder, buckets, key)))


@query("join_left_bucketed", "J1 K7", over_store(
    "SELECT t.transaction_id, t.product_id, t.amount, p.product_name, p.unit_price"
    " FROM transactions t LEFT JOIN products p ON t.product_id = p.product_id"))
def join_left_bucketed(spark, sf_dir):
    """Both sides stored by hash of the product: the join reads them bucket by bucket, without a shuffle."""
    fact = stored_transactions(spark, sf_dir).select("transaction_id", "product_id", "amount")
    dimension = tables(spark, sf_dir).products.select("product_id", "product_name", "unit_price")
    return joins.left_join_sort_merge(
        _bucketed(spark, sf_dir, "bucketed_sales", fact, "product_id"),
        _bucketed(spark, sf_dir, "bucketed_products", dimension, "product_id"), "product_id")


@query("join_bucketed_to_aggregate", "J3 A8 K7", over_store(
    "SELECT c.customer_id, COALESCE(o.orders, 0) AS orders, COALESCE(o.value, 0.0) AS value"
    " FROM customers c LEFT JOIN o USING (customer_id)",
    o=f"SELECT customer_id, COUNT(transaction_id) AS orders, {rounded_money()} AS value"
      " FROM stg_transactions GROUP BY 1"))
def join_bucketed_to_aggregate(spark, sf_dir):
    """Sales and customers stored by hash of the customer: neither the sums nor the join shuffle."""
    sales = staging.stg_transactions(stored_transactions(spark, sf_dir)).select(
        "customer_id", "transaction_id", "amount", "txn_date")
    orders = marts.customer_orders(_bucketed(spark, sf_dir, "bucketed_orders", sales, "customer_id"))
    people = _bucketed(spark, sf_dir, "bucketed_customers", tables(spark, sf_dir).customers.select("customer_id"), "customer_id")
    return joins.left_join_sort_merge(people, orders, "customer_id").select(
        "customer_id",
        F.coalesce("number_of_orders", F.lit(0)).alias("orders"),
        F.coalesce("lifetime_value", F.lit(0.0)).alias("value"),
    )


@query("join_left_salted", "J1 J4", over_store(
    "SELECT t.transaction_id, t.product_id, t.amount, p.product_name"
    " FROM (SELECT transaction_id, amount, CASE WHEN customer_id % 3 = 0 THEN 1 WHEN product_id > 0 THEN product_id END"
    " AS product_id FROM transactions) t LEFT JOIN products p ON t.product_id = p.product_id"))
def join_left_salted(spark, sf_dir):
    """A third of the sales are of one product, and some of none."""
    hot = F.when(F.col("customer_id") % 3 == 0, 1).when(F.col("product_id") > 0, F.col("product_id"))
    fact = stored_transactions(spark, sf_dir).select("transaction_id", "amount", hot.alias("product_id"))
    dimension = tables(spark, sf_dir).products.select("product_id", "product_name")
    return joins.left_join_salted(fact, dimension, "product_id", salts=32)
