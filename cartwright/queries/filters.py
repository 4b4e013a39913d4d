"""Predicates over the whole transactions or customers table."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwright.functions import calendar, cleaning, draws
from cartwright.operators import sampling
from cartwright.queries.base import store_query
from cartwright.queries.canonical import over_store
from cartwright.queries.generated import below_sql, draw_sql


def kept(predicate: str, table: str = "transactions") -> str:
    return over_store(f"SELECT * FROM {table} WHERE {predicate}")


@store_query("filter_equals", "F1", kept("status = 'completed'"))
def filter_equals(store):
    return store.transactions.where(F.col("status") == "completed")


@store_query("filter_two_equalities", "F2 P9", over_store(
    "SELECT amount FROM transactions WHERE category = '5-LOW' AND country_code = 'nation_7 '"))
def filter_two_equalities(store):
    chosen = (F.col("category") == "5-LOW") & (F.col("country_code") == "nation_7 ")
    return store.transactions.where(chosen).select("amount")


@store_query("filter_is_not_null", "F3", kept("transaction_id IS NOT NULL"))
def filter_is_not_null(store):
    return store.transactions.where(F.col("transaction_id").isNotNull())


@store_query("filter_positive", "F4", kept("amount > 0"))
def filter_positive(store):
    return store.transactions.where(F.col("amount") > 0)


@store_query("filter_month_of_year", "F5 X3", kept("month(txn_timestamp) = 2"))
def filter_month_of_year(store):
    return store.transactions.where(calendar.in_month(F.col("txn_timestamp"), 2))


@store_query("filter_month_and_year", "F5 X3", kept("month(txn_timestamp) = 2 AND year(txn_timestamp) = 1997"))
def filter_month_and_year(store):
    return store.transactions.where(calendar.in_month(F.col("txn_timestamp"), 2, 1997))


@store_query("filter_soft_deleted", "F6 X8 X9", kept("trim(CAST(is_deleted AS VARCHAR)) = 'false'", "customers"))
def filter_soft_deleted(store):
    return store.customers.where(cleaning.is_active(F.col("is_deleted")))


@store_query("filter_soft_deleted_text", "F6", kept("is_deleted = false", "customers"))
def filter_soft_deleted_text(store):
    """The flag stored as padded text keeps the same customers."""
    as_text = F.concat(F.lit(" "), F.col("is_deleted").cast("string"), F.lit(" "))
    kept_rows = store.customers.withColumn("flag", as_text).where(cleaning.is_active(F.col("flag")))
    return kept_rows.drop("flag")


@store_query("filter_chained", "F7", kept("status = 'completed' AND amount IS NOT NULL AND amount > 0"))
def filter_chained(store):
    return (
        store.transactions.where(F.col("status") == "completed")
        .where(F.col("amount").isNotNull())
        .where(F.col("amount") > 0)
    )


@store_query("filter_is_null_label", "F8 X12", over_store(
    "SELECT transaction_id, amount, CASE WHEN amount IS NULL THEN 'unpriced' ELSE 'priced' END AS label"
    " FROM transactions"))
def filter_is_null_label(store):
    label = F.when(F.col("amount").isNull(), "unpriced").otherwise("priced")
    return store.transactions.select("transaction_id", "amount", label.alias("label"))


@store_query("filter_random_share", "F9 X16", kept(
    below_sql(draw_sql("share", "customer_id", 0), 0.2), "customers"))
def filter_random_share(store):
    """About a fifth of the customers, the same ones on every run."""
    drawn = draws.draw("share", F.col("customer_id"))
    return store.customers.where(draws.below(drawn, 0.2))


@store_query("filter_not_in_list", "F10", kept("upper(trim(currency)) NOT IN ('AFRICA', 'ASIA')"))
def filter_not_in_list(store):
    return store.transactions.where(~cleaning.code(F.col("currency")).isin("AFRICA", "ASIA"))


@store_query("sample_per_category", "F9 O7", over_store(
    "SELECT transaction_id, customer_id, product_id, category, amount FROM transactions QUALIFY row_number() OVER ("
    f"PARTITION BY category ORDER BY {draw_sql('per category', 'customer_id * 1000003 + product_id', 0)},"
    " transaction_id NULLS FIRST, customer_id, product_id, amount NULLS FIRST) <= 100"))
def sample_per_category(store):
    """A hundred sales of every category, the same ones on every run."""
    rows = store.transactions.select("transaction_id", "customer_id", "product_id", "category", "amount")
    drawn = draws.draw("per category", F.col("customer_id") * 1000003 + F.col("product_id"))
    return sampling.sample_per_group(rows, "category", 100, drawn)
