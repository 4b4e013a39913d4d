"""Data-quality rules over whole models."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwright.operators import key_index, quality, sampling
from cartwright.plans import exploration, history, staging
from cartwright.queries.base import (
    history_table,
    prepared,
    query,
    seed_csv,
    store_query,
    stored_transactions,
    table_name,
    transactions_parquet,
)
from cartwright.queries.canonical import money, over_store
from cartwright.queries.reports import CATEGORY, COUNTRY
from cartwright.queries.versions import BATCHES
from cartwright.sources import readers, schemas

# The test tables' own code lists: every region but one, every nation.
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE"]
NATIONS = [f"NATION_{i}" for i in range(25)]


def _listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _duplicates(table: str, column: str) -> str:
    return over_store(
        f"SELECT CAST({column} AS VARCHAR) AS value, COUNT(*) AS copies FROM {table}"
        f" WHERE {column} IS NOT NULL GROUP BY 1 HAVING COUNT(*) > 1")


@store_query("unique_transaction_id", "D1", _duplicates("stg_transactions", "transaction_id"))
def unique_transaction_id(store):
    return quality.unique_violations(staging.stg_transactions(store.transactions), "transaction_id")


@store_query("unique_raw_transaction_id", "D1", _duplicates("transactions", "transaction_id"))
def unique_raw_transaction_id(store):
    return quality.unique_violations(store.transactions, "transaction_id")


@store_query("unique_customer_id", "D1", _duplicates("stg_customers", "customer_id"))
def unique_customer_id(store):
    return quality.unique_violations(staging.stg_customers(store.customers), "customer_id")


@store_query("unique_email", "D1", _duplicates("stg_customers", "email"))
def unique_email(store):
    return quality.unique_violations(staging.stg_customers(store.customers), "email")


@store_query("not_null_transaction_id", "D2", over_store(
    "SELECT * FROM stg_transactions WHERE transaction_id IS NULL"))
def not_null_transaction_id(store):
    return quality.not_null_violations(staging.stg_transactions(store.transactions), "transaction_id")


@store_query("not_null_customer_id", "D2", over_store("SELECT * FROM stg_customers WHERE customer_id IS NULL"))
def not_null_customer_id(store):
    return quality.not_null_violations(staging.stg_customers(store.customers), "customer_id")


@store_query("not_null_email", "D2", over_store("SELECT * FROM stg_customers WHERE email IS NULL"))
def not_null_email(store):
    return quality.not_null_violations(staging.stg_customers(store.customers), "email")


@store_query("accepted_currency", "D3 F10", over_store(
    f"SELECT currency AS value, COUNT(*) AS copies FROM stg_transactions"
    f" WHERE currency NOT IN ({_listed(REGIONS)}) GROUP BY 1"))
def accepted_currency(store):
    return quality.accepted_values_violations(
        staging.stg_transactions(store.transactions), "currency", REGIONS)


@store_query("accepted_country_code", "D3 F10", over_store(
    f"SELECT country_code AS value, COUNT(*) AS copies FROM stg_transactions"
    f" WHERE country_code NOT IN ({_listed(NATIONS)}) GROUP BY 1"))
def accepted_country_code(store):
    return quality.accepted_values_violations(
        staging.stg_transactions(store.transactions), "country_code", NATIONS)


def _report_row(model: str, column: str, rule: str, violations: str) -> str:
    return (
        f"SELECT '{model}' AS model, '{column}' AS column_name, '{rule}' AS rule,"
        f" COUNT(*) AS failures, COUNT(*) = 0 AS passed FROM ({violations})"
    )


def _unique_row(model: str, column: str) -> str:
    return _report_row(model, column, "unique", (
        f"SELECT {column} FROM {model} WHERE {column} IS NOT NULL"
        f" GROUP BY {column} HAVING COUNT(*) > 1"))


def _not_null_row(model: str, column: str) -> str:
    return _report_row(model, column, "not_null", f"SELECT 1 FROM {model} WHERE {column} IS NULL")


def _accepted_row(model: str, column: str, values) -> str:
    return _report_row(model, column, "accepted_values", (
        f"SELECT DISTINCT {column} FROM {model} WHERE {column} NOT IN ({_listed(values)})"))


@store_query("quality_report", "D1 D2 D3 F10", over_store(" UNION ALL ".join([
    _unique_row("stg_transactions", "transaction_id"),
    _not_null_row("stg_transactions", "transaction_id"),
    _accepted_row("stg_transactions", "currency", REGIONS),
    _accepted_row("stg_transactions", "country_code", NATIONS),
    _unique_row("stg_customers", "customer_id"),
    _not_null_row("stg_customers", "customer_id"),
    _unique_row("stg_customers", "email"),
    _not_null_row("stg_customers", "email"),
])))
def quality_report(store):
    models = {
        "stg_transactions": staging.stg_transactions(store.transactions),
        "stg_customers": staging.stg_customers(store.customers),
    }
    return quality.report(models, staging.staging_rules(REGIONS, NATIONS))


@query("formats_agree", "D4 X18", over_store(
    "SELECT revenue AS left_value, revenue AS right_value, TRUE AS agrees FROM total",
    total=f"SELECT {money()} AS revenue FROM transactions"
          f" WHERE category = '{CATEGORY}' AND country_code = '{COUNTRY}'"))
def formats_agree(spark, sf_dir):
    path = seed_csv(spark, sf_dir, "transactions")
    text = readers.read_csv(spark, path, schemas.TRANSACTIONS)
    columns = ["category", "country_code", "amount"]
    columnar = readers.read_parquet(spark, transactions_parquet(spark, sf_dir), columns)
    return quality.agreement(
        exploration.filtered_revenue(text, CATEGORY, COUNTRY),
        exploration.filtered_revenue(columnar, CATEGORY, COUNTRY),
        "revenue",
    )


@query("batch_present", "D6", over_store("SELECT * FROM transactions WHERE month(txn_timestamp) = 4"))
def batch_present(spark, sf_dir):
    transactions = stored_transactions(spark, sf_dir)
    return sampling.batch_or_fallback(transactions, F.month("txn_timestamp") == 4)


@query("batch_fallback", "D6", over_store("SELECT * FROM transactions"))
def batch_fallback(spark, sf_dir):
    """No such month, so the whole input takes the batch's place."""
    transactions = stored_transactions(spark, sf_dir)
    return sampling.batch_or_fallback(transactions, F.month("txn_timestamp") == 13)


@query("input_row_counts", "D7 A12", """
SELECT 'lineitem' AS table_name, COUNT(*) AS row_count FROM lineitem
UNION ALL SELECT 'orders', COUNT(*) FROM orders
UNION ALL SELECT 'customer', COUNT(*) FROM customer
UNION ALL SELECT 'part', COUNT(*) FROM part""")
def input_row_counts(spark, sf_dir):
    names = ["lineitem", "orders", "customer", "part"]
    counts = [
        readers.read_parquet(spark, f"{sf_dir}/{name}.parquet")
        .agg(F.count("*").alias("row_count"))
        .select(F.lit(name).alias("table_name"), "row_count")
        for name in names
    ]
    first, *others = counts
    for other in others:
        first = first.unionAll(other)
    return first


#: Five order priorities in each of 25 nations.
GROUPS = 5 * 25


@store_query("expected_groups", "D8", over_store(
    f"SELECT COUNT(*) AS found_groups, CAST({GROUPS} AS BIGINT) AS expected_groups, COUNT(*) = {GROUPS} AS complete"
    " FROM (SELECT DISTINCT category, country_code FROM transactions"
    " WHERE status = 'completed' AND amount IS NOT NULL)"))
def expected_groups(store):
    kept = store.transactions.where((F.col("status") == "completed") & F.col("amount").isNotNull())
    return quality.expected_groups(kept, ["category", "country_code"], GROUPS)


@store_query("completed_share", "D8", over_store(
    "SELECT COUNT(*) AS transactions, COUNT(*) FILTER (status = 'completed') AS completed,"
    " COUNT(*) FILTER (status = 'completed') / COUNT(*) AS share FROM transactions"))
def completed_share(store):
    done = F.count_if(F.col("status") == "completed")
    return store.transactions.agg(
        F.count("*").alias("transactions"), done.alias("completed"), (done / F.count("*")).alias("share"))


@store_query("duplicated_rows", "D9", over_store(
    "SELECT *, COUNT(*) AS copies FROM transactions GROUP BY ALL HAVING COUNT(*) > 1"))
def duplicated_rows(store):
    return quality.duplicated_rows(store.transactions)


REPEATED = "SELECT * FROM m4 UNION ALL SELECT * FROM m3 WHERE customer_id % 50 = 0"


@query("unique_in_new_batch", "D1 D9", over_store(
    "SELECT n.value, n.copies, COALESCE(e.copies, 0) AS earlier_copies FROM n LEFT JOIN e USING (value)"
    " WHERE n.copies > 1 OR e.copies > 0",
    **BATCHES, loaded=REPEATED,
    n="SELECT transaction_id AS value, COUNT(*) AS copies FROM loaded WHERE transaction_id IS NOT NULL GROUP BY 1",
    e="SELECT transaction_id AS value, CAST(COUNT(*) AS BIGINT) AS copies FROM"
      " (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3) GROUP BY 1"))
def unique_in_new_batch(spark, sf_dir):
    """April's batch, with some of March's sales again, against an index of the ids of earlier batches."""
    source = history_table(spark, sf_dir)

    def build(folder):
        name = key_index.create_index(spark, table_name(spark, sf_dir, "sale_ids"), folder, "transaction_id")
        for number in (1, 2, 3):
            key_index.add_batch(spark, name, history.in_batch(source, number), number)
        return name

    again = history.in_batch(source, 3).where(F.col("customer_id") % 50 == 0)
    batch = history.in_batch(source, 4).unionByName(again)
    return key_index.violations(spark, prepared(spark, sf_dir, "sale_ids", build), batch, 4)
