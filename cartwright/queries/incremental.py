"""Summaries from partial sums by batch, after three loads and one replaced batch."""

from __future__ import annotations

from cartwright.plans import history, incremental
from cartwright.queries.base import history_table, prepared, query, table_name
from cartwright.queries.canonical import STG_TRANSACTIONS, money, over_store, rounded_money
from cartwright.queries.versions import BATCHES

#: January, what was February and is April since, March.
HELD = "SELECT * FROM m1 UNION ALL SELECT * FROM m4 UNION ALL SELECT * FROM m3"
STAGED = STG_TRANSACTIONS.replace("FROM transactions", "FROM held")


def over_batches(select: str, held: str = HELD) -> str:
    return over_store(select, **BATCHES, held=held, staged=STAGED)


def partials(spark, sf_dir, name: str, summary: incremental.Summary):
    """The partials after batches 1 to 3 and a second load of batch 2."""
    def build(folder):
        source, table = history_table(spark, sf_dir), table_name(spark, sf_dir, name)
        for number, loaded in ((1, 1), (2, 2), (3, 3), (2, 4)):
            incremental.load_partials(spark, summary, table, folder, history.in_batch(source, loaded), number)
        return table

    return spark.table(prepared(spark, sf_dir, name, build))


@query("incremental_category_country", "Q4 K9", over_batches(
    f"SELECT category, country_code, {rounded_money()} AS total_revenue, COUNT(transaction_id) AS order_count"
    " FROM held WHERE status = 'completed' AND amount IS NOT NULL GROUP BY 1, 2"))
def incremental_category_country(spark, sf_dir):
    summary = incremental.CATEGORY_COUNTRY
    return incremental.merged(summary, partials(spark, sf_dir, "partials_category_country", summary))


def _daily(held: str) -> str:
    return over_batches(
        f"SELECT CAST(txn_timestamp AS DATE) AS sale_date, category, {money()} AS total_revenue, COUNT(*) AS tx_count"
        " FROM held WHERE transaction_id IS NOT NULL AND amount > 0 GROUP BY 1, 2", held)


@query("incremental_daily_summary", "Q6 K9", _daily(HELD))
def incremental_daily_summary(spark, sf_dir):
    summary = incremental.DAILY
    return incremental.merged(summary, partials(spark, sf_dir, "partials_daily", summary))


@query("incremental_daily_summary_as_of", "Q6 K9 S8", _daily("SELECT * FROM m1 UNION ALL SELECT * FROM m4"))
def incremental_daily_summary_as_of(spark, sf_dir):
    """The summary as of the second batch: later partials are not read."""
    summary = incremental.DAILY
    return incremental.merged(summary, partials(spark, sf_dir, "partials_daily", summary), through=2)


@query("incremental_daily_revenue", "Q16 K9", over_batches(
    "SELECT txn_date AS sale_date, category, country_code, COUNT(transaction_id) AS order_count,"
    f" {rounded_money()} AS gross_revenue FROM staged GROUP BY 1, 2, 3"))
def incremental_daily_revenue(spark, sf_dir):
    summary = incremental.DAILY_REVENUE
    return incremental.merged(summary, partials(spark, sf_dir, "partials_daily_revenue", summary))


@query("incremental_customer_orders", "Q17 K9 A8", over_batches(
    "SELECT customer_id, MIN(txn_date) AS first_order_date, MAX(txn_date) AS most_recent_order_date,"
    f" COUNT(transaction_id) AS number_of_orders, {rounded_money()} AS lifetime_value FROM staged GROUP BY 1"))
def incremental_customer_orders(spark, sf_dir):
    summary = incremental.CUSTOMER_ORDERS
    return incremental.merged(summary, partials(spark, sf_dir, "partials_customers", summary))
