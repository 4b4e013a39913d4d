"""The jobs' own results: exploration, summaries, staging, marts, storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwright.functions import money as money_functions
from cartwright.operators import joins, sinks
from cartwright.plans import exploration, marts, staging, storage, summaries
from cartwright.queries.base import (
    TRANSACTIONS_PARTS,
    prepared,
    query,
    seed_csv,
    source_id,
    store_query,
    stored_transactions,
    tables,
)
from cartwright.queries.canonical import money, over_store, rounded_money
from cartwright.sources import readers, schemas
from cartwright.sources.store import table as store_table

CATEGORY, COUNTRY = "1-URGENT", "nation_3 "
TRANSACTIONS_HEADER = ",".join(schemas.TRANSACTIONS.names)

FILTERED_REVENUE = over_store(
    f"SELECT {money()} AS revenue FROM transactions"
    f" WHERE category = '{CATEGORY}' AND country_code = '{COUNTRY}'"
)
CATEGORY_COUNTRY_SUMMARY = over_store(
    f"SELECT category, country_code, {rounded_money()} AS total_revenue,"
    " COUNT(transaction_id) AS order_count FROM transactions"
    " WHERE status = 'completed' AND amount IS NOT NULL GROUP BY 1, 2"
)
DAILY_BY_PRODUCT_CATEGORY = over_store(
    f"SELECT CAST(t.txn_timestamp AS DATE) AS sale_date, p.category, {money()} AS total_revenue,"
    " COUNT(t.transaction_id) AS tx_count"
    " FROM transactions t LEFT JOIN products p ON t.product_id = p.product_id"
    " WHERE t.transaction_id IS NOT NULL AND t.amount > 0 GROUP BY 1, 2"
)
DAILY_BY_FACT_CATEGORY_ROWS = (
    f"SELECT CAST(t.txn_timestamp AS DATE) AS sale_date, t.category, {money()} AS total_revenue,"
    " COUNT(t.transaction_id) AS tx_count"
    " FROM transactions t LEFT JOIN products p ON t.product_id = p.product_id"
    " WHERE t.transaction_id IS NOT NULL AND t.amount > 0 GROUP BY 1, 2"
)
DAILY_BY_FACT_CATEGORY = over_store(DAILY_BY_FACT_CATEGORY_ROWS)
FCT_DAILY_REVENUE = over_store(
    "SELECT txn_date AS sale_date, category, country_code, COUNT(transaction_id) AS order_count,"
    f" {rounded_money()} AS gross_revenue FROM stg_transactions GROUP BY 1, 2, 3"
)
DIM_CUSTOMERS = over_store(
    "SELECT c.*, o.first_order_date, o.most_recent_order_date,"
    " COALESCE(o.number_of_orders, 0) AS number_of_orders,"
    " COALESCE(o.lifetime_value, 0.0) AS lifetime_value"
    " FROM stg_customers c LEFT JOIN customer_orders o USING (customer_id)",
    customer_orders=(
        "SELECT customer_id, MIN(txn_date) AS first_order_date, MAX(txn_date) AS"
        " most_recent_order_date, COUNT(transaction_id) AS number_of_orders,"
        f" {rounded_money()} AS lifetime_value FROM stg_transactions GROUP BY 1"
    ),
)


@query("line_count", "Q22 S6", over_store(
    f"SELECT COUNT(*) + {TRANSACTIONS_PARTS} AS lines, CAST({TRANSACTIONS_PARTS} AS BIGINT) AS header_lines,"
    " COUNT(*) AS data_lines FROM transactions"))
def line_count(spark, sf_dir):
    """Over a CSV of a known number of parts, each with its header."""
    def build(folder):
        rows = tables(spark, sf_dir).seed_tables["transactions"]
        return sinks.write_csv_in_parts(rows, folder, TRANSACTIONS_PARTS)

    lines = readers.read_lines(spark, prepared(spark, sf_dir, "transactions_in_parts", build))
    return exploration.line_count(lines, TRANSACTIONS_HEADER)


@query("line_head", "Q22 O8", """
SELECT 'product_id,product_name,category,brand,unit_price' AS value
UNION ALL
SELECT value FROM (
    SELECT CAST(p_partkey AS VARCHAR) || ',' || p_name || ',' || p_type || ',' || p_brand || ','
           || CAST(p_retailprice AS VARCHAR) AS value
    FROM part ORDER BY p_partkey LIMIT 4)""")
def line_head(spark, sf_dir):
    return exploration.head(spark, seed_csv(spark, sf_dir, "products"))


@query("category_frequency", "Q1 S6 P10 A9 O9", over_store(
    "SELECT category, COUNT(*) AS transactions FROM transactions GROUP BY 1 ORDER BY 1"))
def category_frequency(spark, sf_dir):
    lines = readers.read_lines(spark, seed_csv(spark, sf_dir, "transactions"))
    return exploration.category_frequency(lines, TRANSACTIONS_HEADER)


@store_query("category_avg_amount", "Q2 A7 O3", over_store(
    "SELECT category, ROUND(AVG(amount), 2) AS avg_amount FROM transactions GROUP BY 1"))
def category_avg_amount(store):
    return exploration.category_avg_amount(store.transactions)


@store_query("filtered_revenue", "Q3 F2 A1", FILTERED_REVENUE)
def filtered_revenue(store):
    return exploration.filtered_revenue(store.transactions, CATEGORY, COUNTRY)


@query("filtered_revenue_csv", "Q3 S4 F2 A1", FILTERED_REVENUE)
def filtered_revenue_csv(spark, sf_dir):
    path = seed_csv(spark, sf_dir, "transactions")
    stored = readers.read_csv(spark, path, schemas.TRANSACTIONS)
    return exploration.filtered_revenue(stored, CATEGORY, COUNTRY)


@store_query("category_country_summary", "Q4 F1 F3 A3 A4 O1", CATEGORY_COUNTRY_SUMMARY)
def category_country_summary(store):
    return summaries.category_country_summary(store.transactions)


@query("category_country_summary_written", "Q4 K5", CATEGORY_COUNTRY_SUMMARY)
def category_country_summary_written(spark, sf_dir):
    def build(folder):
        summary = summaries.category_country_summary(tables(spark, sf_dir).transactions)
        return sinks.write_parquet(summary, folder)

    return spark.read.parquet(prepared(spark, sf_dir, "category_country_summary", build))


@store_query("daily_summary_by_product_category", "Q5 X1 P6 A2 A4", DAILY_BY_PRODUCT_CATEGORY)
def daily_summary_by_product_category(store):
    return summaries.daily_summary_by_product_category(store.transactions, store.products)


@store_query("daily_summary_by_product_category_sort_merge", "Q5 J1", DAILY_BY_PRODUCT_CATEGORY)
def daily_summary_by_product_category_sort_merge(store):
    return summaries.daily_summary_by_product_category(
        store.transactions, store.products, joins.left_join_sort_merge)


@store_query("daily_summary_by_fact_category", "Q6 A2 A4 O1", DAILY_BY_FACT_CATEGORY)
def daily_summary_by_fact_category(store):
    return summaries.daily_summary_by_fact_category(store.transactions)


@store_query("daily_summary_by_fact_category_sort_merge", "Q6 J1", DAILY_BY_FACT_CATEGORY)
def daily_summary_by_fact_category_sort_merge(store):
    return summaries.daily_summary_by_fact_category_joined(store.transactions, store.products)


@query("daily_summary_partitioned", "Q6 K6", DAILY_BY_FACT_CATEGORY)
def daily_summary_partitioned(spark, sf_dir):
    def build(folder):
        summary = summaries.daily_summary_by_fact_category(tables(spark, sf_dir).transactions)
        return summaries.write_daily_summary(summary, folder)

    return spark.read.parquet(prepared(spark, sf_dir, "daily_summary", build))


def daily_by_month(spark, sf_dir):
    def build(folder):
        summary = summaries.daily_summary_by_fact_category(tables(spark, sf_dir).transactions)
        return summaries.write_daily_summary_by_month(summary, folder)

    return spark.read.parquet(prepared(spark, sf_dir, "daily_by_month", build))


@query("daily_summary_by_month", "Q6 K6", DAILY_BY_FACT_CATEGORY)
def daily_summary_by_month(spark, sf_dir):
    """Stored by month, the days in order inside."""
    return daily_by_month(spark, sf_dir).drop("sale_month")


@query("daily_summary_of_chosen_days", "Q6 K6 F10", over_store(
    "SELECT * FROM daily WHERE sale_date IN (SELECT CAST(o_orderdate AS DATE) FROM orders"
    " WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01')",
    daily=DAILY_BY_FACT_CATEGORY_ROWS))
def daily_summary_of_chosen_days(spark, sf_dir):
    """The days of urgent orders of one year: which months are read is found at run time."""
    day = F.col("o_orderdate")
    urgent = (F.col("o_orderpriority") == "1-URGENT") & (day >= F.lit("1997-01-01").cast("timestamp_ntz")) & (
        day < F.lit("1998-01-01").cast("timestamp_ntz"))
    days = store_table(spark, sf_dir, "orders").where(urgent).select(F.to_date(day).alias("sale_date"))
    return summaries.summary_of_days(daily_by_month(spark, sf_dir), days)


DISCOUNTED_REVENUE = """
SELECT l_returnflag, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))))
                          AS DOUBLE) AS revenue
FROM lineitem GROUP BY 1"""


@query("discounted_revenue", "A2 A3", DISCOUNTED_REVENUE)
def discounted_revenue(spark, sf_dir):
    """Amounts of four decimals, summed without rounding each."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    lines = store_table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_returnflag").agg(money_functions.total(price).alias("revenue"))


@store_query("stg_transactions", "Q14 S10 F1 F4 X1 X6 X8", over_store("SELECT * FROM stg_transactions"))
def stg_transactions(store):
    return staging.stg_transactions(store.transactions)


@store_query("stg_customers", "Q15 S10 F6 X1 X6 X7 X8 X9", over_store("SELECT * FROM stg_customers"))
def stg_customers(store):
    return staging.stg_customers(store.customers)


@store_query("fct_daily_revenue", "Q16 S11 A3 A4 A10 A11 O2", FCT_DAILY_REVENUE)
def fct_daily_revenue(store):
    return marts.fct_daily_revenue(staging.stg_transactions(store.transactions))


@store_query("dim_customers", "Q17 S11 J3 A3 A4 A8 X10", DIM_CUSTOMERS)
def dim_customers(store):
    return marts.dim_customers(
        staging.stg_customers(store.customers), staging.stg_transactions(store.transactions))


def written_formats(spark, sf_dir):
    def build(folder):
        # From a stored copy, so that the timings are of the writes and not of the store's joins.
        stored = stored_transactions(spark, sf_dir).withColumnRenamed("txn_timestamp", "timestamp")
        return folder, storage.write_formats_counted(stored, folder)

    return prepared(spark, sf_dir, "formats", build)


@query("storage_format_rows", "Q18 K1 K3 K4 X18", over_store("""
SELECT 'csv' AS format, COUNT(*) AS row_count FROM transactions
UNION ALL SELECT 'parquet_zstd', COUNT(*) FROM transactions
UNION ALL SELECT 'parquet_snappy', COUNT(*) FROM transactions"""))
def storage_format_rows(spark, sf_dir):
    folder, _ = written_formats(spark, sf_dir)
    return storage.format_row_counts(spark, folder, schemas.TRANSACTIONS)


@query("storage_format_counts", "Q18 K13", over_store("""
SELECT 'csv' AS format, COUNT(*) AS row_count, CAST(NULL AS BOOLEAN) AS smaller_than_csv FROM transactions
UNION ALL SELECT 'parquet_zstd', COUNT(*), TRUE FROM transactions
UNION ALL SELECT 'parquet_snappy', COUNT(*), TRUE FROM transactions"""))
def storage_format_counts(spark, sf_dir):
    """The format report: rows as the writes counted them, and whether a format takes less room than CSV."""
    folder, runs = written_formats(spark, sf_dir)
    report = storage.counted_format_report(spark, folder, runs)
    return report.select("format", "row_count", (F.col("size_reduction_pct") > 0).alias("smaller_than_csv"))


@query("convert_csv_to_columnar", "Q19 S4 K2 A12", over_store("""
SELECT 'transactions' AS table_name, COUNT(*) AS row_count FROM transactions
UNION ALL SELECT 'customers', COUNT(*) FROM customers
UNION ALL SELECT 'products', COUNT(*) FROM products"""))
def convert_csv_to_columnar(spark, sf_dir):
    return prepared(spark, sf_dir, "converted", lambda folder: storage.convert_csv_to_columnar(
        spark, {name: seed_csv(spark, sf_dir, name) for name in schemas.SEED_TABLES}, folder))


def raw_tables(spark, sf_dir):
    def build(folder):
        store = tables(spark, sf_dir)
        raw = {"transactions": store.transactions, "customers": store.customers}
        return storage.load_raw_tables(raw, folder, suffix=f"_{source_id(sf_dir)}")

    return prepared(spark, sf_dir, "raw_tables", build)


@query("load_raw_tables", "Q21 S3 K7 A6", over_store("""
SELECT 'transactions' AS table_name, COUNT(*) AS row_count FROM transactions
UNION ALL SELECT 'customers', COUNT(*) FROM customers"""))
def load_raw_tables(spark, sf_dir):
    return storage.table_counts(spark, raw_tables(spark, sf_dir))


@query("load_raw_tables_counted", "Q21 K7 K13", over_store("""
SELECT 'transactions' AS table_name, COUNT(*) AS row_count FROM transactions
UNION ALL SELECT 'customers', COUNT(*) FROM customers"""))
def load_raw_tables_counted(spark, sf_dir):
    """The same from what the loads counted; the tables are not read."""
    def build(folder):
        store = tables(spark, sf_dir)
        raw = {"transactions": store.transactions, "customers": store.customers}
        return storage.load_raw_tables_counted(raw, folder, suffix=f"_counted_{source_id(sf_dir)}")[1]

    counts = prepared(spark, sf_dir, "raw_tables_counted", build)
    return sinks.named_values(spark, counts, "table_name", "row_count")
