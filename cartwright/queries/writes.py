"""Sinks: each writes a whole table and returns what is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwright.functions import calendar
from cartwright.operators import layout, sinks
from cartwright.plans import marts, staging
from cartwright.queries.base import (
    prepared,
    query,
    source_id,
    stored_transactions,
    tables,
    transactions_parquet,
)
from cartwright.queries.canonical import over_store
from cartwright.queries.reports import DIM_CUSTOMERS
from cartwright.sources import readers, schemas

CUSTOMERS = over_store("SELECT * REPLACE (CAST(signup_date AS DATE) AS signup_date) FROM customers")
TRANSACTIONS = over_store("SELECT * FROM transactions")


@query("write_csv", "K1 S4", CUSTOMERS)
def write_csv(spark, sf_dir):
    path = prepared(spark, sf_dir, "written_csv", lambda folder: sinks.write_csv(
        tables(spark, sf_dir).customers, folder))
    return readers.read_csv(spark, path, schemas.CUSTOMERS)


def _written(spark, sf_dir, name, codec):
    path = prepared(spark, sf_dir, name, lambda folder: sinks.write_parquet(
        tables(spark, sf_dir).transactions, folder, codec))
    return spark.read.parquet(path)


@query("write_parquet_default", "K2", TRANSACTIONS)
def write_parquet_default(spark, sf_dir):
    return _written(spark, sf_dir, "written_default", None)


@query("write_parquet_zstd", "K3", TRANSACTIONS)
def write_parquet_zstd(spark, sf_dir):
    return spark.read.parquet(transactions_parquet(spark, sf_dir))


@query("write_parquet_snappy", "K4", TRANSACTIONS)
def write_parquet_snappy(spark, sf_dir):
    return _written(spark, sf_dir, "written_snappy", "snappy")


@query("write_overwrite", "K5", over_store("SELECT * FROM products"))
def write_overwrite(spark, sf_dir):
    """The second write replaces the first."""
    def build(folder):
        sinks.write_parquet(tables(spark, sf_dir).customers, folder)
        return sinks.write_parquet(tables(spark, sf_dir).products, folder)

    return spark.read.parquet(prepared(spark, sf_dir, "overwritten", build))


@query("write_partitioned_by_month", "K6 K8 X4", over_store(
    "SELECT *, CAST(date_trunc('month', txn_timestamp) AS DATE) AS txn_month FROM transactions"))
def write_partitioned_by_month(spark, sf_dir):
    def build(folder):
        month = calendar.month_start(F.col("txn_timestamp")).alias("txn_month")
        dated = tables(spark, sf_dir).transactions.select("*", month)
        return sinks.write_partitioned(dated, folder, "txn_month", codec="zstd")

    return spark.read.parquet(prepared(spark, sf_dir, "by_month", build))


@query("create_table_as_select", "K7", over_store("SELECT * FROM products"))
def create_table_as_select(spark, sf_dir):
    """Dropping and recreating a table leaves the rows of the last load."""
    def build(folder):
        name = f"raw_products_{source_id(sf_dir)}"
        sinks.create_table_as(tables(spark, sf_dir).customers, name, f"{folder}/first")
        return sinks.create_table_as(tables(spark, sf_dir).products, name, f"{folder}/second")

    return spark.table(prepared(spark, sf_dir, "recreated", build))


@query("create_table_ddl", "K8", over_store("SELECT * FROM products"))
def create_table_ddl(spark, sf_dir):
    """Declared columns, created only if absent, then filled by an insert that replaces the rows."""
    def build(folder):
        name = f"declared_products_{source_id(sf_dir)}"
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.PRODUCTS.fields)
        for _ in range(2):
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet LOCATION '{folder}'")
        tables(spark, sf_dir).products.write.mode("overwrite").insertInto(name)
        return name

    return spark.table(prepared(spark, sf_dir, "declared", build))


@query("materialise_staging_view", "K11 S11", over_store("SELECT * FROM stg_customers"))
def materialise_staging_view(spark, sf_dir):
    model = staging.stg_customers(tables(spark, sf_dir).customers)
    return spark.table(sinks.create_view(model, f"stg_customers_{source_id(sf_dir)}"))


@query("materialise_mart_table", "K12 S11 Q17", DIM_CUSTOMERS)
def materialise_mart_table(spark, sf_dir):
    def build(folder):
        store = tables(spark, sf_dir)
        mart = marts.dim_customers(
            staging.stg_customers(store.customers), staging.stg_transactions(store.transactions))
        return sinks.create_table_as(mart, f"dim_customers_{source_id(sf_dir)}", folder)

    return spark.table(prepared(spark, sf_dir, "dim_customers", build))


FILTERED = over_store(
    "SELECT transaction_id, amount, country_code FROM transactions"
    " WHERE category = '1-URGENT' AND country_code = 'nation_3 ' AND amount > 50000")


@query("z_ordered_filter", "K3 F1 F2 Q3", FILTERED)
def z_ordered_filter(spark, sf_dir):
    """Rows by two codes and an amount, from files along a curve through the three."""
    path = prepared(spark, sf_dir, "z_ordered", lambda folder: layout.write_z_ordered(
        stored_transactions(spark, sf_dir), folder, ["category", "country_code"], ["amount"]))
    wanted = (F.col("category") == "1-URGENT") & (F.col("country_code") == "nation_3 ") & (F.col("amount") > 50000)
    return spark.read.parquet(path).where(wanted).select("transaction_id", "amount", "country_code")
