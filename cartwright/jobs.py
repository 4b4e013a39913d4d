"""The jobs as commands over a data folder: ``python -m cartwright JOB --data FOLDER``.

Under ``spark-submit`` the submitted session is used. The folder must be one all executors share.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from cartwright.operators import quality, sampling, sinks
from cartwright.plans import exploration, history, marts, staging, storage, summaries
from cartwright.sources import files, generators, readers, schemas

JOBS: dict[str, Callable[[SparkSession, argparse.Namespace], None]] = {}


def job(run):
    JOBS[run.__name__.replace("_", "-")] = run
    return run


def _show(title: str, df: DataFrame, n: int = 30) -> None:
    print(f"\n{title}")
    df.show(n, truncate=False)


def _parquet(args, name: str) -> str:
    return f"{args.data}/{name}.parquet"


def _transactions(spark, args) -> DataFrame:
    return readers.seed_transactions(spark, _parquet(args, "transactions"))


@job
def generate(spark, args):
    """Seed data as CSV: transactions, customers, products."""
    n = args.rows or generators.N_TRANSACTIONS
    tables = {
        "transactions": generators.transactions(generators.ids(spark, n)),
        "customers": generators.customers(generators.ids(spark, generators.N_CUSTOMERS)),
        "products": generators.products(generators.ids(spark, generators.N_PRODUCTS)),
    }
    storage.write_seed_csv(tables, args.data)


@job
def generate_benchmark(spark, args):
    """The larger table of the format comparison, as CSV."""
    n = args.rows or generators.N_BENCHMARK_TRANSACTIONS
    rows = generators.benchmark_transactions(generators.ids(spark, n))
    sinks.write_csv(rows, f"{args.data}/benchmark.csv")


@job
def explore(spark, args):
    """Line count, first lines, category counts and average amounts of the seed CSV."""
    path = f"{args.data}/transactions.csv"
    header = ",".join(schemas.TRANSACTIONS.names)
    lines = readers.read_lines(spark, path)
    _show("Lines", exploration.line_count(lines, header))
    _show("First lines", exploration.head(spark, path))
    _show("Transactions per category", exploration.category_frequency(lines, header))
    detected = readers.read_csv_inferred(spark, path)
    _show("Average amount per category", exploration.category_avg_amount(detected))


@job
def convert(spark, args):
    """Seed CSV to Parquet."""
    paths = {name: f"{args.data}/{name}.csv" for name in schemas.SEED_TABLES}
    _show("Rows", storage.convert_csv_to_columnar(spark, paths, args.data))


@job
def check_inputs(spark, args):
    """Which input tables are present, and how large."""
    _show("Inputs", files.input_readiness(spark, args.data, ["transactions", "products"]))


@job
def compare_formats(spark, args):
    """Write time and size per format, and the filtered revenue read from two of them."""
    folder = f"{args.data}/formats"
    rows = readers.read_csv(spark, f"{args.data}/benchmark.csv", schemas.BENCHMARK_TRANSACTIONS)
    runs = storage.write_formats_counted(rows, folder)
    _show("Formats", storage.counted_format_report(spark, folder, runs))
    text = readers.read_csv(spark, f"{folder}/csv", schemas.BENCHMARK_TRANSACTIONS)
    columnar = readers.read_parquet(
        spark, f"{folder}/parquet_zstd", ["category", "country_code", "amount"])
    totals = []
    for name, stored in (("csv", text), ("parquet_zstd", columnar)):
        totals.append(exploration.filtered_revenue(stored, "Electronics", "US"))
        began = time.perf_counter()
        totals[-1].collect()
        print(f"{name}: {time.perf_counter() - began:.2f} s")
    _show("Agreement", quality.agreement(*totals, "revenue"))


@job
def summary(spark, args):
    """Revenue by category and country, written as Parquet."""
    result = summaries.category_country_summary(_transactions(spark, args))
    stored = spark.read.parquet(sinks.write_parquet(result, _parquet(args, "category_country_summary")))
    _show("Revenue by category and country", stored.orderBy("category", "country_code"))


@job
def daily(spark, args):
    """Daily revenue by product category and by transaction category; the latter is written."""
    transactions = _transactions(spark, args)
    products = spark.read.parquet(_parquet(args, "products"))
    by_product = summaries.daily_summary_by_product_category(transactions, products)
    by_fact = summaries.daily_summary_by_fact_category(transactions)
    for result in (by_product, by_fact):
        result.explain("simple")
        began = time.perf_counter()
        result.write.format("noop").mode("overwrite").save()
        print(f"{time.perf_counter() - began:.2f} s")
    summaries.write_daily_summary(by_fact, f"{args.data}/daily_summary")


@job
def load_history(spark, args):
    """Monthly batches, earlier states and a new column, in a catalog table."""
    transactions = _transactions(spark, args)
    _show("Rows per month", history.monthly_split_counts(transactions))
    name = history.load_history(spark, transactions, args.table, f"{args.data}/history/{args.table}", args.promotion_rows)
    table = spark.table(name)
    _show("January revenue", history.month_revenue_by_category(table))
    january = history.month_batch(transactions, 1)
    _show("Rows at the first batch", history.time_travel_count(table, 1, january))
    _show("Sample of the first batch", history.time_travel_sample(table, 1))
    _show("Earlier rows with the new column", history.evolved_sample(table, 3))
    _show("Largest discounts", history.discounts_on_top(table))
    _show("Batches", history.snapshots(spark, name).orderBy("snapshot_id"))
    print(f"Table {name} at {history.location(spark, name)}")


@job
def show_history(spark, args):
    """Batches of an existing history table, and a sample as of one of them."""
    table = spark.table(args.table)
    _show("Batches", history.snapshots(spark, args.table).orderBy("snapshot_id"))
    rows = table if args.snapshot is None else history.as_of(table, args.snapshot)
    if args.at:
        rows = history.as_of_time(spark, args.table, datetime.fromisoformat(args.at))
    rows.printSchema()
    _show("Sample", sampling.sample_batch(rows, 10))


@job
def load_raw(spark, args):
    """Raw catalog tables from the Parquet seed data."""
    tables = {
        "transactions": _transactions(spark, args),
        "customers": spark.read.parquet(_parquet(args, "customers")),
    }
    names, counts = storage.load_raw_tables_counted(tables, f"{args.data}/raw")
    _show("Rows", spark.createDataFrame(list(counts.items()), "table_name string, row_count long"))
    _show("Columns", storage.table_schemas(spark, names))


@job
def build_marts(spark, args):
    """Staging views and mart tables."""
    stg_transactions, stg_customers = _staging(spark, args)
    fact = sinks.create_table_as(
        marts.fct_daily_revenue(stg_transactions), "fct_daily_revenue", f"{args.data}/fct_daily_revenue")
    dimension = sinks.create_table_as(
        marts.dim_customers(stg_customers, stg_transactions), "dim_customers", f"{args.data}/dim_customers")
    for name in (fact, dimension):
        _show(name, spark.table(name), 10)


@job
def test_models(spark, args):
    """Checks the staging models' rules."""
    stg_transactions, stg_customers = _staging(spark, args)
    models = {"stg_transactions": stg_transactions, "stg_customers": stg_customers}
    _show("Rules", quality.report(models, staging.staging_rules()))


def _staging(spark, args) -> tuple[DataFrame, DataFrame]:
    transactions = staging.stg_transactions(_transactions(spark, args))
    customers = staging.stg_customers(spark.read.parquet(_parquet(args, "customers")))
    return (
        spark.table(sinks.create_view(transactions, "stg_transactions")),
        spark.table(sinks.create_view(customers, "stg_customers")),
    )


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="cartwright", description=__doc__)
    parser.add_argument("job", choices=sorted(JOBS))
    parser.add_argument("--data", required=True, help="folder of the tables")
    parser.add_argument("--rows", type=int, help="rows to generate")
    parser.add_argument("--table", default="transactions_history", help="name of the history table")
    parser.add_argument("--snapshot", type=int, help="batch to read as of; the newest if not given")
    parser.add_argument("--at", help="time (UTC, as 2024-05-01T12:00) to read as of")
    parser.add_argument("--promotion-rows", type=int, help="size of the promotional sample; all of April if not given")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"cartwright {args.job}").getOrCreate()
    JOBS[args.job](spark, args)
