"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR  folder of the test tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    measured runs after a warm-up; the median counts (default 3)
BENCH_ROWS    rows of the generated table of the format comparison (default 5,000,000)

Every query is executed in full into the ``noop`` sink: a ``count()`` would let Catalyst drop the
sums, the sort and even a join. Names starting with ``stored_`` read one stored transactions table,
the others join it from the test tables each time. Names starting with ``formats_`` use the
generated table, which is written once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from cartwright.operators import joins, sinks
from cartwright.plans import exploration, history, incremental, marts, staging, storage, summaries
from cartwright.queries import QUERIES, base
from cartwright.queries import incremental as queries_incremental
from cartwright.session import local_session, scratch_dir
from cartwright.sources import generators, readers, schemas
from cartwright.sources.store import Store

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
ROWS = int(os.environ.get("BENCH_ROWS", "5000000"))

MAPPED = [
    "category_avg_amount",
    "filtered_revenue",
    "category_country_summary",
    "daily_summary_by_product_category",
    "daily_summary_by_product_category_sort_merge",
    "daily_summary_by_fact_category",
    "daily_summary_by_fact_category_sort_merge",
    "stg_transactions",
    "fct_daily_revenue",
    "dim_customers",
    "quality_report",
    "monthly_split_counts",
    "generate_transactions",
]


def run_fully(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def medians(actions: dict) -> dict[str, float]:
    """Median seconds per action. All of them run once before the first is measured."""
    for action in actions.values():
        action()
    return {name: median(action) for name, action in actions.items()}


def median(action) -> float:
    seconds = []
    for _ in range(RUNS):
        began = time.perf_counter()
        action()
        seconds.append(time.perf_counter() - began)
    return round(statistics.median(seconds), 3)


def mapped(spark) -> dict[str, float]:
    return medians({
        name: lambda name=name: run_fully(QUERIES[name].run(spark, SF_DIR)) for name in MAPPED
    })


def stored(spark) -> dict[str, float]:
    transactions = spark.read.parquet(base.transactions_parquet(spark, SF_DIR))
    shop = Store(spark, SF_DIR)
    products, customers = shop.products, staging.stg_customers(shop.customers)
    cleaned = staging.stg_transactions(transactions)
    table = base.history_table(spark, SF_DIR)
    numbers = iter(range(1_000))

    def load():
        n = next(numbers)
        history.load_history(spark, transactions, f"bench_history_{n}", scratch_dir(spark, "bench", f"history{n}"))

    def daily_partitioned():
        summary = summaries.daily_summary_by_fact_category(transactions)
        run_fully(spark.read.parquet(summaries.write_daily_summary(summary, scratch_dir(spark, "bench", "daily"))))

    def daily_by_month():
        summary = summaries.daily_summary_by_fact_category(transactions)
        path = summaries.write_daily_summary_by_month(summary, scratch_dir(spark, "bench", "daily_by_month"))
        run_fully(spark.read.parquet(path))

    partials = queries_incremental.partials(spark, SF_DIR, "partials_daily", incremental.DAILY)

    queries = {
        "category_country_summary": lambda: run_fully(summaries.category_country_summary(transactions)),
        "filtered_revenue": lambda: run_fully(
            exploration.filtered_revenue(transactions, "1-URGENT", "nation_3 ")),
        "stg_transactions": lambda: run_fully(cleaned),
        "daily_by_product": lambda: run_fully(
            summaries.daily_summary_by_product_category(transactions, products)),
        "daily_by_product_sort_merge": lambda: run_fully(
            summaries.daily_summary_by_product_category(transactions, products, joins.left_join_sort_merge)),
        "daily_by_fact": lambda: run_fully(summaries.daily_summary_by_fact_category(transactions)),
        "daily_summary_partitioned": daily_partitioned,
        "daily_summary_by_month": daily_by_month,
        "daily_from_partials": lambda: run_fully(incremental.merged(incremental.DAILY, partials)),
        "fct_daily_revenue": lambda: run_fully(marts.fct_daily_revenue(cleaned)),
        "dim_customers": lambda: run_fully(marts.dim_customers(customers, cleaned)),
        "time_travel_count": lambda: run_fully(
            history.time_travel_count(table, 1, history.month_batch(transactions, 1))),
        "history_of_four_batches": load,
    }
    return medians({f"stored_{name}": action for name, action in queries.items()})


def formats(spark) -> dict[str, float]:
    folder = scratch_dir(spark, "bench", "formats")
    keys = generators.ids(spark, ROWS, 4 * spark.sparkContext.defaultParallelism)
    source = f"{folder}/source"

    def generate():
        sinks.write_parquet(generators.benchmark_transactions(keys), source, "zstd")

    def convert(write, name):
        write(spark.read.schema(schemas.BENCHMARK_TRANSACTIONS).parquet(source), f"{folder}/{name}")

    def revenue(df):
        run_fully(exploration.filtered_revenue(df, "Electronics", "US"))

    columns = ["category", "country_code", "amount"]
    actions = {"generate": generate}
    for name, write in storage.FORMATS.items():
        actions[f"write_{name}"] = lambda write=write, name=name: convert(write, name)
    actions["filtered_sum_csv"] = lambda: revenue(
        readers.read_csv(spark, f"{folder}/csv", schemas.BENCHMARK_TRANSACTIONS))
    actions["filtered_sum_parquet_zstd"] = lambda: revenue(
        readers.read_parquet(spark, f"{folder}/parquet_zstd", columns))
    return medians({f"formats_{name}": action for name, action in actions.items()})


def main() -> None:
    spark = local_session(CPUS, "cartwright-bench", **{"spark.sql.shuffle.partitions": CPUS})
    results: dict[str, float] = {}
    for group in (mapped, stored, formats):
        results.update(group(spark))
        print(json.dumps(results), file=sys.stderr)
    print(json.dumps({
        "metric": "sum of median query times, full output, local mode",
        "value": round(sum(results.values()), 3),
        "unit": "sec",
        "queries": results,
        "sf": os.path.basename(SF_DIR).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
