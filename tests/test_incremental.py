"""Summaries from partials: equal to summaries of all rows, and loads that read their batch alone."""

from datetime import datetime
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from cartwright.plans import history, incremental, marts, staging, summaries

SCHEMA = (
    "transaction_id string, customer_id long, product_id long, category string, amount double,"
    " currency string, country_code string, status string, txn_timestamp timestamp_ntz"
)
WHOLE = {
    "CATEGORY_COUNTRY": summaries.category_country_summary,
    "DAILY": summaries.daily_summary_by_fact_category,
    "DAILY_REVENUE": lambda rows: marts.fct_daily_revenue(staging.stg_transactions(rows)),
    "CUSTOMER_ORDERS": lambda rows: marts.customer_orders(staging.stg_transactions(rows)),
}


def batch(spark, seed, n=200):
    made = [
        (
            None if i % 11 == 0 else f"t{seed}-{i}", i % 7 or None, i, [None, "Books", "Toys"][i % 3],
            [None, 0.0, 0.1, 1e6 + 0.01, -3.5, float("nan")][(i + seed) % 6], " usd", ["us ", None][i % 2],
            ["completed", "refunded", "completed", None][i % 4], datetime(2024, 1 + (i + seed) % 5, 1 + i % 28, 23, 59) if i % 13 else None,
        )
        for i in range(n)
    ]
    return spark.createDataFrame(made, SCHEMA)


@pytest.fixture
def table(spark, tmp_path):
    name = f"partials_{uuid4().hex}"

    def load(summary, rows, number):
        incremental.load_partials(spark, summary, name, str(tmp_path / name), rows, number)
        return spark.table(name)

    yield load
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", WHOLE)
def test_merged_partials_equal_the_whole_summary(spark, table, name):
    summary = getattr(incremental, name)
    batches = {1: batch(spark, 1), 2: batch(spark, 2), 3: batch(spark, 3)}
    for number, rows in [*batches.items(), (2, batch(spark, 4, 90)), (3, batch(spark, 3))]:
        partials = table(summary, rows, number)
    held = batch(spark, 1).unionByName(batch(spark, 4, 90)).unionByName(batch(spark, 3))
    assert rows_of(incremental.merged(summary, partials)) == rows_of(WHOLE[name](held))
    early = batch(spark, 1).unionByName(batch(spark, 4, 90))
    assert rows_of(incremental.merged(summary, partials, through=2)) == rows_of(WHOLE[name](early))


def test_an_empty_batch_takes_the_old_one_away(spark, table):
    table(incremental.DAILY, batch(spark, 1), 1)
    table(incremental.DAILY, batch(spark, 2), 2)
    partials = table(incremental.DAILY, batch(spark, 1).where("false"), 1)
    assert rows_of(incremental.merged(incremental.DAILY, partials)) == rows_of(WHOLE["DAILY"](batch(spark, 2)))
    partials = table(incremental.DAILY, batch(spark, 1).where("false"), 2)
    assert incremental.merged(incremental.DAILY, partials).count() == 0


def test_only_the_new_batch_is_read(spark, table, tmp_path, plan_of):
    """With the files of every other batch gone, a load and its merge still work."""
    name = f"history_{uuid4().hex}"
    history.create_table(spark, name, str(tmp_path / name))
    for number in (1, 2):
        history.load_batch(spark, name, batch(spark, number), number)
        table(incremental.DAILY, history.in_batch(spark.table(name), number), number)
    plan = plan_of(incremental.DAILY.partials(history.in_batch(spark.table(name), 3)))
    assert plan.count("Scan parquet") == 2 and "batch_id" in plan.split("PartitionFilters:")[1].split("\n")[0]
    for file in (tmp_path / name).rglob("part-*"):
        file.unlink()
    history.load_batch(spark, name, batch(spark, 3), 3)
    partials = table(incremental.DAILY, history.in_batch(spark.table(name), 3), 3)
    held = batch(spark, 1).unionByName(batch(spark, 2)).unionByName(batch(spark, 3))
    assert rows_of(incremental.merged(incremental.DAILY, partials)) == rows_of(WHOLE["DAILY"](held))
    spark.sql(f"DROP TABLE {name}")


def test_a_filter_on_batches_reaches_the_scan_and_partials_are_combined_first(spark, table, plan_of):
    partials = table(incremental.DAILY, batch(spark, 1), 1)
    plan = plan_of(incremental.merged(incremental.DAILY, partials, through=4))
    assert "batch_id" in plan.split("PartitionFilters:")[1].split("\n")[0]
    assert plan.index("partial_sum") < plan.index("hashpartitioning(sale_date")
    assert partials.select(F.max("batch_id")).first()[0] == 1
