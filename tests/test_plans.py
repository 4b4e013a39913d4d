"""The physical plans that matter at scale."""

import pytest
from pyspark.sql import functions as F

from cartwright.operators import joins, sinks
from cartwright.plans import marts, staging, summaries
from cartwright.queries import QUERIES
from cartwright.sources import store
from cartwright.sources.store import Store

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def flat(spark, tmp_path_factory):
    """The three tables as stored files."""
    root = str(tmp_path_factory.mktemp("flat"))
    made = Store(spark, SF_DIR)
    return {
        name: spark.read.parquet(sinks.write_parquet(getattr(made, name), f"{root}/{name}"))
        for name in ("transactions", "customers", "products")
    }


def test_filters_and_columns_reach_the_scan(flat, plan_of):
    plan = plan_of(summaries.category_country_summary(flat["transactions"]))
    assert "EqualTo(status,completed)" in plan and "IsNotNull(amount)" in plan
    read = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "customer_id" not in read and "txn_timestamp" not in read and "currency" not in read


def test_summary_shuffles_groups_not_rows(flat, plan_of):
    plan = plan_of(summaries.category_country_summary(flat["transactions"]))
    assert plan.index("partial_sum") < plan.index("hashpartitioning(category")


@pytest.mark.parametrize("threshold, join", [("10MB", "BroadcastHashJoin"), ("-1", "SortMergeJoin")])
def test_dimension_of_any_size_joins_sums_not_sales(flat, plan_of, conf, threshold, join):
    conf(spark__sql__autoBroadcastJoinThreshold=threshold)
    plan = plan_of(summaries.daily_summary_by_product_category(flat["transactions"], flat["products"]))
    tree = plan[: plan.index("\n(1) ")]
    assert join in tree
    below = tree[tree.index(join):]
    assert below.count("HashAggregate") == 2 and tree[: tree.index(join)].count("HashAggregate") == 2


def test_customers_dimension_shuffles_transactions_once(flat, plan_of, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    plan = plan_of(marts.dim_customers(
        staging.stg_customers(flat["customers"]), staging.stg_transactions(flat["transactions"])))
    tree = plan[: plan.index("\n(1) ")]
    assert tree.count("Exchange") == 2 and tree.count("SortMergeJoin") == 1


def test_store_mapping_shuffles_line_items_once(spark, plan_of, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    plan = plan_of(store.transactions(spark, SF_DIR))
    assert plan.count("hashpartitioning(l_orderkey") == 1


def test_hot_key_partition_is_split(spark, plan_of, conf, tmp_path):
    """A third of the sales have one product, a third have none."""
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="10KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20KB",
    )
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, None).otherwise(F.col("id"))
    sales = spark.range(0, 60_000, 1, 8).select(key.alias("product_id"), F.col("id").alias("sale"))
    names = spark.range(0, 60_000, 1, 8).select(F.col("id").alias("product_id"), F.col("id").alias("name"))
    joined = joins.left_join_sort_merge(sales, names, "product_id")
    rows = joined.collect()
    assert len(rows) == 60_000
    assert sum(r["name"] is None for r in rows) == 20_000
    assert sum(r["name"] == 7 for r in rows) == 20_000
    assert "skew=true" in plan_of(joined)


def test_hot_partition_value_is_written_by_several_tasks(spark, conf, tmp_path):
    conf(spark__sql__adaptive__advisoryPartitionSizeInBytes="64KB")
    df = spark.range(0, 200_000, 1, 8).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("month"))
    path = sinks.write_partitioned(df, str(tmp_path / "out"), "month")
    stored = spark.read.parquet(path)
    assert stored.count() == 200_000
    files = stored.where("month = 0").select("_metadata.file_path").distinct().count()
    assert files > 1


def test_partition_pruning_of_the_written_summary(spark, flat, plan_of, tmp_path):
    summary = summaries.daily_summary_by_fact_category(
        flat["transactions"].where("month(txn_timestamp) = 1 AND year(txn_timestamp) = 1997"))
    path = summaries.write_daily_summary(summary, str(tmp_path / "daily"))
    one_day = spark.read.parquet(path).where("sale_date = DATE'1997-01-15'")
    plan = plan_of(one_day)
    filters = plan.split("PartitionFilters: ")[1].split("\n")[0]
    assert "sale_date" in filters
    per_day = spark.read.parquet(path).groupBy("sale_date").agg(
        F.count_distinct("_metadata.file_path").alias("files"))
    assert per_day.where("files > 1").count() == 0


def test_daily_write_does_not_sort_globally_first(flat, plan_of):
    summary = summaries.daily_summary_by_fact_category(flat["transactions"])
    plan = plan_of(summary.repartition("sale_date"))
    assert "rangepartitioning" not in plan


@pytest.mark.parametrize("name", QUERIES)
def test_queries_use_no_python_workers_and_no_cross_join(spark, plan_of, name):
    plan = plan_of(QUERIES[name].run(spark, SF_DIR))
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
