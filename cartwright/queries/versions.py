"""The transactions by monthly batch: history, earlier states, a new column, a repeated load."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from cartwright.operators import quality
from cartwright.plans import history
from cartwright.queries.base import (
    history_name,
    history_table,
    prepared,
    query,
    store_query,
    stored_transactions,
    table_name,
)
from cartwright.queries.canonical import over_store, rounded_money
from cartwright.queries.generated import below_sql, draw_sql, uniform_decimal_sql
from cartwright.sources import schemas

ROWS = """
SELECT transaction_id, CAST(customer_id AS INTEGER) AS customer_id,
       CAST(product_id AS INTEGER) AS product_id, category, amount, currency, country_code,
       status, txn_timestamp
FROM transactions"""
KEY = "CAST('0x' || substr(md5(concat_ws('|', transaction_id, customer_id, product_id)), 1, 15) AS BIGINT)"
DISCOUNT = (
    f"CASE WHEN {below_sql(draw_sql('promotion', KEY, 0), 0.2)}"
    f" THEN {uniform_decimal_sql(draw_sql('promotion', KEY, 1), 5, 15, 1)} END"
)
ALL_COLUMNS = ", ".join(f"{name} NULLS FIRST" for name in schemas.VERSIONED_TRANSACTIONS.names)
BATCHES = {f"m{m}": f"{ROWS} WHERE month(txn_timestamp) = {m}" for m in (1, 2, 3, 4)}
WHOLE = "SELECT * FROM m4"
SAMPLE = f"SELECT * FROM m4 ORDER BY {ALL_COLUMNS} LIMIT 500"
EARLIER = "SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3"


def _evolved(promotion: str) -> str:
    return (
        f"SELECT *, CAST(NULL AS DOUBLE) AS discount_pct FROM ({EARLIER})"
        f" UNION ALL SELECT *, {DISCOUNT} AS discount_pct FROM ({promotion})"
    )


def over_history(select: str, promotion: str = WHOLE) -> str:
    return over_store(select, **BATCHES, earlier=EARLIER, evolved=_evolved(promotion))


SIZES = """
SELECT 1 AS snapshot_id, (SELECT COUNT(*) FROM m1) AS added
UNION ALL SELECT 2, (SELECT COUNT(*) FROM m2)
UNION ALL SELECT 3, (SELECT COUNT(*) FROM m3)
UNION ALL SELECT 4, (SELECT COUNT(*) FROM promotion)"""


def over_sizes(select: str) -> str:
    return over_store(select, **BATCHES, earlier=EARLIER, evolved=_evolved(WHOLE), promotion=WHOLE, sizes=SIZES)


@store_query("monthly_split_counts", "Q7 F5 A6", over_store(
    "SELECT CAST(month(txn_timestamp) AS INTEGER) AS month, COUNT(*) AS row_count FROM transactions"
    " WHERE month(txn_timestamp) IN (1, 2, 3, 4) GROUP BY 1"))
def monthly_split_counts(store):
    return history.monthly_split_counts(store.transactions)


@query("month_revenue_by_category", "Q8 S7 F1 A5 A3 O3", over_history(
    f"SELECT category, COUNT(*) AS transaction_count, {rounded_money()} AS total_revenue, status"
    " FROM m1 WHERE status = 'completed' GROUP BY category, status"))
def month_revenue_by_category(spark, sf_dir):
    return history.month_revenue_by_category(history_table(spark, sf_dir))


@query("snapshot_history", "Q9 S9 K9 X17 O5", over_sizes(
    "SELECT CAST(snapshot_id AS BIGINT) AS snapshot_id, 'append' AS operation,"
    " CAST(SUM(added) OVER (ORDER BY snapshot_id) AS VARCHAR) AS total_records FROM sizes"))
def snapshot_history(spark, sf_dir):
    """Rows after each batch, from the log of loads."""
    return history.snapshots(spark, history_name(spark, sf_dir)).select(
        "snapshot_id", "operation", F.col("total_records").cast("string").alias("total_records"))


@query("commit_history", "Q9 S9 K9 K13 O5", over_sizes(
    "SELECT CAST(snapshot_id AS BIGINT) AS snapshot_id,"
    " make_timestamp(2024, snapshot_id, 28, 18, 0, 0.0) AS committed_at, 'append' AS operation,"
    " added AS added_records,"
    " CASE WHEN snapshot_id = 4 THEN (SELECT COUNT(discount_pct) FROM evolved) ELSE 0 END AS discounts,"
    " CAST(SUM(added) OVER (ORDER BY snapshot_id) AS BIGINT) AS total_records FROM sizes"))
def commit_history(spark, sf_dir):
    """The same with the times of the loads and what each write counted."""
    log = history.snapshots(spark, history_name(spark, sf_dir))
    counted = {"added_records": "added-records", "discounts": "discounts"}
    return log.select(
        "snapshot_id", "committed_at", "operation", "total_records",
        *[F.element_at("summary", key).cast("bigint").alias(name) for name, key in counted.items()],
    ).orderBy("committed_at")


@query("state_at_time", "S8 Q10", over_history("SELECT * FROM m1 UNION ALL SELECT * FROM m2"))
def state_at_time(spark, sf_dir):
    """The rows as of an afternoon in March: January's and February's loads."""
    moment = datetime(2024, 3, 20, 16, 30)
    return history.as_of_time(spark, history_name(spark, sf_dir), moment).drop(history.DISCOUNT)

@query("snapshot_summaries", "S9 X17", over_sizes(
    "SELECT CAST(snapshot_id AS BIGINT) AS snapshot_id,"
    " CAST(snapshot_id - 1 AS BIGINT) AS earlier,"
    " added AS added_records,"
    " CASE WHEN snapshot_id = 4 THEN (SELECT COUNT(discount_pct) FROM evolved) ELSE 0 END AS discounts"
    " FROM sizes"))
def snapshot_summaries(spark, sf_dir):
    return history.batches(history_table(spark, sf_dir)).select(
        "snapshot_id", (F.col("snapshot_id") - 1).alias("earlier"),
        F.element_at("summary", "added-records").cast("bigint").alias("added_records"),
        F.element_at("summary", "discounts").cast("bigint").alias("discounts"),
    )


@query("first_snapshot", "O5 K14", over_history("SELECT CAST(1 AS BIGINT) AS snapshot_id, COUNT(*) AS row_count FROM m1"))
def first_snapshot(spark, sf_dir):
    """The batch of the first load, by its time, names the state that is then counted."""
    log = history.snapshots(spark, history_name(spark, sf_dir))
    first = log.orderBy("committed_at").first()["snapshot_id"]
    table = history_table(spark, sf_dir)
    return history.as_of(table, first).agg(F.count("*").alias("row_count")).select(
        F.lit(first).cast("bigint").alias("snapshot_id"), "row_count")


@query("append_batch", "K9", over_history("SELECT *, CAST(NULL AS DOUBLE) AS discount_pct FROM m2"))
def append_batch(spark, sf_dir):
    """What the second append added."""
    return history.in_batch(history_table(spark, sf_dir), 2)


@query("current_rows", "S7 K9 K10", over_history("SELECT * FROM evolved"))
def current_rows(spark, sf_dir):
    return history_table(spark, sf_dir).drop(history.BATCH, history.MONTH)


@query("current_row_count", "S7 A6", over_history("SELECT COUNT(*) AS row_count FROM evolved"))
def current_row_count(spark, sf_dir):
    return history_table(spark, sf_dir).agg(F.count("*").alias("row_count"))


@query("time_travel_rows", "S8", over_history("SELECT * FROM m1 UNION ALL SELECT * FROM m2"))
def time_travel_rows(spark, sf_dir):
    return history.as_of(history_table(spark, sf_dir), 2).drop(history.DISCOUNT)


@query("time_travel_count", "Q10 S8 A6 D5 K14", over_history(
    "SELECT COUNT(*) AS row_count, COUNT(*) AS batch_count, TRUE AS matches FROM m1"))
def time_travel_count(spark, sf_dir):
    january = history.month_batch(stored_transactions(spark, sf_dir), 1)
    return history.time_travel_count(history_table(spark, sf_dir), 1, january)


@query("time_travel_sample", "Q11 S8 P1 O7", over_history(
    "SELECT transaction_id, customer_id, category, amount, status, txn_timestamp FROM m1"
    " ORDER BY transaction_id NULLS FIRST, customer_id, category, amount NULLS FIRST, status,"
    " txn_timestamp LIMIT 10"))
def time_travel_sample(spark, sf_dir):
    return history.time_travel_sample(history_table(spark, sf_dir), 1)


def _earlier(spark, sf_dir):
    """The first three batches with their partition columns."""
    return history_table(spark, sf_dir).where(F.col(history.BATCH) <= 3)


@query("months_pruned", "S8 K8", over_history(
    "SELECT * FROM earlier WHERE txn_timestamp >= TIMESTAMP '1997-01-01'"
    " AND txn_timestamp < TIMESTAMP '1997-03-01'"))
def months_pruned(spark, sf_dir):
    """Two calendar months of a state, by directory."""
    months = F.col(history.MONTH).isin("1997-01-01", "1997-02-01")
    return _earlier(spark, sf_dir).where(months).drop(history.BATCH, history.MONTH, history.DISCOUNT)


@query("time_range_pruned", "S8 K8", over_history(
    "SELECT * FROM earlier WHERE txn_timestamp >= TIMESTAMP '1997-01-15'"
    " AND txn_timestamp < TIMESTAMP '1998-02-10'"))
def time_range_pruned(spark, sf_dir):
    """A range within months: the directories first, then the exact times."""
    return history.between(_earlier(spark, sf_dir), "1997-01-15", "1998-02-10").drop(
        history.BATCH, history.MONTH, history.DISCOUNT)


@query("schema_evolution_nulls", "Q12 K10 P1 O7", over_history(
    "SELECT transaction_id, amount, currency, status, CAST(NULL AS DOUBLE) AS discount_pct FROM earlier"
    " ORDER BY transaction_id NULLS FIRST, amount NULLS FIRST, currency, status LIMIT 8"))
def schema_evolution_nulls(spark, sf_dir):
    return history.evolved_sample(history_table(spark, sf_dir), 3)


LABEL = (
    f"CASE WHEN discount_pct IS NULL THEN '{history.LEGACY}' ELSE '{history.DISCOUNTED}' END AS row_origin"
)
MIXED = (
    f"SELECT transaction_id, amount, status, discount_pct, {LABEL}"
    " FROM evolved ORDER BY discount_pct DESC NULLS LAST, transaction_id NULLS FIRST,"
    " amount NULLS FIRST, status LIMIT 15"
)


@query("schema_evolution_mixed", "Q13 F5 F8 O4 O6 O7 X12 X13 X15 X16 K9", over_history(MIXED))
def schema_evolution_mixed(spark, sf_dir):
    return history.discounts_on_top(history_table(spark, sf_dir))


@query("schema_evolution_sampled", "Q13 O7", over_history(MIXED, promotion=SAMPLE))
def schema_evolution_sampled(spark, sf_dir):
    """The same with a promotional batch of 500 rows."""
    return history.discounts_on_top(history_table(spark, sf_dir, promotion_rows=500))


@query("schema_evolution_whole_month", "Q13 K10", over_history(
    f"SELECT {LABEL}, COUNT(*) AS row_count, COUNT(discount_pct) AS discounts,"
    " COALESCE(CAST(SUM(CAST(discount_pct AS DECIMAL(18,1))) AS DOUBLE), 0.0) AS discount_sum"
    " FROM evolved GROUP BY 1"))
def schema_evolution_whole_month(spark, sf_dir):
    return history.origin_counts(history_table(spark, sf_dir))


EXTRA_MARCH = over_history("SELECT *, COUNT(*) AS extra_copies FROM m3 GROUP BY ALL")


def repeated_load(spark, sf_dir):
    """A table whose March batch was loaded twice, under two numbers."""
    def build(folder):
        name = history.create_table(spark, table_name(spark, sf_dir, "repeated_load"), folder)
        transactions = stored_transactions(spark, sf_dir)
        for number, month in ((1, 1), (2, 2), (3, 3), (4, 3)):
            history.append_rows(spark, name, history.month_batch(transactions, month), number)
        return name

    return spark.table(prepared(spark, sf_dir, "repeated_load", build))


@query("repeated_load_diff", "D9 K9 S8", EXTRA_MARCH)
def repeated_load_diff(spark, sf_dir):
    """What the table holds more often than its state before the second load."""
    table = repeated_load(spark, sf_dir)
    return quality.surplus_rows(history.as_of(table, 4), history.as_of(table, 3))


@query("multiset_difference", "D9 S8", EXTRA_MARCH)
def multiset_difference(spark, sf_dir):
    """The same difference between row sets of two origins."""
    whole = history.as_of(repeated_load(spark, sf_dir), 4)
    return quality.surplus_rows(whole, history.as_of(history_table(spark, sf_dir), 3).drop(history.DISCOUNT))


@query("repeated_load_rows", "D9 S8 K8", over_history(
    "SELECT *, COUNT(*) AS held_copies, COUNT(*) AS added_copies FROM m3 GROUP BY ALL"))
def repeated_load_rows(spark, sf_dir):
    """Which rows of the second load were already there."""
    return history.repeated_rows(repeated_load(spark, sf_dir), after=3)
