"""Monthly loads into a partitioned catalog table: batches, earlier states, a new column.

A batch is a value of the partition column ``batch_id``, so the table as of a batch is a partition
filter, and loading a batch again replaces that batch alone. Every load adds to a log beside the table, after
the batch is written: number, batch, time, operation and the rows that the write counted. What was loaded
when, and how much, is read from there and not from the table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartwright.functions import calendar, draws, money
from cartwright.operators import sampling, sinks
from cartwright.sources import schemas

# The promotional batch and the labels of its rows.
DISCOUNT = "discount_pct"
DISCOUNTED_SHARE = 0.2
DISCOUNT_RANGE = (5.0, 15.0)
LEGACY, DISCOUNTED = "legacy row (no discount)", "new row (discount applied)"

BATCH, MONTH = "batch_id", "txn_month"
APRIL = 4

COMMIT = (
    "commit_id bigint, batch_id int, committed_at timestamp_ntz, operation string, records bigint, discounts bigint"
)


def monthly_split_counts(transactions: DataFrame, months=(1, 2, 3, 4)) -> DataFrame:
    """Rows per month of the year, all years together."""
    month = F.month("txn_timestamp").alias("month")
    return (
        transactions.select(month)
        .where(F.col("month").isin(list(months)))
        .groupBy("month")
        .agg(F.count("*").alias("row_count"))
        .orderBy("month")
    )


def month_batch(transactions: DataFrame, month: int) -> DataFrame:
    return transactions.where(F.month("txn_timestamp") == month)


def with_discount(batch: DataFrame, salt: str = "promotion") -> DataFrame:
    """About a fifth of the rows get a discount of 5 to 15 percent, the others NULL.

    The draw hangs on the row's ids, so a repeated load gives the same discounts.
    """
    key = draws.text_key(F.concat_ws("|", "transaction_id", "customer_id", "product_id"))
    picked = draws.below(draws.draw(salt, key, 0), DISCOUNTED_SHARE)
    percent = draws.uniform_decimal(draws.draw(salt, key, 1), *DISCOUNT_RANGE, 1)
    return batch.withColumn(DISCOUNT, F.when(picked, percent).otherwise(F.lit(None).cast("double")))


def create_table(spark: SparkSession, name: str, path: str) -> str:
    """The transactions table by batch and month, if there is none of that name."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.VERSIONED_TRANSACTIONS.fields)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}, {BATCH} INT, {MONTH} DATE) USING parquet"
        f" PARTITIONED BY ({BATCH}, {MONTH}) LOCATION '{path}'"
    )
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_log(name)} ({COMMIT}) USING parquet"
        f" LOCATION '{location(spark, name).rstrip('/')}_commits'"
    )
    return name


def location(spark: SparkSession, name: str) -> str:
    """The folder of a catalog table."""
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {name}")
    return described.where("col_name = 'Location'").first()["data_type"]


def _log(name: str) -> str:
    return f"{name}_commits"


def commits(spark: SparkSession, name: str) -> DataFrame:
    """Every load of the table: commit_id, batch_id, committed_at, operation, records, discounts."""
    return spark.table(_log(name))


def _commit(spark: SparkSession, name: str, written: Mapping[int, tuple[int, int]],
            times: Mapping[int, datetime] | None = None, appended: bool = False) -> None:
    """Adds a line per batch to the log: rows and discounts by batch, at the given time or now (UTC).

    A batch that was there is overwritten, unless rows were ``appended`` to it.
    """
    now = datetime.now(UTC).replace(tzinfo=None)
    known = commits(spark, name).groupBy(BATCH).agg(F.max("commit_id").alias("last")).collect()
    before, last = {r[BATCH] for r in known}, max((r["last"] for r in known), default=0)
    rows = [
        (last + n, batch_id, (times or {}).get(batch_id, now), "overwrite" if batch_id in before and not appended else "append", *counts)
        for n, (batch_id, counts) in enumerate(sorted(written.items()), 1)
    ]
    spark.createDataFrame(rows, COMMIT).coalesce(1).write.insertInto(_log(name))


def _watched(rows: DataFrame, *batch_ids: int):
    """``rows`` counted by batch while they are written; a table without discounts counts none."""
    discount = F.col(DISCOUNT) if DISCOUNT in rows.columns else F.lit(None)
    of = lambda b: F.lit(True) if BATCH not in rows.columns else F.col(BATCH) == b
    metrics = {f"rows_{b}": F.count_if(of(b)) for b in batch_ids}
    metrics |= {f"discounts_{b}": F.count_if(of(b) & discount.isNotNull()) for b in batch_ids}
    watched, seen = sinks.counted(rows, **metrics)
    return watched, lambda: {b: (seen.get[f"rows_{b}"], seen.get[f"discounts_{b}"]) for b in batch_ids}


def _rows(spark: SparkSession, name: str, batch: DataFrame, *kept: str) -> DataFrame:
    """The batch in the table's columns and types; columns it lacks are NULL."""
    own = {c.lower() for c in batch.columns}
    fields = [f for f in spark.table(name).schema.fields if f.name not in (BATCH, MONTH)]
    typed = [
        (F.col(f.name) if f.name.lower() in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields
    ]
    return batch.select(*typed, *kept, calendar.month_start(F.col("txn_timestamp")).alias(MONTH))


def load_batch(spark: SparkSession, name: str, batch: DataFrame, batch_id: int,
               at: datetime | None = None) -> None:
    """Writes a batch, in place of an earlier one with its number; other batches stay as they are.

    Rows of a month go together, and Spark splits a month that holds much of the batch. ``at`` is the
    time that the log gives, now if None.
    """
    rows, counts = _watched(_rows(spark, name, batch).hint("rebalance", MONTH), batch_id)
    view = f"batch_{batch_id}_of_{name.replace('.', '_')}"
    rows.createOrReplaceTempView(view)
    spark.sql(
        f"INSERT OVERWRITE TABLE {name} PARTITION ({BATCH} = {int(batch_id)}, {MONTH}) SELECT * FROM {view}"
    )
    spark.catalog.dropTempView(view)
    _commit(spark, name, counts(), at and {batch_id: at})


def append_rows(spark: SparkSession, name: str, batch: DataFrame, batch_id: int,
                at: datetime | None = None) -> None:
    """Appends rows under a batch number, beside whatever has that number already."""
    order = spark.table(name).columns
    rows = _rows(spark, name, batch).hint("rebalance", MONTH).withColumn(BATCH, F.lit(int(batch_id)))
    rows, counts = _watched(rows.select(*order), batch_id)
    rows.write.mode("append").insertInto(name)
    _commit(spark, name, counts(), at and {batch_id: at}, appended=True)


def loaded_batches(spark: SparkSession, name: str) -> set[int]:
    """Numbers of the batches that have partitions; their rows are not read."""
    listed = spark.sql(f"SHOW PARTITIONS {name}").collect()
    return {int(r["partition"].split("/")[0].split("=")[1]) for r in listed}


def load_batches(spark: SparkSession, name: str, rows: DataFrame, batch_of: Column, batch_ids: Sequence[int],
                 times: Mapping[int, datetime] | None = None) -> None:
    """Loads several batches; ``batch_of`` says which one a row belongs to, other rows are left out.

    Batches that are all new are written in one pass over ``rows``, month by month as in ``load_batch``; a
    partition that a failed load left behind is replaced. If one of them is there already, each is loaded
    in its earlier one's place, so that loading again changes nothing.
    """
    if loaded_batches(spark, name) & set(batch_ids):
        for batch_id in batch_ids:
            load_batch(spark, name, rows.where(batch_of == batch_id), batch_id, (times or {}).get(batch_id))
        return
    numbered = rows.where(batch_of.isin(list(batch_ids))).withColumn(BATCH, batch_of.cast("int"))
    typed = _rows(spark, name, numbered, BATCH).hint("rebalance", BATCH, MONTH)
    watched, counts = _watched(typed, *batch_ids)
    folder = location(spark, name)
    (
        watched.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(BATCH, MONTH).parquet(folder)
    )
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    spark.catalog.refreshTable(name)
    _commit(spark, name, counts(), times)


def add_discount(spark: SparkSession, name: str) -> None:
    """Adds the discount column, if it isn't there; no file is rewritten and old rows read NULL."""
    if DISCOUNT not in spark.table(name).columns:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({DISCOUNT} DOUBLE)")


def load_history(spark: SparkSession, transactions: DataFrame, name: str, path: str,
                 promotion_rows: int | None = None, times: Mapping[int, datetime] | None = None) -> str:
    """January to March as batches 1 to 3, then a new column, then April as a promotional batch.

    Loading again replaces the four batches by themselves. ``times`` are the batches' times in the log.

    The promotional batch is all of April. With ``promotion_rows`` it is a sample of that size, taken
    from the whole input if there is no April; without that bound an absent April stays absent, since
    the whole input would load every row a second time.
    """
    create_table(spark, name, path)
    load_batches(spark, name, transactions, F.month("txn_timestamp"), (1, 2, 3), times)
    add_discount(spark, name)
    april = month_batch(transactions, APRIL)
    if promotion_rows is not None:
        wanted = F.month("txn_timestamp") == APRIL
        april = sampling.sample_batch(sampling.batch_or_fallback(transactions, wanted), promotion_rows)
    load_batch(spark, name, with_discount(april), APRIL, (times or {}).get(APRIL))
    return name


def as_of(table: DataFrame, batch_id: int) -> DataFrame:
    """The rows of the batches up to one: other partitions are not read."""
    return table.where(F.col(BATCH) <= batch_id).drop(BATCH, MONTH)


def in_batch(table: DataFrame, batch_id: int) -> DataFrame:
    return table.where(F.col(BATCH) == batch_id).drop(BATCH, MONTH)


def between(table: DataFrame, start: str, end: str) -> DataFrame:
    """Rows from ``start`` up to before ``end``: the months by partition, then the exact times."""
    first, last = (F.trunc(F.lit(x).cast("date"), "month") for x in (start, end))
    moment = F.col("txn_timestamp")
    return table.where(F.col(MONTH).between(first, last)).where(
        (moment >= F.lit(start).cast("timestamp_ntz")) & (moment < F.lit(end).cast("timestamp_ntz"))
    )


def as_of_time(spark: SparkSession, name: str, moment: datetime) -> DataFrame:
    """The rows of the table as it was at a time: the log names the batches, other partitions are not read.

    A batch that was there by then and has been loaded again since is an error, since its rows of that
    time are gone. The log has a line per load, so its answer is a list of batches on the driver.
    """
    log = commits(spark, name).groupBy(BATCH).agg(F.min("committed_at").alias("first"), F.max("committed_at").alias("last"))
    held = log.where(F.col("first") <= F.lit(moment)).collect()
    if changed := sorted(r[BATCH] for r in held if r["last"] > moment):
        raise ValueError(f"batches {changed} of {name} have been loaded again since {moment}")
    return spark.table(name).where(F.col(BATCH).isin([r[BATCH] for r in held])).drop(BATCH, MONTH)


def snapshots(spark: SparkSession, name: str) -> DataFrame:
    """The table's batches from the log: snapshot_id, committed_at, operation, summary and total_records.

    committed_at and operation are those of the last load; rows are summed over the loads since the last
    replacement, and totals run over the batches by their numbers.
    """
    log = commits(spark, name)
    replaced = F.max(F.when(F.col("operation") == "overwrite", F.col("commit_id"))).over(Window.partitionBy(BATCH))
    current = log.withColumn("since", F.coalesce(replaced, F.lit(0))).where(F.col("commit_id") >= F.col("since"))
    latest = current.groupBy(F.col(BATCH).cast("bigint").alias("snapshot_id")).agg(
        F.max("committed_at").alias("committed_at"), F.max_by("operation", "commit_id").alias("operation"),
        F.sum("records").alias("added"), F.sum("discounts").alias("discounts"),
    )
    return latest.select(
        "snapshot_id", "committed_at", "operation",
        F.create_map(
            F.lit("added-records"), F.col("added").cast("string"), F.lit("discounts"), F.col("discounts").cast("string")
        ).alias("summary"),
        F.sum("added").over(Window.orderBy("snapshot_id")).alias("total_records"),
    )


def batches(table: DataFrame) -> DataFrame:
    """One row per batch with its number of rows and whether it has discounts, as a map, by counting the table."""
    return table.groupBy(F.col(BATCH).cast("bigint").alias("snapshot_id")).agg(
        F.create_map(
            F.lit("added-records"), F.count("*").cast("string"),
            F.lit("discounts"), F.count(DISCOUNT).cast("string"),
        ).alias("summary")
    )


def month_revenue_by_category(table: DataFrame, batch_id: int = 1) -> DataFrame:
    """Completed revenue as of a batch by category, largest first."""
    return (
        as_of(table, batch_id)
        .where(F.col("status") == "completed")
        .groupBy("category", "status")
        .agg(
            F.count("*").alias("transaction_count"),
            money.rounded_total(F.col("amount")).alias("total_revenue"),
        )
        .orderBy(F.desc("total_revenue"), "category")
    )


def time_travel_count(table: DataFrame, batch_id: int, batch: DataFrame) -> DataFrame:
    """Rows as of a batch, the rows that batch came from, and whether they are as many."""
    counted = as_of(table, batch_id).select(F.lit(1).alias("travelled")).unionAll(
        batch.select(F.lit(0).alias("travelled"))
    )
    return counted.agg(
        F.count_if(F.col("travelled") == 1).alias("row_count"),
        F.count_if(F.col("travelled") == 0).alias("batch_count"),
    ).withColumn("matches", F.col("row_count") == F.col("batch_count"))


def time_travel_sample(table: DataFrame, batch_id: int, n: int = 10) -> DataFrame:
    columns = ["transaction_id", "customer_id", "category", "amount", "status", "txn_timestamp"]
    return sampling.sample_batch(as_of(table, batch_id).select(*columns), n)


def evolved_sample(table: DataFrame, batch_id: int, n: int = 8) -> DataFrame:
    """Rows written before the new column, read with it: the column is NULL."""
    columns = ["transaction_id", "amount", "currency", "status", DISCOUNT]
    return sampling.sample_batch(as_of(table, batch_id).select(*columns), n)


def row_origin() -> F.Column:
    """The label follows the discount, not the batch: a new row without one reads as legacy."""
    return F.when(F.col(DISCOUNT).isNull(), LEGACY).otherwise(DISCOUNTED)


def discounts_on_top(table: DataFrame, n: int = 15) -> DataFrame:
    """The largest discounts of the table, rows without one last."""
    return (
        table.select("transaction_id", "amount", "status", DISCOUNT, row_origin().alias("row_origin"))
        .orderBy(F.col(DISCOUNT).desc_nulls_last(), "transaction_id", "amount", "status")
        .limit(n)
    )


def origin_counts(table: DataFrame) -> DataFrame:
    """Rows of the table by label, with the number and sum of discounts."""
    return table.groupBy(row_origin().alias("row_origin")).agg(
        F.count("*").alias("row_count"),
        F.count(DISCOUNT).alias("discounts"),
        F.coalesce(F.round(money.total(F.col(DISCOUNT)), 1), F.lit(0.0)).alias("discount_sum"),
    )


def repeated_rows(table: DataFrame, after: int) -> DataFrame:
    """Rows of later batches that were there by batch ``after``, with their copies then and since.

    Grouping takes NULLs as equal, so rows without a time or id are found too.
    """
    columns = [c for c in table.columns if c not in (BATCH, MONTH)]
    return table.groupBy(*columns).agg(
        F.count_if(F.col(BATCH) <= after).alias("held_copies"),
        F.count_if(F.col(BATCH) > after).alias("added_copies"),
    ).where((F.col("held_copies") > 0) & (F.col("added_copies") > 0))
