"""Summaries kept up to date batch by batch.

For each summary a table holds partial sums by batch: whole units and millionths of amounts, counts, first
and last days, all of which can be merged without a rounding in between. A new batch adds its partials and a
replaced one replaces them; either way only that batch is read. The summary is merged from the partials when
it is read, so there is nothing that could be out of date after a failed load, and the summary as of an
earlier batch is a partition filter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwright.functions import calendar, money
from cartwright.plans import staging

BATCH = "batch_id"


@dataclass(frozen=True)
class Summary:
    """What a batch of transactions adds to a summary, and how partials become its rows.

    ``rows`` gives the columns of ``group`` and the measures; ``sums`` are added up, of ``firsts`` and
    ``lasts`` the smallest and largest count, in a batch as well as over batches.
    """

    rows: Callable[[DataFrame], DataFrame]
    group: tuple[str, ...]
    sums: tuple[str, ...]
    finished: Callable[[DataFrame], DataFrame]
    firsts: tuple[str, ...] = ()
    lasts: tuple[str, ...] = ()

    def combined(self, rows: DataFrame) -> DataFrame:
        kinds = ((F.sum, self.sums), (F.min, self.firsts), (F.max, self.lasts))
        return rows.groupBy(*self.group).agg(*[kind(c).alias(c) for kind, names in kinds for c in names])

    def partials(self, batch: DataFrame) -> DataFrame:
        return self.combined(self.rows(batch))


def _parts(amount="amount") -> dict:
    return {"units": money.whole(F.col(amount)), "parts": money.millionths(F.col(amount))}


def _one(column: str):
    """1 for a row whose column has a value."""
    return F.col(column).isNotNull().cast("bigint")


def _amount():
    return money.from_parts(F.col("units"), F.col("parts"))


def _category_country(batch: DataFrame) -> DataFrame:
    return batch.where((F.col("status") == "completed") & F.col("amount").isNotNull()).withColumns(
        _parts() | {"orders": _one("transaction_id")}
    )


def _daily(batch: DataFrame) -> DataFrame:
    kept = F.col("transaction_id").isNotNull() & (money.known(F.col("amount")) > 0)
    return batch.where(kept).withColumns(
        _parts() | {"sale_date": calendar.day(F.col("txn_timestamp")), "orders": F.lit(1).cast("bigint")}
    )


def _staged(batch: DataFrame) -> DataFrame:
    return staging.stg_transactions(batch).withColumns(
        _parts() | {"sale_date": F.col("txn_date"), "orders": _one("transaction_id")}
    )


_SUMS = ("units", "parts", "orders")

CATEGORY_COUNTRY = Summary(
    _category_country, ("category", "country_code"), _SUMS,
    lambda sums: sums.select(
        "category", "country_code", F.round(_amount(), 2).alias("total_revenue"), F.col("orders").alias("order_count")
    ),
)
DAILY = Summary(
    _daily, ("sale_date", "category"), _SUMS,
    lambda sums: sums.select("sale_date", "category", _amount().alias("total_revenue"), F.col("orders").alias("tx_count")),
)
DAILY_REVENUE = Summary(
    _staged, ("sale_date", "category", "country_code"), _SUMS,
    lambda sums: sums.select(
        "sale_date", "category", "country_code", F.col("orders").alias("order_count"),
        F.round(_amount(), 2).alias("gross_revenue"),
    ),
)
CUSTOMER_ORDERS = Summary(
    lambda batch: _staged(batch).withColumns({"first_day": F.col("sale_date"), "last_day": F.col("sale_date")}),
    ("customer_id",), _SUMS,
    lambda sums: sums.select(
        "customer_id", F.col("first_day").alias("first_order_date"), F.col("last_day").alias("most_recent_order_date"),
        F.col("orders").alias("number_of_orders"), F.round(_amount(), 2).alias("lifetime_value"),
    ),
    firsts=("first_day",), lasts=("last_day",),
)


def load_partials(spark: SparkSession, summary: Summary, name: str, path: str, batch: DataFrame,
                  batch_id: int) -> str:
    """Adds a batch to the partials table ``name``, which is made at ``path`` if there is none.

    A batch of that number is replaced, the others are not read. The whole partition is written, so
    a load that failed is simply done again.
    """
    partials = summary.partials(batch)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in partials.schema.fields)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}, {BATCH} INT) USING parquet"
        f" PARTITIONED BY ({BATCH}) LOCATION '{path}'"
    )
    view = f"partials_{int(batch_id)}_of_{name.replace('.', '_')}"
    partials.createOrReplaceTempView(view)
    spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION ({BATCH} = {int(batch_id)}) SELECT * FROM {view}")
    spark.catalog.dropTempView(view)
    return name


def merged(summary: Summary, partials: DataFrame, through: int | None = None) -> DataFrame:
    """The summary over all batches of a partials table, or over those up to ``through``.

    Partials are combined in each task before they are shuffled, so a group that every batch has is one row
    per task there.
    """
    held = partials if through is None else partials.where(F.col(BATCH) <= through)
    return summary.finished(summary.combined(held))
