"""Registry of queries, and tables that several of them share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from hashlib import sha1
from os.path import abspath
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from cartwright.operators import sinks
from cartwright.plans import history
from cartwright.session import scratch_dir
from cartwright.sources.store import Store

QUERIES: dict[str, Query] = {}
_prepared: dict[tuple[str, str, str], Any] = {}
_stores: dict[tuple[str, str], Store] = {}


@dataclass(frozen=True)
class Query:

    name: str
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def query(name: str, covers: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir); with ``sql`` the result is checked against it."""

    def register(run):
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = Query(name, covers, run, sql)
        return run

    return register


def tables(spark: SparkSession, sf_dir: str) -> Store:
    """The store tables of a folder, one set per application."""
    key = (spark.conf.get("spark.app.id"), abspath(sf_dir))
    if key not in _stores:
        _stores[key] = Store(spark, sf_dir)
    return _stores[key]


def store_query(name: str, covers: str, sql: str | None = None):
    """The same for a function of the three store tables."""

    def register(run):
        query(name, covers, sql)(lambda spark, sf_dir: run(tables(spark, sf_dir)))
        return run

    return register


def source_id(sf_dir: str) -> str:
    """Short name of a source folder, for paths and catalog names."""
    return sha1(abspath(sf_dir).encode()).hexdigest()[:10]


def prepared(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], Any]) -> Any:
    """Result of ``build(folder)``, written once per application and source folder.

    What is written is never replaced, so a DataFrame over it stays readable.
    """
    key = (spark.conf.get("spark.app.id"), abspath(sf_dir), name)
    if key not in _prepared:
        _prepared[key] = build(scratch_dir(spark, source_id(sf_dir), name))
    return _prepared[key]


#: Parts of the transactions CSV, so that its header lines can be stated beforehand.
TRANSACTIONS_PARTS = 8


def seed_csv(spark: SparkSession, sf_dir: str, name: str) -> str:
    """One of the store tables as a CSV folder.

    Products are ranged by key, so that the first file starts with the smallest keys.
    """
    def build(folder: str) -> str:
        table = tables(spark, sf_dir).seed_tables[name]
        if name == "products":
            table = table.repartitionByRange("product_id").sortWithinPartitions("product_id")
        return sinks.write_csv(table, folder)

    return prepared(spark, sf_dir, f"seed_csv_{name}", build)


def transactions_parquet(spark: SparkSession, sf_dir: str) -> str:
    """The store's transactions as one stored table, the form every plan expects."""
    return prepared(
        spark, sf_dir, "transactions_parquet",
        lambda folder: sinks.write_parquet(tables(spark, sf_dir).transactions, folder, "zstd"),
    )


def stored_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(transactions_parquet(spark, sf_dir))


def table_name(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A catalog name of this application and source folder."""
    app = "".join(c if c.isalnum() else "_" for c in spark.conf.get("spark.app.id"))
    return f"{name}_{source_id(sf_dir)}_{app}"


#: When the log says the four batches were loaded: at the end of their month.
LOAD_TIMES = {month: datetime(2024, month, 28, 18) for month in (1, 2, 3, 4)}


def history_name(spark: SparkSession, sf_dir: str, promotion_rows: int | None = None) -> str:
    """January to March, a new column, and April with discounts: all of it, or a sample."""
    name = "history" if promotion_rows is None else f"history_{promotion_rows}"
    return prepared(
        spark, sf_dir, name,
        lambda folder: history.load_history(
            spark, stored_transactions(spark, sf_dir), table_name(spark, sf_dir, name), folder, promotion_rows, LOAD_TIMES
        ),
    )


def history_table(spark: SparkSession, sf_dir: str, promotion_rows: int | None = None) -> DataFrame:
    return spark.table(history_name(spark, sf_dir, promotion_rows))
