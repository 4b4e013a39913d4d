"""The store's three tables over the TPC-H-like test tables.

A folder of ``lineitem``, ``orders``, ``customer``, ``nation``, ``region`` and ``part`` is seen as
transactions, customers and products. NULLs, zero amounts, unmatched products, padded lower-case
codes and soft deletes are derived from existing columns, so that cleaning has something to clean.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Declared, so that reading a table starts no job to look up its schema.
TEST_TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
        " p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
        " o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
        " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
        " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double,"
        " props string"
    ),
}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TEST_TABLES[name]).parquet(table_path(sf_dir, name))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item.

    Country and region names are joined to customers and those to orders before the line items are
    touched, so the largest table is shuffled once, on the order key. Both sides of that join grow
    with the data, so it is a sort-merge join, whose skewed partitions are split at run time.
    Without the hint Spark, which takes the size of a join's result for the product of its inputs,
    would broadcast the line items whenever they are below its threshold. In the other joins no
    side is forced: Spark broadcasts where its own size check allows.
    """
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey",
        F.concat(F.lit(" "), F.lower("r_name")).alias("currency"),
        F.concat(F.lower("n_name"), F.lit(" ")).alias("country_code"),
    )
    buyers = (
        table(spark, sf_dir, "customer")
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "currency", "country_code")
    )
    order_status = (
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", "cancelled")
        .otherwise("refunded")
    )
    sales = (
        table(spark, sf_dir, "orders")
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "o_orderkey",
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderpriority").alias("category"),
            "currency",
            "country_code",
            order_status.alias("status"),
        )
    )
    quantity = F.col("l_quantity")
    line_key = F.concat(
        F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")
    )
    return (
        table(spark, sf_dir, "lineitem")
        .join(sales.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.when(quantity == 4, None).otherwise(line_key).alias("transaction_id"),
            "customer_id",
            F.when(quantity == 3, F.lit(-1)).otherwise(F.col("l_partkey")).alias("product_id"),
            "category",
            F.when(quantity == 1, None)
            .when(quantity == 2, F.lit(0.0))
            .otherwise(F.col("l_extendedprice"))
            .alias("amount"),
            "currency",
            "country_code",
            "status",
            F.col("l_shipdate").alias("txn_timestamp"),
        )
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.split("c_name", "#")
    key = F.col("c_custkey")
    return (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            key.alias("customer_id"),
            F.concat(F.lit(" "), "c_name", F.lit("@Shop.Example ")).alias("email"),
            name[0].alias("first_name"),
            name[1].alias("last_name"),
            F.date_add(F.lit("2022-01-01").cast("date"), (key % 1250).cast("int"))
            .cast("string")
            .alias("signup_date"),
            F.concat(F.lower("n_name"), F.lit(" ")).alias("country_code"),
            F.when(key % 100 == 0, None).otherwise(F.col("c_acctbal") < 0).alias("is_deleted"),
        )
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("unit_price"),
    )


@dataclass(frozen=True)
class Store:
    """The three tables of one folder. Each DataFrame is built once; it is lazy and can be reused."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def transactions(self) -> DataFrame:
        return transactions(self.spark, self.sf_dir)

    @cached_property
    def customers(self) -> DataFrame:
        return customers(self.spark, self.sf_dir)

    @cached_property
    def products(self) -> DataFrame:
        return products(self.spark, self.sf_dir)

    @property
    def seed_tables(self) -> dict[str, DataFrame]:
        """The three tables as a seed folder stores them: the time column is ``timestamp``."""
        return {
            "transactions": self.transactions.withColumnRenamed("txn_timestamp", "timestamp"),
            "customers": self.customers,
            "products": self.products,
        }
