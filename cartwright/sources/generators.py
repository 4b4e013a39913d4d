"""Synthetic store data, one row per key of an ``id`` column.

Each generator maps a DataFrame of 0-based ids to rows by expressions alone: no driver loop, no
shuffle, no state. ``ids(spark, n)`` supplies a distributed range; any table's key column does too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwright.functions import calendar, draws

# The vocabularies and proportions of the store's seed data.
CATEGORIES = ["Electronics", "Clothing", "Food", "Books", "Sports"]
CATEGORY_WEIGHTS = {"Electronics": 0.30, "Clothing": 0.25, "Food": 0.20, "Books": 0.15, "Sports": 0.10}
CURRENCY_WEIGHTS = {"USD": 0.60, "EUR": 0.15, "GBP": 0.12, "JPY": 0.08, "SGD": 0.05}
COUNTRIES = ["US", "GB", "DE", "FR", "SG"]
COUNTRY_WEIGHTS = {"US": 0.50, "GB": 0.20, "DE": 0.15, "FR": 0.10, "SG": 0.05}
STATUS_WEIGHTS = {"completed": 0.75, "cancelled": 0.15, "refunded": 0.10}
FIRST_NAMES = ["Alice", "Bob", "Carol", "David", "Eve", "Frank", "Grace", "Henry", "Iris", "Jack",
               "Karen", "Liam", "Maria", "Noah", "Olivia", "Paul", "Quinn", "Rose", "Sam", "Tina"]
LAST_NAMES = ["Smith", "Jones", "White", "Brown", "Davis", "Wilson", "Moore", "Taylor", "Anderson", "Thomas"]
TRANSACTION_ID, PRODUCT_NAME = "TXN-%08d", "Product-%03d"
FIRST_TRANSACTION, FIRST_SIGNUP = "2024-01-01 00:00:00", "2022-01-01 00:00:00"
DELETED_SHARE = REFUNDED_SHARE = 0.05
N_TRANSACTIONS, N_CUSTOMERS, N_PRODUCTS = 100_000, 5_000, 100
N_BENCHMARK_TRANSACTIONS = 5_000_000

ROWS_PER_TASK = 5_000_000


def ids(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    """Ids 0 to n - 1, in as many partitions as keep a task's rows in bounds."""
    if partitions is None:
        partitions = max(spark.sparkContext.defaultParallelism, -(-n // ROWS_PER_TASK))
    return spark.range(0, n, 1, partitions)


def _draws(table: str, salt: str):
    """The draws of a row by slot."""
    return lambda slot: draws.draw(f"{table}/{salt}", F.col("id"), slot)


def transactions(keys: DataFrame, n_customers: int = N_CUSTOMERS, n_products: int = N_PRODUCTS,
                 salt: str = "42") -> DataFrame:
    """One transaction every ten minutes."""
    draw = _draws("transactions", salt)
    return keys.select(
        F.format_string(TRANSACTION_ID, "id").alias("transaction_id"),
        draws.uniform_int(draw(0), 1, n_customers + 1).alias("customer_id"),
        draws.uniform_int(draw(1), 1, n_products + 1).alias("product_id"),
        draws.weighted_choice(draw(2), CATEGORY_WEIGHTS).alias("category"),
        draws.uniform_decimal(draw(3), 5.0, 500.0, 2).alias("amount"),
        draws.weighted_choice(draw(4), CURRENCY_WEIGHTS).alias("currency"),
        draws.weighted_choice(draw(5), COUNTRY_WEIGHTS).alias("country_code"),
        draws.weighted_choice(draw(6), STATUS_WEIGHTS).alias("status"),
        calendar.step(FIRST_TRANSACTION, F.col("id"), 600).alias("timestamp"),
    )


def customers(keys: DataFrame, domain: str = "shop.example", salt: str = "42") -> DataFrame:
    """One signup every six hours; keys and addresses count from 1."""
    draw = _draws("customers", salt)
    number = F.col("id") + 1
    return keys.select(
        number.alias("customer_id"),
        F.concat(F.lit("customer"), number.cast("string"), F.lit(f"@{domain}")).alias("email"),
        draws.choice(draw(0), FIRST_NAMES).alias("first_name"),
        draws.choice(draw(1), LAST_NAMES).alias("last_name"),
        calendar.day(calendar.step(FIRST_SIGNUP, F.col("id"), 21_600)).alias("signup_date"),
        draws.weighted_choice(draw(2), COUNTRY_WEIGHTS).alias("country_code"),
        draws.below(draw(3), DELETED_SHARE).alias("is_deleted"),
    )


def products(keys: DataFrame, salt: str = "42") -> DataFrame:
    """Categories and brands in rotation."""
    draw = _draws("products", salt)
    number = F.col("id") + 1
    position = (F.col("id") % len(CATEGORIES) + 1).cast("int")
    return keys.select(
        number.alias("product_id"),
        F.format_string(PRODUCT_NAME, number).alias("product_name"),
        F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), position).alias("category"),
        F.concat(F.lit("Brand-"), (F.col("id") % 10 + 1).cast("string")).alias("brand"),
        draws.uniform_decimal(draw(0), 5.0, 500.0, 2).alias("unit_price"),
    )


def benchmark_transactions(keys: DataFrame, salt: str = "42") -> DataFrame:
    """The wider-keyed table of the format benchmark, one transaction per second."""
    draw = _draws("benchmark", salt)
    return keys.select(
        F.format_string(TRANSACTION_ID, "id").alias("transaction_id"),
        draws.uniform_int(draw(0), 1, 100_000).alias("customer_id"),
        draws.uniform_int(draw(1), 1, 5_000).alias("product_id"),
        draws.uniform_decimal(draw(2), 1.0, 500.0, 2).alias("amount"),
        draws.choice(draw(3), CATEGORIES).alias("category"),
        draws.choice(draw(4), COUNTRIES).alias("country_code"),
        calendar.step(FIRST_TRANSACTION, F.col("id"), 1).alias("timestamp"),
        draws.below(draw(5), REFUNDED_SHARE).alias("is_refunded"),
    )
