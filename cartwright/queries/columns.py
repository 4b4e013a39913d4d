"""Projections and scalar expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwright.functions import calendar, cleaning
from cartwright.operators import sinks
from cartwright.queries.base import query, seed_csv, store_query
from cartwright.queries.canonical import over_store
from cartwright.sources import readers, schemas
from cartwright.sources.generators import CATEGORIES
from cartwright.sources.store import table


def projected(columns: str, source: str = "transactions") -> str:
    return over_store(f"SELECT {columns} FROM {source}")


# Projections -------------------------------------------------------------------------------------

@store_query("project_columns", "P1", projected("transaction_id, category, amount"))
def project_columns(store):
    return store.transactions.select("transaction_id", "category", "amount")


@store_query("project_star", "P2", projected("*", "products"))
def project_star(store):
    return store.products.select("*")


@store_query("project_derived_column", "P3 X1", projected("*, CAST(txn_timestamp AS DATE) AS sale_date"))
def project_derived_column(store):
    return store.transactions.withColumn("sale_date", calendar.day(F.col("txn_timestamp")))


@store_query("project_cast_in_place", "P4 X2", projected(
    "* REPLACE (CAST(signup_date AS TIMESTAMP) AS signup_date)", "customers"))
def project_cast_in_place(store):
    return store.customers.withColumn("signup_date", calendar.moment(F.col("signup_date")))


@store_query("project_rename", "P5", projected("* EXCLUDE (txn_timestamp), txn_timestamp AS sold_at"))
def project_rename(store):
    return store.transactions.withColumnRenamed("txn_timestamp", "sold_at")


@store_query("project_drop", "P6", projected("* EXCLUDE (category)"))
def project_drop(store):
    return store.transactions.drop("category")


@store_query("project_alias", "P7", projected("product_id AS id, unit_price AS price", "products"))
def project_alias(store):
    return store.products.select(F.col("product_id").alias("id"), F.col("unit_price").alias("price"))


@store_query("project_named_subquery", "P8", over_store(
    "SELECT category, COUNT(*) AS n FROM cleaned GROUP BY category",
    cleaned="SELECT * FROM transactions WHERE amount > 0"))
def project_named_subquery(store):
    return store.spark.sql(
        "WITH cleaned AS (SELECT * FROM {transactions} WHERE amount > 0)"
        " SELECT category, COUNT(*) AS n FROM cleaned GROUP BY category",
        transactions=store.transactions,
    )


@store_query("project_masked_column", "P9", over_store(
    "SELECT amount FROM transactions WHERE category = '2-HIGH'"))
def project_masked_column(store):
    return store.transactions.where(F.col("category") == "2-HIGH").select("amount")


@query("project_delimited_field", "P10 S6", projected("category"))
def project_delimited_field(spark, sf_dir):
    lines = readers.read_lines(spark, seed_csv(spark, sf_dir, "transactions"))
    data = lines.where(F.col("value") != ",".join(schemas.TRANSACTIONS.names))
    return data.select(readers.field(F.col("value"), 4).alias("category"))


@store_query("project_sql_parameter", "P11", over_store(
    "SELECT transaction_id, amount FROM transactions WHERE month(txn_timestamp) = 3"))
def project_sql_parameter(store):
    return store.spark.sql(
        "SELECT transaction_id, amount FROM {transactions} WHERE month(txn_timestamp) = :month",
        args={"month": 3},
        transactions=store.transactions,
    )


# Dates and times ---------------------------------------------------------------------------------

@query("to_date", "X1", "SELECT event_id, CAST(ts AS DATE) AS day, CAST(strftime(ts, '%Y-%m-%d') AS DATE)"
       " AS day_from_text FROM events")
def to_date(spark, sf_dir):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "events").select(
        "event_id", calendar.day(F.col("ts")).alias("day"), calendar.day(text).alias("day_from_text"))


@query("text_to_timestamp", "X2", """
SELECT event_id, date_trunc('second', ts) AS parsed,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE date_trunc('second', ts) END AS mixed FROM events""")
def text_to_timestamp(spark, sf_dir):
    """Every third text of the mixed column is no timestamp and becomes NULL."""
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    mixed = F.when(F.col("event_id") % 3 == 0, F.concat(F.col("event_type"), text)).otherwise(text)
    return table(spark, sf_dir, "events").select(
        "event_id",
        calendar.moment(text).alias("parsed"),
        mixed.try_cast("timestamp_ntz").alias("mixed"),
    )


@store_query("month_of_timestamp", "X3", projected(
    "transaction_id, CAST(month(txn_timestamp) AS INTEGER) AS month"))
def month_of_timestamp(store):
    return store.transactions.select("transaction_id", F.month("txn_timestamp").alias("month"))


@store_query("month_start", "X4", projected(
    "transaction_id, CAST(date_trunc('month', txn_timestamp) AS DATE) AS month_start"))
def month_start(store):
    return store.transactions.select(
        "transaction_id", calendar.month_start(F.col("txn_timestamp")).alias("month_start"))


# Numbers and text --------------------------------------------------------------------------------

@store_query("round_digits", "X5", projected(
    "transaction_id, ROUND(amount / 6.28318::DOUBLE, 2) AS two_digits,"
    " ROUND(amount / 6.28318::DOUBLE, 1) AS one_digit"))
def round_digits(store):
    """The quotient of whole cents by this divisor never ends in an exact 5 after the last digit.

    Engines differ on such ties, because they round either the decimal text or the binary value.
    """
    quotient = F.col("amount") / F.lit(6.28318)
    return store.transactions.select(
        "transaction_id", F.round(quotient, 2).alias("two_digits"), F.round(quotient, 1).alias("one_digit"))


@store_query("upper_text", "X6", projected("customer_id, upper(country_code) AS code", "customers"))
def upper_text(store):
    return store.customers.select("customer_id", F.upper("country_code").alias("code"))


@store_query("lower_text", "X7", projected("customer_id, lower(email) AS address", "customers"))
def lower_text(store):
    return store.customers.select("customer_id", F.lower("email").alias("address"))


@store_query("trim_text", "X8", projected("customer_id, trim(email) AS address", "customers"))
def trim_text(store):
    return store.customers.select("customer_id", F.trim("email").alias("address"))


@store_query("normalised_codes", "X6 X8", projected(
    "transaction_id, upper(trim(currency)) AS currency, upper(trim(country_code)) AS country_code"))
def normalised_codes(store):
    return store.transactions.select(
        "transaction_id",
        cleaning.code(F.col("currency")).alias("currency"),
        cleaning.code(F.col("country_code")).alias("country_code"),
    )


@store_query("boolean_to_text", "X9", projected(
    "customer_id, CAST(is_deleted AS VARCHAR) AS flag", "customers"))
def boolean_to_text(store):
    return store.customers.select("customer_id", F.col("is_deleted").cast("string").alias("flag"))


@store_query("coalesce_default", "X10", projected(
    "coalesce(transaction_id, 'none') AS transaction_id, coalesce(amount, 0.0) AS amount"))
def coalesce_default(store):
    return store.transactions.select(
        F.coalesce("transaction_id", F.lit("none")).alias("transaction_id"),
        F.coalesce("amount", F.lit(0.0)).alias("amount"),
    )


@store_query("coalesce_null", "X11", projected("coalesce(amount, NULL) AS amount"))
def coalesce_null(store):
    """A NULL default changes nothing."""
    return store.transactions.select(F.coalesce("amount", F.lit(None)).alias("amount"))


@store_query("case_label", "X12 F8", projected(
    "transaction_id, CASE WHEN transaction_id IS NULL THEN 'unknown' ELSE 'known' END AS label"))
def case_label(store):
    return store.spark.sql(
        "SELECT transaction_id, CASE WHEN transaction_id IS NULL THEN 'unknown' ELSE 'known' END AS label"
        " FROM {transactions}",
        transactions=store.transactions,
    )


@store_query("when_otherwise", "X13 X15", projected(
    "transaction_id, CASE WHEN amount > 50000 THEN amount ELSE CAST(NULL AS DOUBLE) END AS large_amount"))
def when_otherwise(store):
    large = F.when(F.col("amount") > 50_000, F.col("amount")).otherwise(F.lit(None).cast("double"))
    return store.transactions.select("transaction_id", large.alias("large_amount"))


@store_query("sql_expression", "X14", projected(
    "product_id, ROUND(unit_price * 2 + 1, 1) AS adjusted", "products"))
def sql_expression(store):
    return store.products.select("product_id", F.expr("round(unit_price * 2 + 1, 1)").alias("adjusted"))


@store_query("typed_null", "X15", projected("product_id, CAST(NULL AS DOUBLE) AS discount_pct", "products"))
def typed_null(store):
    return store.products.select("product_id", F.lit(None).cast("double").alias("discount_pct"))


@query("column_arithmetic", "X18", """
SELECT l_orderkey, l_linenumber, 5.0::DOUBLE + l_discount * 10.0::DOUBLE AS shifted,
       (1 - l_discount / l_quantity) * 100 AS reduction_pct,
       l_extendedprice / l_quantity AS quotient,
       l_extendedprice / 1048576 AS megabytes,
       abs(l_discount - l_tax) < 0.01::DOUBLE AS close
FROM lineitem""")
def column_arithmetic(spark, sf_dir):
    discount, quantity, price = F.col("l_discount"), F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.lit(5.0) + discount * 10.0).alias("shifted"),
        ((1 - discount / quantity) * 100).alias("reduction_pct"),
        (price / quantity).alias("quotient"),
        (price / F.lit(1024**2)).alias("megabytes"),
        (F.abs(discount - F.col("l_tax")) < 0.01).alias("close"),
    )


@query("padded_id", "X19", "SELECT o_orderkey, printf('TXN-%08d', o_orderkey) AS transaction_id FROM orders")
def padded_id(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.format_string("TXN-%08d", "o_orderkey").alias("transaction_id"))


@query("interpolated_text", "X20", "SELECT c_custkey, 'customer' || CAST(c_custkey AS VARCHAR) ||"
       " '@shop.example' AS email FROM customer")
def interpolated_text(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("customer"), key, F.lit("@shop.example")).alias("email"))


@query("modulo_cycle", "X21", f"""
SELECT p_partkey, list_extract({CATEGORIES}, p_partkey % 5 + 1)
       AS category, p_partkey % 10 + 1 AS brand_number FROM part""")
def modulo_cycle(spark, sf_dir):
    key = F.col("p_partkey")
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.element_at(names, (key % 5 + 1).cast("int")).alias("category"),
        (key % 10 + 1).alias("brand_number"),
    )


@query("display_number", "X28", "SELECT o_orderkey, format('{:,}', o_orderkey * 1000) AS shown FROM orders")
def display_number(spark, sf_dir):
    shown = sinks.display_number(F.col("o_orderkey") * 1000)
    return table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("shown"))
