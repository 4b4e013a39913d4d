"""Sources: each reads a whole table through one kind of scan."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructField, StructType

from cartwright.operators import sinks
from cartwright.plans import storage
from cartwright.queries.base import (
    prepared,
    query,
    seed_csv,
    source_id,
    tables,
    transactions_parquet,
)
from cartwright.queries.canonical import over_store
from cartwright.sources import readers, schemas
from cartwright.sources.store import table, table_path

SEED_TRANSACTIONS = over_store("SELECT * EXCLUDE (txn_timestamp), txn_timestamp AS timestamp FROM transactions")


@query("scan_parquet", "S1", "SELECT * FROM lineitem")
def scan_parquet(spark, sf_dir):
    return readers.read_parquet(spark, table_path(sf_dir, "lineitem"))


@query("scan_parquet_columns", "S2 P1", "SELECT o_orderstatus, o_orderpriority, o_totalprice FROM orders")
def scan_parquet_columns(spark, sf_dir):
    columns = ["o_orderstatus", "o_orderpriority", "o_totalprice"]
    return readers.read_parquet(spark, table_path(sf_dir, "orders"), columns)


@query("scan_parquet_sql", "S3 P2", "SELECT * FROM orders")
def scan_parquet_sql(spark, sf_dir):
    return readers.read_parquet_sql(spark, table_path(sf_dir, "orders"))


@query("scan_csv_declared", "S4 K1", SEED_TRANSACTIONS)
def scan_csv_declared(spark, sf_dir):
    path = seed_csv(spark, sf_dir, "transactions")
    return readers.read_csv(spark, path, schemas.TRANSACTIONS)


@query("scan_csv_inferred", "S5", over_store(
    "SELECT product_id, product_name, category, brand, unit_price FROM products"))
def scan_csv_inferred(spark, sf_dir):
    inferred = readers.read_csv_inferred(spark, seed_csv(spark, sf_dir, "products"))
    # Detection picks the narrowest integer type, which depends on the data.
    return inferred.withColumn("product_id", F.col("product_id").cast("bigint"))


@query("scan_lines", "S6", over_store("SELECT CAST(customer_id AS VARCHAR) AS value FROM customers"))
def scan_lines(spark, sf_dir):
    lines = readers.read_lines(spark, seed_csv(spark, sf_dir, "customers"))
    data = lines.where(F.col("value") != ",".join(schemas.CUSTOMERS.names))
    return data.select(readers.field(F.col("value"), 1).alias("value"))


@query("scan_catalog_table", "S7 K7", over_store("SELECT * FROM customers"))
def scan_catalog_table(spark, sf_dir):
    name = prepared(spark, sf_dir, "catalog_table", lambda folder: sinks.create_table_as(
        tables(spark, sf_dir).customers, f"store_customers_{source_id(sf_dir)}", folder))
    return spark.table(name)


@query("scan_declared_source", "S10 K11", "SELECT * FROM supplier")
def scan_declared_source(spark, sf_dir):
    return readers.source(spark, table_path(sf_dir, "supplier"), f"source_supplier_{source_id(sf_dir)}")


@query("scan_stored_transactions", "S1 P5 X2", over_store("SELECT * FROM transactions"))
def scan_stored_transactions(spark, sf_dir):
    """A stored table whose time column is text under another name, renamed and cast on reading."""
    def build(folder):
        as_text = F.date_format("txn_timestamp", readers.TIMESTAMP_FORMAT)
        stored = spark.read.parquet(transactions_parquet(spark, sf_dir))
        return sinks.write_parquet(
            stored.withColumn("timestamp", as_text).drop("txn_timestamp"), folder)

    return readers.seed_transactions(spark, prepared(spark, sf_dir, "text_timestamps", build))


# Lines of a CSV of line items, some of them broken: a word for a number, fields missing or to spare, no date.
BROKEN = (5, 6, 7, 8)
LINES = StructType([
    StructField("line_id", StringType()), StructField("part_key", LongType()),
    StructField("price", DoubleType()), StructField("ship_date", DateType()),
])
HEAD_SQL = "CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || ',' || CAST(l_partkey AS VARCHAR)"
PRICE_SQL = "CAST(l_extendedprice AS VARCHAR)"
DAY_SQL = "CAST(CAST(l_shipdate AS DATE) AS VARCHAR)"
MALFORMED_SQL = f"""
SELECT CASE l_quantity WHEN 5 THEN {HEAD_SQL} || ',n/a,' || {DAY_SQL} WHEN 6 THEN {HEAD_SQL}
            WHEN 7 THEN {HEAD_SQL} || ',' || {PRICE_SQL} || ',' || {DAY_SQL} || ',spare'
            ELSE {HEAD_SQL} || ',' || {PRICE_SQL} || ',1997-13-45' END AS malformed_line
FROM lineitem WHERE l_quantity IN {BROKEN}"""


def parted_lines(spark, sf_dir):
    def write(folder):
        lines, quantity = table(spark, sf_dir, "lineitem"), F.col("l_quantity")
        start = F.concat_ws(",", F.concat_ws("-", "l_orderkey", "l_linenumber"), "l_partkey")
        day, price = F.to_date("l_shipdate"), F.col("l_extendedprice")
        text = (
            F.when(quantity == 5, F.concat_ws(",", start, F.lit("n/a"), day))
            .when(quantity == 6, start)
            .when(quantity == 7, F.concat_ws(",", start, price, day, F.lit("spare")))
            .when(quantity == 8, F.concat_ws(",", start, price, F.lit("1997-13-45")))
            .otherwise(F.concat_ws(",", start, price, day))
        )
        # whole lines: with another separator the writer has nothing to quote
        writer = lines.select(text.alias(",".join(LINES.names))).write.mode("overwrite").option("header", True)
        writer.option("sep", "\u0001").csv(f"{folder}/csv")
        return storage.part_csv(spark, f"{folder}/csv", f"{folder}/parted", LINES)

    return prepared(spark, sf_dir, "parted_lines", write)


@query("scan_csv_permissive", "S4 S5", f"""
SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS line_id, l_partkey AS part_key,
       l_extendedprice AS price, CAST(l_shipdate AS DATE) AS ship_date
FROM lineitem WHERE l_quantity NOT IN {BROKEN}""")
def scan_csv_permissive(spark, sf_dir):
    """The good rows of a CSV with broken lines."""
    return parted_lines(spark, sf_dir).good


@query("scan_csv_malformed", "S4 S6", MALFORMED_SQL)
def scan_csv_malformed(spark, sf_dir):
    """Its broken lines, as they stand in the files."""
    return parted_lines(spark, sf_dir).malformed.select("malformed_line")


@query("csv_line_counts", "S4 K13 A12", f"""
SELECT 'good' AS part, CAST(COUNT_IF(l_quantity NOT IN {BROKEN}) AS BIGINT) AS row_count FROM lineitem
UNION ALL SELECT 'malformed', CAST(COUNT_IF(l_quantity IN {BROKEN}) AS BIGINT) FROM lineitem""")
def csv_line_counts(spark, sf_dir):
    """How many of each there were, counted while they were parted."""
    parted = parted_lines(spark, sf_dir)
    counts = {"good": parted.good_rows, "malformed": parted.malformed_rows}
    return sinks.named_values(spark, counts, "part", "row_count")


@query("scan_mixed_schemas", "S1 K10", """
SELECT p_partkey AS product_id, CAST(p_size AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS brand,
       CAST(NULL AS DOUBLE) AS price FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, p_partkey * 3000000000, p_brand, p_retailprice FROM part WHERE p_partkey % 2 = 1""")
def scan_mixed_schemas(spark, sf_dir):
    """Two writes of one table: the later one has wider sizes and two columns more."""
    def build(folder):
        part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
        early = part.where(key % 2 == 0).select(key.alias("product_id"), F.col("p_size").alias("size"))
        late = part.where(key % 2 == 1).select(
            key.alias("product_id"), (key * 3_000_000_000).alias("size"), F.col("p_brand").alias("brand"),
            F.col("p_retailprice").alias("price"))
        return [sinks.write_parquet(early, f"{folder}/early"), sinks.write_parquet(late, f"{folder}/late")]

    return readers.read_mixed(spark, prepared(spark, sf_dir, "mixed_schemas", build))
