"""File, text and catalog readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def read_parquet_sql(spark: SparkSession, path: str) -> DataFrame:
    """The same scan, named inside SQL text."""
    quoted = path.replace("`", "``")
    return spark.sql(f"SELECT * FROM parquet.`{quoted}`")


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header and declared types: one pass, and malformed numbers stop the job."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "FAILFAST")
        .option("timestampNTZFormat", TIMESTAMP_FORMAT)
        .csv(path)
    )


#: Column of the lines that a permissive read could not parse; NULL for the others.
MALFORMED = "malformed_line"


def read_csv_permissive(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header and declared types, every line of it: one whose fields don't parse, or are too few
    or too many, has the whole line in ``malformed_line``, and NULL for what could not be read.

    Every column is parsed whatever is selected, so that a line's verdict doesn't hang on the query.
    """
    return (
        spark.read.schema(StructType([*schema.fields, StructField(MALFORMED, StringType())]))
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", MALFORMED)
        .option("columnPruning", False)
        .option("timestampNTZFormat", TIMESTAMP_FORMAT)
        .csv(path)
    )


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV with detected types, for exploration only: detection is an extra pass over the files."""
    return (
        spark.read.option("header", True)
        .option("inferSchema", True)
        .option("preferDate", True)
        .option("timestampNTZFormat", TIMESTAMP_FORMAT)
        .csv(path)
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines, header lines included."""
    return spark.read.text(path)


def field(line, position: int, separator: str = ","):
    """The ``position``-th field (from 1) of a delimited line."""
    return F.split(line, separator)[position - 1]


def source(spark: SparkSession, path: str, name: str) -> DataFrame:
    """An external table, declared once under a name that SQL can use."""
    spark.read.parquet(path).createOrReplaceTempView(name)
    return spark.table(name)


def seed_transactions(spark: SparkSession, path: str) -> DataFrame:
    """A stored transactions table with its time column under the name the plans use.

    The column may be stored as text or as a timestamp.
    """
    return (
        spark.read.parquet(path)
        .withColumnRenamed("timestamp", "txn_timestamp")
        .withColumn("txn_timestamp", F.col("txn_timestamp").cast("timestamp_ntz"))
    )


#: Wider of two types, for those that Parquet files can be read as without rewriting them.
_WIDER = {
    ("int", "bigint"): "bigint", ("float", "double"): "double", ("int", "double"): "double",
    ("date", "timestamp_ntz"): "timestamp_ntz", ("smallint", "int"): "int", ("smallint", "bigint"): "bigint",
    ("tinyint", "int"): "int", ("tinyint", "bigint"): "bigint", ("tinyint", "smallint"): "smallint",
}


def merged_schema(schemas: list[StructType]) -> StructType:
    """Every column of any of the schemas, in the order of first sight, with the widest of its types.

    Names are compared without case. Types without a common one are an error that names the column.
    """
    found: dict[str, StructField] = {}
    for field in (f for schema in schemas for f in schema.fields):
        held = found.setdefault(field.name.lower(), StructField(field.name, field.dataType, True))
        pair = (held.dataType.simpleString(), field.dataType.simpleString())
        wide = pair[0] if pair[0] == pair[1] else _WIDER.get(pair) or _WIDER.get(pair[::-1])
        if wide is None:
            raise ValueError(f"column {field.name} is both {pair[0]} and {pair[1]}")
        if wide == pair[1]:
            found[field.name.lower()] = StructField(held.name, field.dataType, True)
    return StructType(list(found.values()))


def read_mixed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet folders written at different times with different columns, as one table without a catalog.

    Columns that a folder lacks are NULL there, narrower numbers are widened while they are read. One
    footer of each folder tells its schema; files of one folder are taken to be alike.
    """
    schema = merged_schema([spark.read.parquet(path).schema for path in paths])
    return spark.read.schema(schema).parquet(*paths)
