"""Tables of a run, and the shared folder that intermediate tables go to."""

from __future__ import annotations

from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the warehouse if that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/cartwright-llm"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{what}-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The doc_id; for a null one, a number above 2**62 from a hash of the text, so that such rows
    come last and spread over all tasks."""
    hashed = F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    return F.coalesce(F.col(doc_id).cast("long"), hashed)


def packed(docs: DataFrame) -> DataFrame:
    """id (see ``row_key``), text, and all other columns as the struct rest."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]
    return docs.select(row_key().alias("id"), "text", F.struct(*rest).alias("rest"))


def unpacked(rows: DataFrame, columns: list[str], added: list[str]) -> DataFrame:
    """The ``columns`` a table had before ``packed``, then ``added``, which replace those of the same name."""
    new = {a.lower() for a in added}
    own = [F.col("text") if c.lower() == "text" else F.col("rest")[c].alias(c) for c in columns if c.lower() not in new]
    return rows.select(*own, *added)


_worker_tables: dict[str, dict] = {}


def worker_tables(owner: str) -> dict:
    """What a Python worker keeps from task to task for one operator.

    Spark uses its workers for one operator after another. Whoever asks here first drops the tables of the
    others, so a worker holds those of one operator at a time.
    """
    if _worker_tables.keys() - {owner}:
        _worker_tables.clear()
        pa.default_memory_pool().release_unused()
    return _worker_tables.setdefault(owner, {})
