"""Exact deduplication of documents in three combining steps, none of which gathers a hot group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwright.llm.common import stored

#: Salts of a digest: a text that a third of all tasks hold is merged by this many tasks, then by one.
SALTS = 32


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _digested(docs: DataFrame, keep: list[Column]) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(text.alias("text"), _digest(text).alias("text_sha256"), *keep)


def _combined(rows: DataFrame, best: Column, salts: int) -> DataFrame:
    """One row per text: text_sha256, text, best (the largest) and group_size.

    1. Each task merges the equal texts it reads (Spark combines before it shuffles).
    2. Their winners meet by digest and salt; the salt is the number of the task, so a text goes to
       at most ``salts`` tasks, and each receives a winner of a text at most once per reading task.
    3. The salt winners of a digest, ``salts`` at most, are merged.

    Every step groups by digest and whole text, so texts that share a digest stay apart.
    """
    salted = (
        rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("text_sha256", "salt", "text")
        .agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("n"))
    )
    return salted.groupBy("text_sha256", "text").agg(
        F.max("best").alias("best"), F.sum("n").alias("group_size")
    )


def duplicate_ledger(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty. keep_id is the largest doc_id of
    the equal texts (null if they have none), group_size their number of rows. Where that doc_id has
    several rows with the text, one is kept. Rows find their group by digest if all three steps saw
    one text with it, and by the text itself if they saw several. Other columns of ``docs`` are left out. An empty table
    gives an empty one.
    """
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    rows = _digested(docs, [doc_id])
    groups = _combined(rows, F.col("doc_id"), salts).withColumnRenamed("best", "keep_id")
    by_digest = stored(
        groups.groupBy("text_sha256").agg(
            F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"),
            F.max("group_size").alias("group_size"),
        ),
        "digests",
    )
    found = (
        rows.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("rows"))
        .join(by_digest.filter("texts = 1").drop("texts"), "text_sha256")
    )
    shared = by_digest.filter("texts > 1").select("text_sha256")
    if not shared.isEmpty():
        found = found.unionByName(
            rows.join(shared, "text_sha256", "left_semi")
            .groupBy("doc_id", "text_sha256", "text").agg(F.count(F.lit(1)).alias("rows"))
            .join(groups.join(shared, "text_sha256", "left_semi"), ["text_sha256", "text"])
            .drop("text")
        )
    twin = F.explode(F.sequence(F.lit(1), F.col("rows")))
    return found.select(
        "doc_id", "keep_id", "group_size", "text_sha256", twin.alias("twin")
    ).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("twin") == 1)).alias("kept"),
        "text_sha256",
    )


def without_duplicates(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """``docs`` with one whole row for each text: that of the largest doc_id, then of the largest
    other columns in their order. Map columns can't be ordered, so such tables are refused by Spark.
    """
    rest = [c for c in docs.columns if c.lower() not in ("doc_id", "text")]
    whole = F.struct(
        F.col("doc_id").alias("doc_id"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)],
        F.col("text").isNotNull().alias("has_text"),
    ).alias("whole")
    best = _combined(_digested(docs, [whole]), F.col("whole"), salts)
    values = {c: F.col("best")[f"c{i}"] for i, c in enumerate(rest)}
    values |= {
        c: F.col("best")["doc_id"] if c.lower() == "doc_id" else F.when(F.col("best")["has_text"], F.col("text"))
        for c in docs.columns if c not in rest
    }
    return best.select(*[values[c].alias(c) for c in docs.columns])
