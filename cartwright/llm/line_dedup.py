"""Removal of lines that another document holds, against levelled sorted runs of line hashes."""

from __future__ import annotations

from collections.abc import Iterator
from struct import pack
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh3_128_digest

from cartwright.llm.common import packed, unpacked, work_folder

KEY = ["h1", "h2"]
_SPACE = b" \t\n\x0b\x0c\r"


def _digest(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of a line's key; None if the key is too short to be judged."""
    key = line.strip(_SPACE).lower()  # bytes: A-Z alone
    if len(key) < min_chars or len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxh3_128_digest(key)


def _line_keys(min_chars: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = [], []
            for doc_id, text in zip(batch["id"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
                found = {_digest(line, min_chars) for line in (text.as_py() or b"").split(b"\n")} - {None}
                ids += [doc_id] * len(found)
                digests += found
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(ids, pa.int64())],
                names=[*KEY, "id"],
            )

    return keys


def _rewrite(min_chars: int):
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, gone, kept = [], [], []
            for text, drop in zip(batch["text"].cast(pa.binary()), batch["dropped"], strict=True):
                lines = (text.as_py() or b"").split(b"\n")
                drop = {pack("<2q", x["h1"], x["h2"]) for x in drop.as_py() or ()}
                left = [x for x in lines if _digest(x, min_chars) not in drop] if drop else lines
                totals.append(len(lines))
                gone.append(len(lines) - len(left))
                kept.append(b"\n".join(left))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["rest"], batch["text"], pa.array(totals, pa.int64()), pa.array(gone, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["rest", "text", "n_lines", "n_dropped", "kept_text"],
            )

    return rewrite


class Runs:
    """Sorted runs of line hashes with the document that holds each, in levels.

    A run is a table of the shared folder, bucketed and sorted by hash, so a batch that is
    partitioned by hash once merges with all of them in place. No hash is in two runs. ``fan_in``
    runs of one level are compacted into one of the next; a hash is thus rewritten once per level.
    """

    def __init__(self, spark: SparkSession, buckets: int, fan_in: int):
        self.spark, self.buckets, self.fan_in = spark, buckets, fan_in
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"cartwright_line_run_{uuid4().hex}"
        (
            rows.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
            .option("path", f"{work_folder(self.spark)}/{name}").saveAsTable(name)
        )
        return name

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Rows of ``keys`` whose hash no run holds, by one merge anti-join per run."""
        for name in (n for level in self.levels for n in level):
            keys = keys.join(self.spark.table(name).select(*KEY).hint("merge"), KEY, "left_anti")
        return keys

    def add(self, keys: DataFrame) -> DataFrame:
        """Adds a run of unseen keys, compacts full levels, returns the run."""
        new = self._write(keys)
        at, run = 0, new
        while True:
            if at == len(self.levels):
                self.levels.append([])
            self.levels[at].append(run)
            if len(self.levels[at]) < self.fan_in:
                return self.spark.table(new)
            merged = self.spark.table(self.levels[at][0])
            for name in self.levels[at][1:]:
                merged = merged.unionByName(self.spark.table(name))
            run = self._write(merged)
            self.levels[at] = []
            at += 1


def _batch_number(docs: DataFrame, batches: int) -> tuple[Column, int]:
    """The batch of a row with an ``id``: ranges of doc_id with about as many documents each."""
    cuts = docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    cuts = sorted({int(c) for c in cuts})
    number = F.lit(0)
    for c in cuts:
        number = number + (F.col("id") > c).cast("int")
    return number, len(cuts) + 1


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = 10, batches: int = 4, fan_in: int = 2
) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text.

    Texts are split at ``\\n``; a null or empty text is one empty line. A line's key is the line
    without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z in lower case. A line whose key has at
    least ``min_chars`` code points goes unless its document has the smallest doc_id that holds the
    key; the holder keeps all its lines with it. The rest is joined by ``\\n``.

    Rows of one doc_id are one document. A null doc_id comes last, by a hash of the text. Columns of
    ``docs`` named like a new one are replaced; an empty table gives an empty one.

    Documents come in ``batches`` by rising doc_id. Each batch takes the smallest doc_id of its keys
    (combined before the shuffle), anti-joins it with the runs of earlier batches and adds what is
    left as a run of its own. Keys are 128-bit hashes. The texts are shuffled once, to meet the list
    of their own dropped lines.
    """
    spark = docs.sparkSession
    keyed = packed(docs)
    number, n = _batch_number(docs, batches)
    folder = f"{work_folder(spark)}/lines-{uuid4().hex}"
    lines = keyed.select("id", "text").mapInArrow(_line_keys(min_chars), "h1 long, h2 long, id long")
    lines.withColumn("batch", number).write.partitionBy("batch").parquet(folder)
    stored = spark.read.schema("h1 long, h2 long, id long, batch int").parquet(folder)
    runs = Runs(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), fan_in)
    dropped = None
    for b in range(n):
        batch = stored.filter(F.col("batch") == b).drop("batch")
        held = runs.add(runs.unseen(batch.groupBy(*KEY).agg(F.min("id").alias("id"))))
        more = batch.join(held, [*KEY, "id"], "left_anti")
        dropped = more if dropped is None else dropped.unionByName(more)
    lists = dropped.groupBy("id").agg(F.collect_set(F.struct(*KEY)).alias("dropped"))
    schema = StructType([keyed.schema["rest"], keyed.schema["text"]])
    for name, kind in (("n_lines", "long"), ("n_dropped", "long"), ("kept_text", "string")):
        schema = schema.add(name, kind)
    out = keyed.join(lists, "id", "left").select("rest", "text", "dropped")
    return unpacked(
        out.mapInArrow(_rewrite(min_chars), schema), docs.columns, ["n_lines", "n_dropped", "kept_text"]
    )
