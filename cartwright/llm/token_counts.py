"""Token counts of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright.llm import tokens


def token_length(path: str):
    """A column function: tokens of a text by the vocabulary file at ``path``; null counts as empty.

    Arrow batches come in, lengths alone go back. Inside a batch texts are regrouped by size
    (about a megabyte each) and long ones are cut at safe spaces, so neither many short nor a few
    very long texts make a call large. The file has to be at that path on every executor.
    """

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = tokens.encoder(path, "lengths")
        for column in batches:
            texts = (x.as_py() for x in column)
            yield pa.array([sum(map(sum, pieces)) for pieces in encoder.texts(texts)], pa.int64())

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens).

    A null or empty text has 0 bytes and 0 tokens. No begin, end or other special tokens are added;
    strings of special tokens inside a text are read as the library reads them by default. Columns
    of ``docs`` with these names are replaced; equal rows give equal rows; an empty table an empty one.
    """
    text = F.coalesce("text", F.lit(""))
    counted = docs.withColumn("n_tokens", token_length(path)(text))
    return counted.withColumn("n_bytes", F.octet_length(text).cast("long")).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
