"""From documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cartwright.llm import exact_dedup, near_dedup, packing, substring_dedup, toxicity
from cartwright.llm.common import stored, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

#: No SQL: classifier, near duplicates and packing; tests compare the stages with plain versions.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, learned from the labelled ones among them, doesn't reject.

    Columns stay as they are, whatever their names; a null text is judged like an empty one, rows are judged
    one by one, and without labels or documents nothing is rejected.
    """
    return toxicity.without_toxic_documents(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One whole row for each text, that of the largest doc_id, then of the largest other columns.

    A null text equals an empty one, null doc_ids are the smallest; an empty table stays empty.
    """
    return exact_dedup.without_duplicates(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each class of near duplicates, that of the smallest doc_id; columns stay as they are.

    Texts without five words, null ones included, are alike only to copies of themselves.
    """
    return near_dedup.without_near_duplicates(docs, threshold=0.8, size=5)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without 20-word passages that occur earlier; texts that lose nothing stay as they are.

    So do all columns but text and n_chars, whatever their names. Rows without a doc_id come last; no row
    goes, a text that is repeated whole becomes empty.
    """
    return substring_dedup.without_repeats(docs, length=20)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 2048 tokens, with their ids."""
    return packing.pack(docs, TOKENIZER, capacity=2048, end_id=1)


STAGES = [
    ("toxicity", clean),
    ("exact dedup", distinct),
    ("near dedup", dissimilar),
    ("substring dedup", unrepeated),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
