"""Declarative column rules. A rule's rows are its violations; no rows means it holds."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_violations(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, with how often. NULLs are not compared.

    Counts are combined before the shuffle, so a value that fills a third of the table costs one
    row per task.
    """
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count("*").alias("copies"))
        .where(F.col("copies") > 1)
    )


def not_null_violations(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def accepted_values_violations(df: DataFrame, column: str, accepted: Sequence[str]) -> DataFrame:
    """Values outside the list, with how often. NULL passes."""
    return (
        df.where(~F.col(column).isin(list(accepted)))
        .groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("copies"))
    )


@dataclass(frozen=True)
class Rule:
    model: str
    column: str
    kind: str
    accepted: tuple[str, ...] = ()

    def violations(self, df: DataFrame) -> DataFrame:
        if self.kind == "unique":
            return unique_violations(df, self.column)
        if self.kind == "not_null":
            return not_null_violations(df, self.column)
        if self.kind == "accepted_values":
            return accepted_values_violations(df, self.column, self.accepted)
        raise ValueError(f"unknown rule kind {self.kind!r}")


def unique(model: str, column: str) -> Rule:
    return Rule(model, column, "unique")


def not_null(model: str, column: str) -> Rule:
    return Rule(model, column, "not_null")


def accepted_values(model: str, column: str, values: Iterable[str]) -> Rule:
    return Rule(model, column, "accepted_values", tuple(values))


def _failures(rule: Rule):
    """The rule's violation count over a table of (column_name, value, copies)."""
    here, value, copies = F.col("column_name") == rule.column, F.col("value"), F.col("copies")
    if rule.kind == "unique":
        return F.count_if(here & value.isNotNull() & (copies > 1))
    if rule.kind == "not_null":
        return F.coalesce(F.sum(F.when(here & value.isNull(), copies)), F.lit(0))
    if rule.kind == "accepted_values":
        return F.count_if(here & ~value.isin(list(rule.accepted)))
    raise ValueError(f"unknown rule kind {rule.kind!r}")


def _model_report(df: DataFrame, model: str, rules: Sequence[Rule]) -> DataFrame:
    columns = list(dict.fromkeys(rule.column for rule in rules))
    frequencies = (
        df.select(*[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot([], columns, "column_name", "value")
        .groupBy("column_name", "value")
        .agg(F.count("*").alias("copies"))
    )
    outcomes = [
        F.struct(
            F.lit(model).alias("model"),
            F.lit(rule.column).alias("column_name"),
            F.lit(rule.kind).alias("rule"),
            _failures(rule).alias("failures"),
        )
        for rule in rules
    ]
    return (
        frequencies.agg(F.array(*outcomes).alias("outcomes"))
        .select(F.inline("outcomes"))
        .withColumn("passed", F.col("failures") == 0)
    )


def report(models: dict[str, DataFrame], rules: Sequence[Rule]) -> DataFrame:
    """One row per rule: how many violations, and whether it holds.

    All rules of a model come from one pass over it: the value frequencies of the tested columns
    answer every kind of rule. A ``unique`` or ``accepted_values`` failure is an offending value, a
    ``not_null`` failure an offending row.
    """
    by_model: dict[str, list[Rule]] = {}
    for rule in rules:
        by_model.setdefault(rule.model, []).append(rule)
    parts = [_model_report(models[model], model, chosen) for model, chosen in by_model.items()]
    return reduce(DataFrame.unionAll, parts)


def agreement(left: DataFrame, right: DataFrame, column: str, tolerance: float = 0.01) -> DataFrame:
    """Whether two one-row results agree on ``column``, as one row."""
    both = left.select(F.lit("left").alias("side"), column).unionAll(
        right.select(F.lit("right").alias("side"), column)
    )
    values = both.agg(
        F.max(F.when(F.col("side") == "left", F.col(column))).alias("left_value"),
        F.max(F.when(F.col("side") == "right", F.col(column))).alias("right_value"),
    )
    close = F.abs(F.col("left_value") - F.col("right_value")) < tolerance
    return values.withColumn("agrees", close)


def surplus_rows(newer: DataFrame, older: DataFrame) -> DataFrame:
    """Rows that ``newer`` holds more often than ``older``, with the number of extra copies.

    The multiset difference as counts: one shuffle, counts combined before it, and a row copied
    many times is one output row rather than that many.
    """
    columns = newer.columns
    counted = newer.select(*columns, F.lit(1).alias("copy")).unionAll(
        older.select(*columns, F.lit(-1).alias("copy"))
    )
    return (
        counted.groupBy(*columns)
        .agg(F.sum("copy").alias("extra_copies"))
        .where(F.col("extra_copies") > 0)
    )


def duplicated_rows(df: DataFrame) -> DataFrame:
    """Rows that occur more than once, with how often."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def expected_groups(df: DataFrame, keys: Sequence[str], expected: int) -> DataFrame:
    """The number of key combinations found, against the number that is due."""
    found = df.select(*keys).distinct().agg(F.count("*").alias("found_groups"))
    return found.select(
        "found_groups", F.lit(expected).cast("bigint").alias("expected_groups"),
        (F.col("found_groups") == expected).alias("complete"),
    )
