from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartwright.functions import calendar, cleaning, draws, money

amounts = st.lists(st.one_of(st.none(), st.integers(-10**9, 10**9).map(lambda c: c / 100)), min_size=1, max_size=30)


@given(values=amounts)
@settings(max_examples=15, deadline=None)
def test_total_is_the_exact_sum(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "amount double").repartition(3)
    present = [Decimal(str(v)) for v in values if v is not None]
    expected = float(sum(present)) if present else None
    assert df.agg(money.total(F.col("amount"))).first()[0] == expected


def test_total_does_not_depend_on_order(spark):
    df = spark.range(100_000).select((F.col("id") % 997 / F.lit(100.0)).alias("amount"))
    results = {df.repartition(n).agg(money.total(F.col("amount"))).first()[0] for n in (1, 3, 8)}
    assert len(results) == 1


def test_small_amounts_are_not_rounded_each(spark):
    df = spark.range(1000).select(F.lit(0.004).alias("amount"))
    assert df.agg(money.total(F.col("amount")), money.rounded_total(F.col("amount"))).first() == (4.0, 4.0)


def test_nan_counts_as_null(spark):
    df = spark.createDataFrame([(1.25,), (float("nan"),), (None,), (-0.75,)], "amount double")
    assert df.agg(money.total(F.col("amount")), money.mean(F.col("amount"))).first() == (0.5, 0.25)
    assert df.where("isnan(amount)").agg(money.total(F.col("amount"))).first()[0] is None


def test_mean_skips_null(spark):
    df = spark.createDataFrame([(1.0,), (None,), (2.01,)], "amount double")
    assert df.agg(money.mean(F.col("amount"))).first()[0] == 1.51


def test_overflow_is_an_error(spark):
    df = spark.createDataFrame([(9.0e18,), (9.0e18,)], "amount double")
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        df.agg(money.total(F.col("amount"))).collect()


def test_codes_and_flags(spark):
    df = spark.createDataFrame(
        [(" us ", " A@B.C ", "false"), ("gb", "x", " false "), (None, None, "true"), ("", "", None)],
        "code string, email string, flag string")
    rows = df.select(
        cleaning.code(F.col("code")), cleaning.email(F.col("email")), cleaning.is_active(F.col("flag"))
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("US", "a@b.c", True), ("GB", "x", True), (None, None, False), ("", "", None)]


def test_boolean_flag_keeps_only_false(spark):
    df = spark.createDataFrame([(False,), (True,), (None,)], "flag boolean")
    assert df.where(cleaning.is_active(F.col("flag"))).collect() == [(False,)]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/Los_Angeles"])
def test_month_does_not_depend_on_session_zone(spark, conf, zone):
    conf(spark__sql__session__timeZone=zone)
    df = spark.createDataFrame([("2024-01-31 23:50:00",), ("2024-02-01 00:00:00",)], "t string")
    t = calendar.moment(F.col("t"))
    rows = df.select(F.month(t), calendar.month_start(t), calendar.day(t)).collect()
    assert [tuple(r) for r in rows] == [
        (1, date(2024, 1, 1), date(2024, 1, 31)), (2, date(2024, 2, 1), date(2024, 2, 1))]


def test_month_of_year_keeps_every_year(spark):
    df = spark.createDataFrame([("2024-01-05",), ("2025-01-05",), ("2025-02-05",)], "t string")
    t = F.col("t").cast("timestamp_ntz")
    assert df.where(calendar.in_month(t, 1)).count() == 2
    assert df.where(calendar.in_month(t, 1, 2025)).count() == 1


def test_malformed_time_is_an_error(spark):
    df = spark.createDataFrame([("noon",)], "t string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(calendar.moment(F.col("t"))).collect()
    assert df.select(F.col("t").try_cast("timestamp_ntz")).first()[0] is None


def test_step_crosses_month_and_year(spark):
    row = spark.range(1).select(
        calendar.step("2024-01-01 00:00:00", F.lit(99_999), 600),
        calendar.step("2022-01-01 00:00:00", F.lit(4_999), 21_600)).first()
    assert tuple(row) == (datetime(2025, 11, 25, 10, 30), datetime(2025, 6, 3, 18, 0))


def test_draws_do_not_depend_on_partitioning(spark):
    def drawn(partitions):
        ids = spark.range(0, 2000, 1, partitions).repartition(partitions, "id")
        rows = ids.select("id", draws.draw("s", F.col("id"), 2).alias("d")).collect()
        return {r["id"]: r["d"] for r in rows}

    first = drawn(1)
    assert first == drawn(7)
    assert all(0 <= d < 2**32 for d in first.values())


def test_draw_proportions_and_bounds(spark):
    def drawn(slot):
        return draws.draw("p", F.col("id"), slot)

    weights = {"a": 0.75, "b": 0.15, "c": 0.10}
    rows = spark.range(20_000).select(
        draws.weighted_choice(drawn(0), weights).alias("w"),
        draws.uniform_int(drawn(1), 1, 5).alias("i"),
        draws.uniform_decimal(drawn(2), 5.0, 15.0, 1).alias("d"),
        draws.choice(drawn(3), ["x", "y"]).alias("o"),
    ).collect()
    shares = Counter(r["w"] for r in rows)
    assert all(abs(shares[k] / 20_000 - p) < 0.02 for k, p in weights.items())
    assert {r["i"] for r in rows} == {1, 2, 3, 4}
    assert {r["o"] for r in rows} == {"x", "y"}
    decimals = {r["d"] for r in rows}
    assert min(decimals) == 5.0 and max(decimals) == 15.0 and len(decimals) == 101


def test_draws_of_slots_salts_and_high_keys_are_unrelated(spark):
    keys = spark.range(20_000).select("id", (F.col("id") * 2**33 - 7).alias("high"))
    pairs = [
        (draws.draw("a", F.col("id"), 0), draws.draw("a", F.col("id"), 1)),
        (draws.draw("a", F.col("id"), 0), draws.draw("b", F.col("id"), 0)),
        (draws.draw("a", F.col("id"), 0), draws.draw("a", F.col("id") + 1, 0)),
        (draws.draw("a", F.col("high"), 0), draws.draw("a", F.col("high"), 1)),
    ]
    row = keys.agg(*[F.corr(x, y) for x, y in pairs], *[F.avg(x) for x, _ in pairs]).first()
    assert all(abs(c) < 0.03 for c in row[:4])
    assert all(abs(mean / 2**31 - 1) < 0.03 for mean in row[4:])
