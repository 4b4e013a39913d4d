"""Hand-made edge cases of the summaries, staging models and marts."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from cartwright.operators import joins
from cartwright.plans import exploration, history, marts, staging, summaries

COLUMNS = (
    "transaction_id string, customer_id bigint, product_id bigint, category string, amount double,"
    " currency string, country_code string, status string, txn_timestamp timestamp_ntz"
)
CUSTOMER_COLUMNS = (
    "customer_id bigint, email string, first_name string, last_name string, signup_date string,"
    " country_code string, is_deleted boolean"
)


def txn(id="t", customer=1, product=1, category="Food", amount=10.0, status="completed",
        at="2024-01-01 10:00", currency="usd", country=" us "):
    return (id, customer, product, category, amount, currency, country, status,
            datetime.fromisoformat(at))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame(
        [(1, "p1", "Toys"), (2, "p2", "Books")], "product_id bigint, product_name string, category string")


def test_category_country_summary_drops_only_null_amounts(spark):
    df = spark.createDataFrame([
        txn(amount=5.5), txn(amount=0.0), txn(amount=-1.25), txn(amount=None), txn(id=None, amount=1.0),
        txn(status="Completed"), txn(status=None), txn(status="cancelled"),
    ], COLUMNS)
    assert rows(summaries.category_country_summary(df)) == [("Food", " us ", 5.25, 3)]


@pytest.mark.parametrize("join", [joins.left_join, joins.left_join_sort_merge])
def test_daily_summary_by_product_category(spark, products, join):
    df = spark.createDataFrame([
        txn(product=1, amount=1.1), txn(product=1, amount=2.2, category="Books"),
        txn(product=9, amount=4.0), txn(product=None, amount=8.0),
        txn(id=None), txn(amount=None), txn(amount=0.0), txn(amount=-3.0),
        txn(product=2, amount=16.0, at="2024-01-01 23:59:59"), txn(product=2, at="2024-01-02 00:00"),
    ], COLUMNS)
    first, second = date(2024, 1, 1), date(2024, 1, 2)
    assert rows(summaries.daily_summary_by_product_category(df, products, join)) == sorted([
        (first, "Toys", 3.3, 2), (first, None, 12.0, 2), (first, "Books", 16.0, 1),
        (second, "Books", 10.0, 1)], key=str)


def test_daily_summary_by_fact_category_keeps_own_category(spark, products):
    df = spark.createDataFrame(
        [txn(product=1, category="Food"), txn(product=9, category="Food"), txn(category="Sports")], COLUMNS)
    for summary in (summaries.daily_summary_by_fact_category(df),
                    summaries.daily_summary_by_fact_category_joined(df, products)):
        assert rows(summary) == [
            (date(2024, 1, 1), "Food", 20.0, 2), (date(2024, 1, 1), "Sports", 10.0, 1)]


@pytest.mark.parametrize("join", [joins.left_join, joins.left_join_sort_merge])
def test_repeated_product_key_counts_every_match(spark, join):
    doubled = spark.createDataFrame(
        [(1, "a", "Toys"), (1, "b", "Toys")], "product_id bigint, product_name string, category string")
    df = spark.createDataFrame([txn(amount=1.5), txn(amount=2.5)], COLUMNS)
    (only,) = summaries.daily_summary_by_product_category(df, doubled, join).collect()
    assert (only["total_revenue"], only["tx_count"]) == (8.0, 4)


def test_stg_transactions(spark):
    df = spark.createDataFrame([
        txn(currency=" usd", country="us "), txn(amount=0.0), txn(amount=None), txn(status="refunded"),
        txn(id=None, at="2024-01-31 23:50"),
    ], COLUMNS)
    out = staging.stg_transactions(df)
    assert [(r["transaction_id"], r["currency"], r["country_code"], r["txn_date"]) for r in out.collect()] == [
        ("t", "USD", "US", date(2024, 1, 1)), (None, "USD", "US", date(2024, 1, 31))]


def customer(id, deleted=False, email=" A@Shop.Example "):
    return (id, email, "Ann", "Lee", "2022-03-04", "de ", deleted)


def test_stg_customers_keeps_only_false(spark):
    df = spark.createDataFrame([customer(1), customer(2, True), customer(3, None)], CUSTOMER_COLUMNS)
    assert rows(staging.stg_customers(df)) == [
        (1, "a@shop.example", "Ann", "Lee", date(2022, 3, 4), "DE")]


def test_marts(spark):
    transactions = staging.stg_transactions(spark.createDataFrame([
        txn(customer=1, amount=1.1, at="2024-01-03 00:00"), txn(customer=1, amount=2.2),
        txn(id=None, customer=1, amount=4.0), txn(customer=2, amount=8.0), txn(customer=3, status="cancelled"),
    ], COLUMNS))
    customers = staging.stg_customers(
        spark.createDataFrame([customer(1), customer(2, True), customer(3)], CUSTOMER_COLUMNS))
    dim = {r["customer_id"]: r for r in marts.dim_customers(customers, transactions).collect()}
    assert set(dim) == {1, 3}
    assert tuple(dim[1])[6:] == (date(2024, 1, 1), date(2024, 1, 3), 2, 7.3)
    assert tuple(dim[3])[6:] == (None, None, 0, 0.0)
    fact = rows(marts.fct_daily_revenue(transactions))
    assert fact == [
        (date(2024, 1, 1), "Food", "US", 2, 14.2), (date(2024, 1, 3), "Food", "US", 1, 1.1)]


def test_filtered_revenue_of_nothing_is_null(spark):
    df = spark.createDataFrame([txn()], COLUMNS)
    assert exploration.filtered_revenue(df, "Toys", "XX").first()[0] is None


def test_monthly_split_counts_ignore_the_year(spark):
    df = spark.createDataFrame(
        [txn(at="2024-01-05"), txn(at="2025-01-31 23:50"), txn(at="2025-02-01"), txn(at="2024-07-01")], COLUMNS)
    assert rows(history.monthly_split_counts(df)) == [(1, 2), (2, 1)]


def test_head_reads_the_first_file(spark, tmp_path):
    (tmp_path / "part-00000.txt").write_text("a\nb\nc\n")
    (tmp_path / "part-00001.txt").write_text("".join(f"later {i}\n" for i in range(5000)))
    lines = [r["value"] for r in exploration.head(spark, str(tmp_path), 2).collect()]
    assert lines == ["a", "b"]


def test_head_goes_on_past_short_files(spark, tmp_path):
    for i, text in enumerate(["a\nb\n", "", "c\n", "d\ne\nf\n", "g\n"]):
        (tmp_path / f"part-{i:05d}.txt").write_text(text)
    assert [r["value"] for r in exploration.head(spark, str(tmp_path), 5).collect()] == list("abcde")
    assert [r["value"] for r in exploration.head(spark, str(tmp_path), 50).collect()] == list("abcdefg")


def test_line_count_knows_headers_of_every_file(spark, tmp_path):
    for part in range(3):
        (tmp_path / f"part-{part}.csv").write_text("id,name\n1,x\n2,y\n")
    row = exploration.line_count(spark.read.text(str(tmp_path)), "id,name").first()
    assert tuple(row) == (9, 3, 6)
