from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from cartwright.sources import generators as g
from cartwright.sources import schemas

N = 20_000


def types(df):
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


@pytest.mark.parametrize("build, schema", [
    (g.transactions, schemas.TRANSACTIONS), (g.customers, schemas.CUSTOMERS),
    (g.products, schemas.PRODUCTS), (g.benchmark_transactions, schemas.BENCHMARK_TRANSACTIONS)])
def test_schema(spark, build, schema):
    assert types(build(g.ids(spark, 3))) == [(f.name, f.dataType.simpleString()) for f in schema.fields]


@pytest.mark.parametrize("build", [g.transactions, g.customers, g.products, g.benchmark_transactions])
def test_same_rows_whatever_the_partitioning(spark, build):
    one, many = build(g.ids(spark, 500, 1)), build(g.ids(spark, 500, 9))
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_salt_changes_the_draws(spark):
    keys = g.ids(spark, 100)
    assert not g.transactions(keys).exceptAll(g.transactions(keys, salt="43")).isEmpty()


def test_transactions(spark):
    df = g.transactions(g.ids(spark, N)).cache()
    first, last = df.orderBy("transaction_id").first(), df.orderBy(F.desc("transaction_id")).first()
    assert (first["transaction_id"], first["timestamp"]) == ("TXN-00000000", datetime(2024, 1, 1))
    assert last["transaction_id"] == "TXN-00019999"
    assert df.select("transaction_id").distinct().count() == N
    low, high, cents, days = df.agg(
        F.min("amount"), F.max("amount"), F.max(F.abs(F.col("amount") * 100 - F.round(F.col("amount") * 100))),
        F.count_distinct(F.to_date("timestamp"))).first()
    assert 5.0 <= low < 6.0 and 499.0 < high <= 500.0 and cents < 1e-6 and days == 139
    assert df.agg(F.min("customer_id"), F.max("customer_id")).first()[0] >= 1
    assert df.agg(F.max("customer_id"), F.max("product_id")).first() == (5000, 100)
    for column, weights in (("category", g.CATEGORY_WEIGHTS), ("currency", g.CURRENCY_WEIGHTS),
                            ("country_code", g.COUNTRY_WEIGHTS), ("status", g.STATUS_WEIGHTS)):
        shares = {r[0]: r[1] / N for r in df.groupBy(column).count().collect()}
        assert set(shares) == set(weights)
        assert all(abs(shares[k] - p) < 0.02 for k, p in weights.items())
    df.unpersist()


def test_days_of_the_full_table(spark):
    days = g.transactions(g.ids(spark, g.N_TRANSACTIONS)).agg(F.count_distinct(F.to_date("timestamp")))
    assert days.first()[0] == 695


def test_month_sizes_of_the_full_table(spark):
    counts = g.transactions(g.ids(spark, g.N_TRANSACTIONS)).groupBy(F.month("timestamp").alias("m")).count()
    sizes = {r["m"]: r["count"] for r in counts.collect()}
    assert (sizes[1], sizes[2], sizes[3]) == (8928, 8208, 8928)


def test_customers_and_products(spark):
    customers = g.customers(g.ids(spark, 5000), domain="example.org").orderBy("customer_id").collect()
    assert customers[0]["email"] == "customer1@example.org"
    assert [c["signup_date"] for c in customers[:5]] == [date(2022, 1, 1)] * 4 + [date(2022, 1, 2)]
    assert abs(sum(c["is_deleted"] for c in customers) / 5000 - 0.05) < 0.01
    products = g.products(g.ids(spark, 100)).orderBy("product_id").collect()
    assert [tuple(p)[:4] for p in products[:2]] == [
        (1, "Product-001", "Electronics", "Brand-1"), (2, "Product-002", "Clothing", "Brand-2")]
    assert products[99]["brand"] == "Brand-10"
