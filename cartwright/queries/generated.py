"""Synthetic rows, one per key of a given table, and the draws they are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwright.functions import calendar, draws
from cartwright.queries.base import query
from cartwright.sources import generators as g
from cartwright.sources.store import table


def draw_sql(salt: str, key: str, slot: int) -> str:
    key = f"CAST({key} AS BIGINT)"
    value = (
        f"((({key} & {draws.LOW_31}) * {draws.SPREAD} + (({key} >> 31) & {draws.LOW_31}) * {draws.SPREAD_HIGH}"
        f" + {draws.seed(salt, slot)}) & {draws.LOW})"
    )
    value = f"((xor({value} >> 16, {value}) * {draws.FACTOR}) & {draws.LOW})"
    return f"xor({value} >> 15, {value})"


def below_sql(draw: str, probability: float) -> str:
    return f"({draw} < {int(probability * 2**32)})"


def uniform_int_sql(draw: str, low: int, high: int) -> str:
    return f"({low} + ({draw} * {high - low}) // 4294967296)"


def uniform_decimal_sql(draw: str, low: float, high: float, digits: int) -> str:
    scale = 10**digits
    steps = uniform_int_sql(draw, round(low * scale), round(high * scale) + 1)
    return f"(CAST({steps} AS DOUBLE) / {scale}.0::DOUBLE)"


def choice_sql(draw: str, options) -> str:
    listed = ", ".join(f"'{o}'" for o in options)
    return f"list_extract([{listed}], {uniform_int_sql(draw, 1, len(options) + 1)})"


def weighted_sql(draw: str, weights: dict[str, float]) -> str:
    """Cumulative shares of 2**32; the last option takes the rest."""
    shares, bound, cases = list(weights.items()), 0.0, []
    for option, weight in shares[:-1]:
        bound += weight
        cases.append(f"WHEN {draw} < {round(bound * 2**32)} THEN '{option}'")
    return f"(CASE {' '.join(cases)} ELSE '{shares[-1][0]}' END)"


def step_sql(start: str, index: str, seconds: int) -> str:
    return f"(TIMESTAMP '{start}' + to_seconds({index} * {seconds}))"


def _t(i: int, slot: int) -> str:
    return draw_sql("transactions/42", "o_orderkey", 4 * i + slot)


def _c(slot: int) -> str:
    return draw_sql("customers/42", "c_custkey", slot)


def _b(i: int, slot: int) -> str:
    return draw_sql("benchmark/42", "event_id", 4 * i + slot)


@query("generate_transactions", "Q20 S12 X19 X22 X23 X24 X26", f"""
SELECT printf('TXN-%08d', o_orderkey) AS transaction_id,
       {uniform_int_sql(_t(0, 0), 1, 5001)} AS customer_id,
       {uniform_int_sql(_t(0, 1), 1, 101)} AS product_id,
       {weighted_sql(_t(0, 2), g.CATEGORY_WEIGHTS)} AS category,
       {uniform_decimal_sql(_t(0, 3), 5, 500, 2)} AS amount,
       {weighted_sql(_t(1, 0), g.CURRENCY_WEIGHTS)} AS currency,
       {weighted_sql(_t(1, 1), g.COUNTRY_WEIGHTS)} AS country_code,
       {weighted_sql(_t(1, 2), g.STATUS_WEIGHTS)} AS status,
       {step_sql('2024-01-01', 'o_orderkey', 600)} AS timestamp
FROM orders""")
def generate_transactions(spark, sf_dir):
    return g.transactions(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")))


@query("generate_customers", "Q20 S12 X20 X24 X25 X26 X27", f"""
SELECT c_custkey + 1 AS customer_id,
       'customer' || CAST(c_custkey + 1 AS VARCHAR) || '@shop.example' AS email,
       {choice_sql(_c(0), g.FIRST_NAMES)} AS first_name,
       {choice_sql(_c(1), g.LAST_NAMES)} AS last_name,
       CAST({step_sql('2022-01-01', 'c_custkey', 21600)} AS DATE) AS signup_date,
       {weighted_sql(_c(2), g.COUNTRY_WEIGHTS)} AS country_code,
       {below_sql(_c(3), 0.05)} AS is_deleted
FROM customer""")
def generate_customers(spark, sf_dir):
    return g.customers(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))


@query("generate_products", "Q20 S12 X19 X20 X21 X23", f"""
SELECT p_partkey + 1 AS product_id,
       printf('Product-%03d', p_partkey + 1) AS product_name,
       list_extract({g.CATEGORIES}, p_partkey % 5 + 1) AS category,
       'Brand-' || CAST(p_partkey % 10 + 1 AS VARCHAR) AS brand,
       {uniform_decimal_sql(draw_sql('products/42', 'p_partkey', 0), 5, 500, 2)} AS unit_price
FROM part""")
def generate_products(spark, sf_dir):
    return g.products(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")))


@query("generate_benchmark_transactions", "Q20 S12 X22 X23 X25 X26", f"""
SELECT printf('TXN-%08d', event_id) AS transaction_id,
       {uniform_int_sql(_b(0, 0), 1, 100000)} AS customer_id,
       {uniform_int_sql(_b(0, 1), 1, 5000)} AS product_id,
       {uniform_decimal_sql(_b(0, 2), 1, 500, 2)} AS amount,
       {choice_sql(_b(0, 3), g.CATEGORIES)} AS category,
       {choice_sql(_b(1, 0), g.COUNTRIES)} AS country_code,
       {step_sql('2024-01-01', 'event_id', 1)} AS timestamp,
       {below_sql(_b(1, 1), 0.05)} AS is_refunded
FROM events""")
def generate_benchmark_transactions(spark, sf_dir):
    return g.benchmark_transactions(table(spark, sf_dir, "events").select(F.col("event_id").alias("id")))


def _d(slot: int) -> str:
    return draw_sql("draws", "event_id", slot)


def _drawn(spark, sf_dir, slot):
    events = table(spark, sf_dir, "events").select("event_id")
    return events, draws.draw("draws", F.col("event_id"), slot)


@query("draw_uniform_integer", "X22", f"SELECT event_id, {uniform_int_sql(_d(0), 10, 20)} AS drawn FROM events")
def draw_uniform_integer(spark, sf_dir):
    events, drawn = _drawn(spark, sf_dir, 0)
    return events.select("event_id", draws.uniform_int(drawn, 10, 20).alias("drawn"))


@query("draw_uniform_double", "X16 X23", f"SELECT event_id, {uniform_decimal_sql(_d(1), 1, 5, 2)} AS drawn FROM events")
def draw_uniform_double(spark, sf_dir):
    events, drawn = _drawn(spark, sf_dir, 1)
    return events.select("event_id", draws.uniform_decimal(drawn, 1.0, 5.0, 2).alias("drawn"))


@query("draw_weighted_choice", "X24", f"SELECT event_id, {weighted_sql(_d(2), g.STATUS_WEIGHTS)} AS drawn FROM events")
def draw_weighted_choice(spark, sf_dir):
    events, drawn = _drawn(spark, sf_dir, 2)
    return events.select("event_id", draws.weighted_choice(drawn, g.STATUS_WEIGHTS).alias("drawn"))


@query("draw_uniform_choice", "X25", f"SELECT event_id, {choice_sql(_d(3), g.COUNTRIES)} AS drawn FROM events")
def draw_uniform_choice(spark, sf_dir):
    events, drawn = _drawn(spark, sf_dir, 3)
    return events.select("event_id", draws.choice(drawn, g.COUNTRIES).alias("drawn"))


@query("fixed_step_series", "X26", f"""
SELECT event_id, {step_sql('2024-01-01', 'event_id', 600)} AS every_ten_minutes,
       {step_sql('2024-01-01', 'event_id', 1)} AS every_second,
       {step_sql('2022-01-01', 'event_id', 21600)} AS every_six_hours
FROM events""")
def fixed_step_series(spark, sf_dir):
    index = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        calendar.step(g.FIRST_TRANSACTION, index, 600).alias("every_ten_minutes"),
        calendar.step(g.FIRST_TRANSACTION, index, 1).alias("every_second"),
        calendar.step(g.FIRST_SIGNUP, index, 21_600).alias("every_six_hours"),
    )
