"""Declared schemas. Readers use these instead of inferring types from the data."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _struct(**columns) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


_LONG, _INT, _DOUBLE, _TEXT = LongType(), IntegerType(), DoubleType(), StringType()
_BOOL, _DATE, _MOMENT = BooleanType(), DateType(), TimestampNTZType()

TRANSACTIONS = _struct(
    transaction_id=_TEXT,
    customer_id=_LONG,
    product_id=_LONG,
    category=_TEXT,
    amount=_DOUBLE,
    currency=_TEXT,
    country_code=_TEXT,
    status=_TEXT,
    timestamp=_MOMENT,
)

CUSTOMERS = _struct(
    customer_id=_LONG,
    email=_TEXT,
    first_name=_TEXT,
    last_name=_TEXT,
    signup_date=_DATE,
    country_code=_TEXT,
    is_deleted=_BOOL,
)

PRODUCTS = _struct(
    product_id=_LONG,
    product_name=_TEXT,
    category=_TEXT,
    brand=_TEXT,
    unit_price=_DOUBLE,
)

BENCHMARK_TRANSACTIONS = _struct(
    transaction_id=_TEXT,
    customer_id=_LONG,
    product_id=_LONG,
    amount=_DOUBLE,
    category=_TEXT,
    country_code=_TEXT,
    timestamp=_MOMENT,
    is_refunded=_BOOL,
)

# Ids are 32-bit in the history table; a larger id is an error on append, never a wrapped number.
VERSIONED_TRANSACTIONS = _struct(
    transaction_id=_TEXT,
    customer_id=_INT,
    product_id=_INT,
    category=_TEXT,
    amount=_DOUBLE,
    currency=_TEXT,
    country_code=_TEXT,
    status=_TEXT,
    txn_timestamp=_MOMENT,
)

SEED_TABLES = {"transactions": TRANSACTIONS, "customers": CUSTOMERS, "products": PRODUCTS}
