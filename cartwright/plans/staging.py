"""Cleaned staging models and the rules they are tested with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright.functions import calendar, cleaning
from cartwright.operators import quality
from cartwright.sources.generators import COUNTRIES

# The codes a store accepts.
CURRENCIES = ["USD", "EUR", "GBP", "JPY", "SGD"]


def stg_transactions(raw: DataFrame) -> DataFrame:
    """Completed transactions with a positive amount, codes normalised, time reduced to the day."""
    return raw.where((F.col("status") == "completed") & (F.col("amount") > 0)).select(
        "transaction_id",
        "customer_id",
        "product_id",
        "category",
        "amount",
        cleaning.code(F.col("currency")).alias("currency"),
        cleaning.code(F.col("country_code")).alias("country_code"),
        "status",
        calendar.day(F.col("txn_timestamp")).alias("txn_date"),
    )


def stg_customers(raw: DataFrame) -> DataFrame:
    """Customers that are not deleted, with normalised address and country."""
    return raw.where(cleaning.is_active(F.col("is_deleted"))).select(
        "customer_id",
        cleaning.email(F.col("email")).alias("email"),
        "first_name",
        "last_name",
        calendar.day(F.col("signup_date")).alias("signup_date"),
        cleaning.code(F.col("country_code")).alias("country_code"),
    )


def staging_rules(currencies: Sequence[str] = CURRENCIES,
                  countries: Sequence[str] = COUNTRIES) -> list[quality.Rule]:
    return [
        quality.unique("stg_transactions", "transaction_id"),
        quality.not_null("stg_transactions", "transaction_id"),
        quality.accepted_values("stg_transactions", "currency", currencies),
        quality.accepted_values("stg_transactions", "country_code", countries),
        quality.unique("stg_customers", "customer_id"),
        quality.not_null("stg_customers", "customer_id"),
        quality.unique("stg_customers", "email"),
        quality.not_null("stg_customers", "email"),
    ]
