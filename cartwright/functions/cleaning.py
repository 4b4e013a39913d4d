"""Normalisation of codes, addresses and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def code(value: Column) -> Column:
    """Currency and country codes: surrounding blanks off, upper case."""
    return F.upper(F.trim(value))


def email(value: Column) -> Column:
    return F.lower(F.trim(value))


def is_active(deleted_flag: Column) -> Column:
    """True only for a flag that reads ``false``, stored as a boolean or as text; NULL is not active."""
    return F.trim(deleted_flag.cast("string")) == "false"
