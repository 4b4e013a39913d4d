"""cartwright: e-commerce analytics as ordinary, lazy Spark DataFrames."""

__version__ = "0.1.0"
