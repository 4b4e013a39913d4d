"""Runs a query in Spark and its SQL in DuckDB and compares schema and rows exactly."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()
TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def differences(df, con, sql):
    """Empty if the result equals the SQL's; else a list of what differs."""
    columns = sorted(df.columns)
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    relation = con.execute(sql)
    described = {d[0]: str(d[1]) for d in relation.description}
    theirs = relation.fetchall()
    if columns != sorted(described):
        return [f"columns {columns} against {sorted(described)}"]
    problems = [
        f"{c}: {fields[c]} against {described[c]}"
        for c in columns if TYPES.get(fields[c], fields[c]) != described[c]
    ]
    order = [list(described).index(c) for c in columns]
    expected = Counter(tuple(row[i] for i in order) for row in theirs)
    found = Counter(tuple(row[c] for c in columns) for row in df.collect())
    if found != expected:
        extra, missing = found - expected, expected - found
        problems.append(
            f"{found.total()} rows against {expected.total()};"
            f" extra {list(extra)[:3]}, missing {list(missing)[:3]}"
        )
    return problems
