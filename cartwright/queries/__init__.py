"""Every query the library answers, over a folder of test tables, with its SQL counterpart."""

from __future__ import annotations

from cartwright.queries import (  # noqa: F401  (each module registers its queries)
    aggregates,
    columns,
    filters,
    generated,
    incremental,
    joined,
    ordering,
    reports,
    rules,
    scans,
    versions,
    writes,
)
from cartwright.queries.base import QUERIES, Query

__all__ = ["QUERIES", "Query"]
