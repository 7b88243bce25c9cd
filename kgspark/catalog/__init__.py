"""Named queries over the shared test tables, each with the SQL that checks it."""

from __future__ import annotations

from . import (  # noqa: F401  (register their queries)
    bucket_queries,
    graph_queries,
    name_queries,
    neighbourhood_queries,
    row_queries,
    rule_queries,
    run_queries,
    storage_queries,
    text_queries,
)
from .registry import CHECKS, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def checks() -> dict[str, str]:
    return dict(CHECKS)
