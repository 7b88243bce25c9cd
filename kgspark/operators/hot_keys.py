"""Joins whose keys many rows share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..session import cut_lineage


def join_crowded(rows: DataFrame, per_key: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of ``rows`` with ``per_key``, which has few rows of each key and was made by grouping on it.

    Adaptive execution splits a key that crowds one task over several, if both sides come straight from a shuffle. So
    what was grouped is written and read again: nothing is repeated, and where it turns out small it is broadcast.
    """
    return rows.join(cut_lineage(per_key), list(keys))
