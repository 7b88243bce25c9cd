"""Collects the queries and their check SQL by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS
from . import fixtures

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


class Data:
    """The tables and fixture views of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def view(self, name: str) -> DataFrame:
        return fixtures.view(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return fixtures.table(self.spark, self.sf_dir, name)


def query(check: str | None = None, views: str = "") -> Callable:
    """Register a function of ``Data`` under its own name; ``check`` may use the fixture views listed in ``views``."""

    def register(fn: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Data(spark, sf_dir))
        if check is not None:
            text = check.strip()
            names = views.split()
            if names:
                head = fixtures.with_views(*names)
                if text.upper().startswith("WITH RECURSIVE"):
                    text = head.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + text[len("WITH RECURSIVE") :]
                elif text.upper().startswith("WITH"):
                    text = head + ", " + text[len("WITH") :]
                else:
                    text = head + " " + text
            CHECKS[fn.__name__] = text
        return fn

    return register


def rounded(c: Column | str, name: str | None = None) -> Column:
    out = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return out.alias(name or c)


def joined(c: str, name: str | None = None) -> Column:
    """An array as text, so that both engines give the same value."""
    return F.array_join(c, "~").alias(name or c)


# The clean-up functions in DuckDB's dialect, for the checks.


def d_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def d_collapse(x: str) -> str:
    return f"regexp_replace({d_strip(x)}, '{WS}+', ' ', 'g')"


def d_slug(x: str) -> str:
    return rf"lower(trim(regexp_replace({x}, '[^\p{{L}}\p{{N}}_]+', '_', 'g'), '_'))"


def d_url_slug(x: str) -> str:
    inner = WS[1:-1]
    kept = rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_{inner}\-]', '', 'g')"
    return rf"trim(regexp_replace({kept}, '[{inner}_\-]+', '_', 'g'), '_')"


def d_concept_id(name: str) -> str:
    return f"'concept:' || {d_slug(name)} || ':' || substr(md5(topic || '|' || chapter || '|' || subchapter), 1, 6)"


def d_node_id(name: str, type_: str, scope: str) -> str:
    full = (
        f"{d_url_slug(name)} || CASE WHEN {type_} NOT IN ('', 'Concept') THEN '_' || lower({type_}) ELSE '' END || "
        f"CASE WHEN {scope} <> '' THEN '_' || substr({d_url_slug(scope)}, 1, 8) ELSE '' END"
    )
    return f"CASE WHEN length({full}) > 64 THEN substr({full}, 1, 50) || '_' || substr(md5({full}), 1, 8) ELSE {full} END"


def d_rid(type_: str, source: str, target: str, scope: str) -> str:
    return f"substr(md5({type_} || '|' || {source} || '|' || {target} || '|' || {scope}), 1, 16)"
