"""Every registered query against its SQL in DuckDB, on whole tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from kgspark import catalog
from kgspark.catalog.fixtures import TABLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, CHECKS = catalog.queries(), catalog.checks()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def _comparable(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(f"{r[i]:.6f}" if isinstance(r[i], float) else repr(r[i]) for i in order) for r in rows)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    got = _comparable(result.collect(), result.columns)
    cursor = duck.execute(CHECKS[name])
    columns = [c[0] for c in cursor.description]
    expected = _comparable(cursor.fetchall(), columns)
    assert sorted(result.columns) == sorted(columns)
    assert got == expected
    assert got, "an empty result checks nothing"


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert {r["kind"] for r in rows} == {"node", "edge"}


def test_books_are_not_gathered_into_a_row(spark):
    plan = catalog.queries()["assembled_books"](spark, SF_DIR)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "array_join" not in plan
