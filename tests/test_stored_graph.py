"""Bucketed stores against the rules on whole tables; evidence, levels and sketches."""

from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from kgspark import schemas
from kgspark.operators import extract, merge, ordering, store, stored_graph, telemetry
from kgspark.sources.buckets import BucketTable
from kgspark.streaming.incremental import conformed


def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def nodes(spark, rows):
    df = spark.createDataFrame(rows, "seq long, scope string, id string, type string, name string, description string")
    when = F.timestamp_seconds("seq")
    return conformed(df.withColumns({"created_at": when, "updated_at": when}), schemas.KG_NODES)


def edges(spark, rows):
    df = spark.createDataFrame(rows, "seq long, src_section string, source_id string, target_id string, type string")
    when = F.timestamp_seconds("seq")
    stamped = store.stamp_section_scope(df.withColumns({"created_at": when, "updated_at": when}))
    return conformed(stamped, schemas.KG_EDGES)


def content(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def files(table):
    return {re.sub(".*/data/", "", f) for f in table.read().inputFiles()}


@pytest.fixture
def graph(spark, tmp_path):
    stored = stored_graph.open_graph(spark, str(tmp_path / "graph"), 32)
    rnd = random.Random(1)
    old_nodes = nodes(spark, [(i, f"section:s{i % 9}", f"n{i}", "T" if i % 3 else "U", f"name {i}", "d") for i in range(200)])
    old_edges = edges(spark, [(i, f"s{i % 9}", f"n{rnd.randrange(200)}", f"n{rnd.randrange(200)}", "R") for i in range(300)])
    old_edges = ordering.last_wins(old_edges, ["scope", "rid"])
    stored.nodes.write(old_nodes)
    stored.edges.write(old_edges)
    return stored, old_nodes, old_edges


def test_stored_rows_are_read_again(graph):
    stored, old_nodes, old_edges = graph
    found = stored_graph.stored_rows(stored)
    assert content(found.nodes) == content(old_nodes) and content(found.edges) == content(old_edges)
    one = stored_graph.scope_edges(stored, "section:s3")
    assert content(one) == content(old_edges.where("scope = 'section:s3'"))
    assert len({os.path.dirname(f) for f in one.inputFiles()}) == 1


def test_merges_touch_their_buckets_only(spark, graph):
    stored, old_nodes, _ = graph
    incoming = nodes(spark, [(900, "book:x", "n1", "T", "new", None), (901, "book:x", "n1", "T", "newer", None),
                             (902, "s", "n1", "Other", "other type", None), (903, None, "fresh", "T", "f", None)])
    before = files(stored.nodes)
    version = stored_graph.upsert_nodes(stored, incoming)
    after = files(stored.nodes)
    assert content(stored.nodes.read()) == content(store.upsert_nodes(old_nodes, incoming, store.MERGE_KEY))
    changed = {f for f in after if f.startswith(f"at={version}/")}
    assert {os.path.dirname(f).split("/")[1] for f in changed} <= {f"bucket={b}" for b in stored.nodes.touched(incoming)}
    assert before - after and len(before & after) >= len(before) - 3  # all other buckets keep their files
    row = {r["id"] + r["type"]: r for r in stored.nodes.read().where("id IN ('n1', 'fresh')").collect()}
    assert row["n1T"]["scope"] == "book:x" and row["n1T"]["name"] == "newer" and row["n1T"]["created_at"].year == 1970
    again = stored_graph.upsert_nodes(stored, incoming)
    assert again == version + 1 and content(stored.nodes.read()) == content(store.upsert_nodes(old_nodes, incoming, store.MERGE_KEY))


def test_edges_need_stored_ends(spark, graph):
    stored, old_nodes, old_edges = graph
    incoming = edges(spark, [(900, "s1", "n1", "n2", "NEW"), (901, "s1", "n1", "nowhere", "NEW"), (902, "t", "n3", "n4", "NEW")])
    stored_graph.upsert_edges(stored, incoming)
    assert content(stored.edges.read()) == content(store.upsert_edges(old_edges, incoming, old_nodes))


def test_sections_are_replaced(spark, graph):
    stored, old_nodes, old_edges = graph
    new_nodes = nodes(spark, [(900, "section:s1", "n1", None, "renamed", None), (901, "section:s2", "made", "T", "made", "x")])
    new_nodes = new_nodes.withColumn("src_section", F.regexp_replace("scope", "section:", ""))
    new_edges = edges(spark, [(910, "s1", "n1", "made", "R"), (911, "s1", "n1", "nowhere", "R"), (912, "s8", "n5", "n6", "R")])
    stored_graph.replace_sections(stored, new_nodes, new_edges, now())
    expected = store.replace_section_graph(old_nodes, old_edges, new_nodes, new_edges, now())
    assert content(stored.nodes.read()) == content(expected.nodes.select(*old_nodes.columns))
    # a section without edges in the batch loses those it has: s2 has none
    assert content(stored.edges.read()) == content(expected.edges.select(*old_edges.columns))
    assert stored.edges.read().where("scope = 'section:s2'").count() == 0


def test_versions_and_odd_tables(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), "k STRING, v INT", ["k"], buckets=4)
    assert table.version() == -1 and table.read().count() == 0
    assert table.merge(spark.createDataFrame([], "k STRING, v INT"), lambda old, new: new) == -1
    first = spark.createDataFrame([("a", 1), (None, 2), ("a", 3)], "k STRING, v INT")
    assert table.merge(first, lambda old, new: old.unionByName(new)) == 0
    assert content(table.read()) == content(first) and table.read_key(k=None).count() == 1
    assert table.merge(first, lambda old, new: old.limit(0)) == 1 and table.read().count() == 0
    assert table.write(first) == 2 and table.read().count() == 3
    with pytest.raises(ValueError):
        BucketTable(spark, str(tmp_path / "t"), "k STRING, v INT", ["k"], buckets=8).read()
    with pytest.raises(ValueError):
        table.merge(spark.createDataFrame([("a", 1)], "k STRING, v INT"), lambda old, new: first.unionByName(new))
    assert table.version() == 2 and table.read().count() == 3  # what failed is not seen


def test_folded_evidence_keeps_what_is_shown(spark):
    rnd = random.Random(3)
    rows = [(i, "a", rnd.choice("bc"), "T", 1.0, 1.0, "".join(rnd.choice("xyz") for _ in range(rnd.randrange(0, 6)))) for i in range(200)]
    df = spark.createDataFrame(
        rows, "seq long, source_id string, target_id string, type string, weight double, confidence double, evidence string"
    ).withColumn("updated_at", F.lit(None).cast("timestamp"))
    shown = {(r["source_id"], r["target_id"]): r["evidence"] for r in merge.merge_edges_display(df).collect()}
    found = {}
    for r in sorted(merge.folded_evidence(df).collect(), key=lambda r: r["seen"]):
        found.setdefault(r["edge_key"], []).append(r["text"])
    assert {k: "; ".join(v) for k, v in found.items()} == {f"{a}->{b}:T": x for (a, b), x in shown.items()}


def test_many_distinct_texts_of_one_key(spark):
    df = spark.range(100_000).selectExpr(
        "id AS seq", "'a' AS source_id", "'b' AS target_id", "'T' AS type", "concat('text ', id) AS evidence", "1.0D AS confidence"
    )
    assert merge.folded_evidence(df).count() >= 90_000  # "text 1" is part of none that came before it


def test_levels_of_a_hierarchy(spark):
    block = "### 层次结构\n# top\n  - a\n\n\t* b\n    + c\n  d\n- e\n      f\n   g"
    rows = [(1, block), (2, "no block"), (3, None), (4, "### 层次结构\n" + "\n".join(" " * i + "x" for i in range(300)))]
    found = extract.extract_levels(spark.createDataFrame(rows, "seq long, raw string")).collect()
    got = {(r["line"], r["level"], r["title"], r["parent"]) for r in found if r["seq"] == 1}
    assert got == {(1, 1, "# top", None), (2, 2, "a", 1), (3, 3, "b", 2), (4, 3, "c", 2), (5, 2, "d", 1), (6, 1, "e", None), (7, 2, "f", 6), (8, 2, "g", 6)}
    assert not [r for r in found if r["seq"] in (2, 3)]
    assert {(r["level"], r["parent"]) for r in found if r["seq"] == 4} == {(i + 1, i or None) for i in range(300)}


def test_sketches_merge_within_their_bound(spark):
    calls = spark.range(60_000).selectExpr(
        "'a' AS agent", "'p' AS provider", "concat('m', id % 2) AS model", "timestamp_seconds(id * 10) AS ts",
        "CASE WHEN id % 50 = 0 THEN NULL ELSE CAST(pow(id * 7919 % 60000, 1.5) AS BIGINT) END AS latency_ms",
    )
    sketches = telemetry.latency_sketches(calls)
    assert sketches.count() == 2 * 7 and sketches.agg(F.max(F.length("sketch"))).first()[0] < 10_000
    found = telemetry.latency_percentiles(sketches, ["agent"], [0.1, 0.5, 0.99]).first()
    exact = calls.where("latency_ms IS NOT NULL")
    assert found["calls"] == exact.count()
    for q in (0.1, 0.5, 0.99):
        share = exact.where(F.col("latency_ms") <= found[f"p{q * 100:g}"]).count() / found["calls"]
        assert abs(share - q) < 0.01
    empty = telemetry.latency_sketches(calls.withColumn("latency_ms", F.lit(None).cast("long")))
    assert telemetry.latency_percentiles(empty, ["agent"]).collect() == []


def test_texts_of_small_keys_are_not_cut_into_characters(spark, monkeypatch):
    rows = [(1, "a", "b", "long text"), (2, "a", "b", "text"), (3, "a", "b", "other"), (4, "a", "c", "text"), (5, None, "c", "text"), (6, None, "c", "tex")]
    df = spark.createDataFrame(rows, "seq long, source_id string, target_id string, evidence string").withColumn("type", F.lit("T"))
    monkeypatch.setattr(merge, "containing", None)
    found = sorted((r["edge_key"] or "", r["text"], r["seen"]) for r in merge.folded_evidence(df).collect())
    assert found == [("", "tex", 6), ("", "text", 5), ("a->b:T", "long text", 1), ("a->b:T", "other", 3), ("a->c:T", "text", 4)]


def test_rows_of_other_scopes_stay_where_they_are(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4)], "scope string, n int").repartition(3, "n")
    scopes = spark.createDataFrame([("a",), (None,), ("z",)], "scope string")
    left = stored_graph._outside(rows, scopes)
    assert sorted(r["n"] for r in left.collect()) == [2, 3, 4]
    plan = left._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_replacing_sections_keeps_the_neighbours_in_a_bucket(spark, tmp_path):
    stored = stored_graph.open_graph(spark, str(tmp_path / "one"), 1)  # every scope shares the bucket
    stored.nodes.write(nodes(spark, [(i, "section:a", f"n{i}", "T", "x", "d") for i in range(4)]))
    old = edges(spark, [(1, "a", "n0", "n1", "R"), (2, "b", "n0", "n2", "R"), (3, None, "n1", "n2", "R")])
    stored.edges.write(old, placed=True)
    new = spark.createDataFrame(
        [(7, "a", "n2", "n3", "R"), (8, None, "n1", "n2", "R"), (9, "a", "n2", "gone", "R")],
        "seq long, src_section string, source_id string, target_id string, type string",
    ).withColumns({"created_at": now(), "updated_at": now()})
    batch = nodes(spark, []).withColumn("src_section", F.lit("a"))
    stored_graph.replace_sections(stored, batch, new, now())
    found = sorted((r["scope"] or "", r["seq"]) for r in stored.edges.read().collect())
    assert found == [("", 8), ("section:a", 7), ("section:b", 2)]
    kept = stored.edges.read().where("scope = 'section:b'")
    assert content(kept) == content(old.where("scope = 'section:b'"))


def test_stored_nodes_alone(spark):
    from kgspark.catalog import bucket_queries
    from kgspark.catalog.registry import Data

    d = Data(spark, "/root/testdata/sf0.001")
    stored = bucket_queries._stored_nodes(d)
    assert stored.nodes.read().count() == d.table("part").count() and stored.edges.version() == -1
