"""Neighbourhoods of many centers, chunks and searches against the single calls and against all paths."""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from itertools import product

import pytest

from kgspark.operators import graph_queries, neighbourhoods, retrieval

NODES = "id STRING, scope STRING, name STRING, type STRING, aliases ARRAY<STRING>, seq BIGINT"
EDGES = "rid STRING, scope STRING, source_id STRING, target_id STRING, confidence DOUBLE"


def random_graph(spark, seed, nodes=14, edges=45, hub=30):
    rnd = random.Random(seed)
    ids = [f"n{i:02d}" for i in range(nodes)]
    rows = [(f"r{i:03d}", "s", rnd.choice(ids), rnd.choice(ids), rnd.choice([None, 0.1, 0.5, 0.9, 1.0])) for i in range(edges)]
    rows += [(f"h{i:03d}", "s", "n00", rnd.choice(ids[1:]), rnd.random()) for i in range(hub)]
    rows += [("r000", "t", "n01", "n02", 0.3), ("x1", "t", "n03", "n03", 0.2)]
    named = [(i, "s", f"name {i[-1]} {'hub' if i == 'n00' else ''}".strip(), "T", [f"also {i}"], k) for k, i in enumerate(ids)]
    return spark.createDataFrame(named, NODES), spark.createDataFrame(rows, EDGES), ids, rows


def trail_rows(df, *keys):
    return sorted((*[r[k] for k in keys], r["length"], tuple(r["rids"]), tuple(r["node_ids"])) for r in df.collect())


@pytest.mark.parametrize("limit", [1, 7, 40])
@pytest.mark.parametrize("depth", [1, 2, 3])
def test_first_trails_equal_those_of_each_center(spark, limit, depth):
    _, edges, ids, rows = random_graph(spark, depth * 100 + limit)
    centers = spark.createDataFrame([(i,) for i in [*ids, "unknown"]], "center STRING")
    got = trail_rows(neighbourhoods.first_trails_of(edges, centers, depth, limit), "center")
    arcs = {(r, a, b) for r, _, a, b, _ in rows} | {(r, b, a) for r, _, a, b, _ in rows}
    expected = []
    for center in ids:
        trails, frontier = [], [((), (center,))]
        for _ in range(depth):
            frontier = sorted(((*rids, r), (*path, b)) for rids, path in frontier for r, a, b in arcs if a == path[-1] and r not in rids)
            trails += frontier
            frontier = frontier[:3000]
        trails.sort(key=lambda x: (len(x[0]), x))
        expected += [(center, len(r), r, p) for r, p in trails[:limit]]
    assert got == sorted(expected)


def test_k_hop_all_equals_k_hop(spark):
    nodes, edges, ids, _ = random_graph(spark, 5)
    centers = spark.createDataFrame([(i,) for i in [*ids[:5], ids[0], "unknown", None]], "center STRING")
    found = neighbourhoods.k_hop_all(nodes, edges, centers, 2, 25, "s")
    many_nodes, many_edges = defaultdict(set), defaultdict(set)
    for r in found.nodes.collect():
        many_nodes[r["center"]].add((r["id"], r["is_center"]))
    for r in found.edges.collect():
        many_edges[r["center"]].add(r["rid"])
    for i in [*ids[:5], "unknown"]:
        one = graph_queries.k_hop(nodes, edges, i, 2, 25, "s")
        assert many_nodes.get(i, set()) == {(r["id"], r["is_center"]) for r in one.nodes.collect()}
        assert many_edges.get(i, set()) == {r["rid"] for r in one.edges.collect()}


def _written(monkeypatch):
    """Columns and rows of what the operators write to go on from."""
    written, cut = [], neighbourhoods.cut_lineage

    def listed(df):
        out = cut(df)
        written.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(neighbourhoods, "cut_lineage", listed)
    return written


def test_first_trails_write_a_row_a_node(spark, monkeypatch):
    _, edges, ids, _ = random_graph(spark, 5)
    written = _written(monkeypatch)
    centers = spark.createDataFrame([(i,) for i in ids], "center STRING")
    assert neighbourhoods.first_trails_of(edges, centers, 2, 6).count() == 6 * len(ids)
    assert written and max(n for _, n in written) <= len(ids)


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _read_again(df, columns):
    """How often the final plan reads a shuffle of these columns that it has read before."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    row = ", ".join(rf"{c}#\d+" for c in columns)
    return len(re.findall(rf"ReusedExchange \[{row}\]", plan))


def test_first_trails_shuffle_relations_once(spark, no_broadcast):
    _, edges, ids, _ = random_graph(spark, 5)
    centers = spark.createDataFrame([(i,) for i in ids], "center STRING")
    found = neighbourhoods.first_trails_of(edges, centers, 2, 40)
    assert _read_again(found, ["here", "arcs"]) == 1


def test_k_hop_all_shuffles_relations_once(spark, no_broadcast):
    nodes, edges, ids, _ = random_graph(spark, 5)
    found = neighbourhoods.k_hop_all(nodes, edges, spark.createDataFrame([(i,) for i in ids], "center STRING"), 2, 40)
    assert _read_again(found.edges.select("center", "rid"), ["here", "arcs"]) == 1


def test_first_trails_of_starts_that_come_twice(spark):
    edges = spark.createDataFrame([("r1", "s", "a", "b", 1.0), ("r2", "s", "b", "c", 1.0)], EDGES)
    centers = spark.createDataFrame([("a",), ("a",), ("c",)], "center STRING")
    for limit, counts in ((1, [1, 1]), (3, [3, 2]), (9, [4, 2])):
        got = trail_rows(neighbourhoods.first_trails_of(edges, centers, 2, limit), "center")
        assert [sum(x[0] == c for x in got) for c in "ac"] == counts


def test_entities_of_chunks_are_chosen_by_their_keys(spark, monkeypatch):
    nodes, edges, ids, _ = random_graph(spark, 6)
    mentions = spark.createDataFrame([("c1", i) for i in ids] + [("c2", "n01")], "chunk_id STRING, node_id STRING")
    written = _written(monkeypatch)
    found = neighbourhoods.chunk_entities_all(mentions, nodes.unionByName(nodes), edges, limit=3)
    assert sorted((r["chunk_id"], r["id"], r["name"] is None) for r in found.entities.collect()) == [
        ("c1", "n00", False), ("c1", "n00", False), ("c1", "n01", False), ("c2", "n01", False), ("c2", "n01", False)
    ]
    assert not any("name" in columns for columns, _ in written)


def test_links_are_turned_after_they_met(spark):
    _, edges, _, _ = random_graph(spark, 7)
    plan = retrieval.undirected_links(edges)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")


def test_chunk_entities_all_equals_single_chunks(spark):
    nodes, edges, ids, _ = random_graph(spark, 6)
    rnd = random.Random(6)
    pairs = [(f"c{c}", rnd.choice(ids)) for c in range(4) for _ in range(5)] + [("c9", "unknown"), (None, ids[0])]
    mentions = spark.createDataFrame(pairs, "chunk_id STRING, node_id STRING")
    found = neighbourhoods.chunk_entities_all(mentions, nodes, edges, "s", limit=3, paths=9)
    entities, paths = defaultdict(list), defaultdict(list)
    for r in found.entities.collect():
        entities[r["chunk_id"]].append(r["id"])
    for r in found.paths.collect():
        paths[r["chunk_id"]].append((r["center"], tuple(r["rids"]), tuple(r["node_ids"])))
    for c in ("c0", "c1", "c2", "c3", "c9"):
        one = graph_queries.chunk_entities(c, mentions, nodes, edges, "s", limit=3, paths=9)
        assert sorted(entities.get(c, [])) == sorted(r["id"] for r in one.entities.collect())
        assert sorted(paths.get(c, [])) == sorted((r["center"], tuple(r["rids"]), tuple(r["node_ids"])) for r in one.paths.collect())


def test_a_hub_is_not_expanded_beyond_the_limit(spark):
    edges = spark.range(20_000).selectExpr(
        "concat('r', lpad(id, 6, '0')) AS rid", "'s' AS scope", "'hub' AS source_id", "concat('leaf', id) AS target_id", "1.0D AS confidence"
    )
    centers = spark.range(200).selectExpr("concat('leaf', id) AS center")
    trails = neighbourhoods.first_trails_of(edges, centers, 2, 10)
    assert trails.groupBy("center").count().select("count").distinct().collect() == [(10,)]


def test_search_nodes_all_equals_search_nodes(spark):
    nodes, _, _, _ = random_graph(spark, 7)
    more = [("m1", "s", "Hub", "T", None, 90), ("m2", "s", "hub of hubs", "T", ["the hub"], 91), ("m3", "s", None, "T", ["HUB", None], 92)]
    nodes = nodes.unionByName(spark.createDataFrame(more, NODES))
    asked = [("q1", "hub"), ("q2", "HUB"), ("q3", "n0"), ("q4", "a"), ("q5", "nothing like it"), ("q6", ""), ("q7", None), ("q8", "also n1")]
    found = neighbourhoods.search_nodes_all(nodes, spark.createDataFrame(asked, "query_id STRING, query STRING"), 5).collect()
    for q, text in asked[:5] + asked[7:]:
        got = [r["id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert got == [r["id"] for r in graph_queries.search_nodes(nodes, text, limit=5).collect()], q
    assert not [r for r in found if r["query_id"] in ("q6", "q7")]


def brute_topk(rows, supports, seeds, hops, k):
    links = defaultdict(float)
    for _, _, a, b, c in rows:
        if a != b:
            for pair in ((a, b), (b, a)):
                links[pair] = max(links[pair], c or 0.0)
    out = {}
    for q, starts in seeds.items():
        best = {}
        frontier = [((s,), 0.0) for s in starts]
        for _ in range(hops):
            frontier = [((*p, b), c + w) for p, c in frontier for (a, b), w in links.items() if a == p[-1] and b not in p]
            for path, total in frontier:
                n = len(path) - 1
                support = sum(supports.get(x, 0) for x in path)
                score = 0.6 / n + 0.3 * total / n + 0.1 * math.log1p(support)
                best[path[-1]] = min(best.get(path[-1], (0, ())), (-score, path))
        ranked = sorted((round(s, 9), node, path) for node, (s, path) in best.items())[:k]
        out[q] = [(node, -s) for s, node, _ in ranked]
    return out


@pytest.mark.parametrize(("hops", "k"), [(1, 3), (2, 8), (2, 2), (3, 4)])
def test_kg_topk_equals_all_paths(spark, hops, k):
    nodes, edges, ids, rows = random_graph(spark, 10 * hops + k, nodes=16, edges=40, hub=12)
    rnd = random.Random(k)
    pairs = [(f"c{rnd.randrange(30)}", rnd.choice(ids)) for _ in range(60)]
    supports = {i: len({c for c, n in pairs if n == i}) for i in ids}
    asked = [("q1", "hub"), ("q2", "name 3"), ("q3", "also n1"), ("q4", "unheard")]
    queries = spark.createDataFrame(asked, "query_id STRING, query STRING")
    mentions = spark.createDataFrame(pairs, "chunk_id STRING, node_id STRING")
    found = neighbourhoods.kg_topk(nodes, edges, mentions, queries, hops, k, seeds=4).collect()
    seeds = {q: [r["id"] for r in graph_queries.search_nodes(nodes, text, limit=4).collect()] for q, text in asked}
    expected = brute_topk(rows, supports, seeds, hops, k)
    for q, _ in asked:
        got = [(r["node_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert [round(s, 9) for _, s in got] == [round(s, 9) for _, s in expected[q]], q
        assert {n for n, _ in got} == {n for n, _ in expected[q]} or len({round(s, 9) for _, s in got}) < len(got)
    for r in found:
        assert r["path"][0] == r["seed"] and r["path"][-1] == r["node_id"] and len(r["path"]) == r["length"] + 1


@pytest.mark.parametrize("directed", [True, False])
def test_explain_paths_either_way(spark, directed):
    _, edges, ids, rows = random_graph(spark, 21, nodes=10, edges=14, hub=8)
    pairs = [(a, b) for a, b in product([*ids, "unknown", None], repeat=2)]
    links = {}
    for _, _, a, b, c in rows:
        for x, y in ((a, b),) if directed else ((a, b), (b, a)):
            if x != y:
                links[x, y] = max(links.get((x, y), 0.0), c or 0.0)
    expected = {}
    for a, b in pairs:
        found = [(1, -links[a, b], "")] if (a, b) in links else []
        found += [(2, -(links[a, v] + links[v, b]) / 2, v) for v in ids if (a, v) in links and (v, b) in links and v not in (a, b)]
        if found and a != b:
            length, doubt, via = min(found)
            expected[a, b] = (length, via or None, round(-doubt, 9))
    got = retrieval.explain_paths(edges, spark.createDataFrame(pairs, "a STRING, b STRING"), directed).collect()
    assert {(r["a"], r["b"]): (r["length"], r["via"], round(r["confidence"], 9)) for r in got} == expected


def test_empty_graphs(spark):
    nodes, edges = spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)
    mentions = spark.createDataFrame([], "chunk_id STRING, node_id STRING")
    queries = spark.createDataFrame([("q", "a")], "query_id STRING, query STRING")
    assert neighbourhoods.kg_topk(nodes, edges, mentions, queries).collect() == []
    assert neighbourhoods.k_hop_all(nodes, edges, spark.createDataFrame([("a",)], "center STRING")).edges.collect() == []
    assert neighbourhoods.chunk_entities_all(mentions, nodes, edges).paths.collect() == []
