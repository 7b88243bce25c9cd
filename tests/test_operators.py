"""Operators on small hand-worked tables and against brute force."""

from __future__ import annotations

import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from kgspark.functions import ids
from kgspark.operators import (
    assemble,
    clean,
    components,
    extract,
    graph_queries,
    identity,
    merge,
    ordering,
    quality,
    sections,
    store,
    telemetry,
)
from kgspark.plans.graph_build import build_section_graphs, section_insights
from kgspark.session import cut_unsized

NODE = "seq long, scope string, id string, name string, type string, description string, aliases array<string>"
EDGE = "seq long, scope string, rid string, source_id string, target_id string, type string"


def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def node(seq, id_, name="n", type_="Concept", description="", aliases=(), scope="s"):
    return (seq, scope, id_, name, type_, description, list(aliases))


def edge(seq, source, target, type_="T", scope="s"):
    return (seq, scope, f"r{seq}", source, target, type_)


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# ------------------------------------------------------------------ extraction


def test_validation_forms(spark):
    reports = spark.createDataFrame(
        [
            (1, "评分: 8.5 / 10\n是否通过：否"),
            (2, "  "),
            (3, "overall 9/10 and 总评分 4/10\n重写建议：more\nlines\n\n## next"),
            (4, "nothing"),
            (5, None),
        ],
        "id long, report string",
    )
    got = {r["id"]: r for r in extract.extract_validation(reports).collect()}
    assert (got[1]["score"], got[1]["verdict_passed"], got[1]["is_passed"]) == (8.5, False, True)
    assert (got[2]["score"], got[2]["is_passed"], got[2]["verdict_passed"]) == (5.0, False, False)
    assert (got[3]["score"], got[3]["rewrite_suggestions"]) == (4.0, "more\nlines")
    assert got[4]["score"] == 5.0 and got[5]["score"] == 5.0


def test_outline_rejects_name_the_first_fault(spark):
    long = "x" * 30

    def doc(title="t", outline="o", subs=f'[{{"title": "s", "outline": "{long}"}}]'):
        return f'{{"chapters": [{{"title": "{title}", "outline": "{outline}", "subchapters": {subs}}}]}}'

    cases = {
        1: doc(),
        2: "no braces",
        3: "{broken",
        4: "{broken}",
        5: '{"chapters": []}',
        6: doc(title=" "),
        7: doc(outline=""),
        8: doc(subs="[]"),
        9: doc(subs=f'[{{"title": "", "outline": "{long}"}}]'),
        10: doc(subs=f'[{{"title": "s", "outline": "{"x" * 29}"}}]'),
        11: "```JSON\n" + doc() + "\n```",
        12: "text ```\n" + doc() + "```",
    }
    outputs = spark.createDataFrame(list(cases.items()), "id long, raw string")
    parsed = extract.extract_outline(outputs)
    assert pairs(parsed.rows, "id") == [(1,), (11,), (12,)]
    assert dict(pairs(parsed.rejects, "id", "reason")) == {
        2: "no_json",
        3: "no_json",
        4: "bad_json",
        5: "no_chapters",
        6: "chapter_without_title",
        7: "chapter_without_outline",
        8: "chapter_without_subchapters",
        9: "subchapter_without_title",
        10: "subchapter_outline_too_short",
    }


def test_graph_markdown(spark):
    raw = "### 节点\n- a: x: y\n-b: no\n- c\n### 其他\n### 节点\n- d: z\n### 关系\n- a -> b -> c: t: u\n### 层次结构\n h \n"
    outputs = spark.createDataFrame([(1, "T", "C", "S", raw)], "seq long, topic string, chapter string, subchapter string, raw string")
    assert pairs(extract.extract_nodes(outputs), "name", "description") == [("a", "x: y")]
    assert pairs(extract.extract_edges(outputs), "source_name", "target_name", "type") == [("a", "b -> c", "T: U")]
    assert pairs(extract.extract_hierarchy(outputs), "hierarchy") == [("h",)]


def test_research_without_blocks(spark):
    row = extract.extract_research(spark.createDataFrame([(1, "nothing here")], "id long, raw string")).first()
    assert (row["keywords"], row["summary"], row["key_concepts"]) == ([], "", [])


# ------------------------------------------------------------------------- ids


def test_last_mapping_of_a_raw_id_wins_and_final_ids_are_accepted(spark):
    nodes = spark.createDataFrame(
        [node(1, "a", "First"), node(2, "a", "Second"), node(3, "b", "Other")], NODE
    )
    edges = spark.createDataFrame(
        [edge(1, "a", "b"), edge(2, "first_s", "b"), edge(3, "a", "gone"), edge(4, "a", "b")], EDGE
    ).withColumn("description", F.lit(""))
    named, linked = identity.assign_idempotent_ids(nodes, edges, ["scope"])
    assert pairs(named, "seq", "id") == [(1, "first_s"), (2, "second_s"), (3, "other_s")]
    assert pairs(linked, "seq", "source_id", "target_id") == [(1, "second_s", "other_s"), (2, "first_s", "other_s")]


# ----------------------------------------------------------------------- merge


def test_merge_nodes_ties_and_single_rows(spark):
    nodes = spark.createDataFrame(
        [
            node(1, "a", "N", "T", "aa", ["z"]),
            node(2, "b", " N ", "T", "bb", ["y", "z"]),
            node(3, "c", "M", "T", None, ["q", "p"]),
        ],
        NODE,
    )
    merged = merge.merge_nodes(nodes, "book:x")
    assert pairs(merged, "id", "description", "aliases", "scope") == [
        ("a", "aa", ["y", "z"], "book:x"),
        ("c", None, ["q", "p"], "book:x"),
    ]


def test_edges_of_merged_nodes_are_dropped_unless_remapped(spark):
    nodes = spark.createDataFrame([node(1, "a", "N"), node(2, "b", "N"), node(3, "c", "M")], NODE)
    edges = spark.createDataFrame([edge(1, "b", "c"), edge(2, "a", "c", "U")], EDGE)
    chapters = spark.createDataFrame([("c1",)], "chapter string")
    plain = merge.merge_book(nodes, edges, chapters, "book:x", "t")
    moved = merge.merge_book(nodes, edges, chapters, "book:x", "t", remap_edges=True)
    assert pairs(plain.edges, "source_id", "type") == [("a", "U")]
    assert pairs(moved.edges, "source_id", "type") == [("a", "T"), ("a", "U")]


def test_incremental_merge_equals_whole_merge(spark):
    rnd = random.Random(1)
    rows = [node(i, f"n{i}", f"name{rnd.randrange(6)}", "T", "d" * rnd.randrange(9), [str(i)]) for i in range(40)]
    links = [edge(i, f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}") for i in range(80)]
    nodes, edges = spark.createDataFrame(rows, NODE), spark.createDataFrame(links, EDGE)
    chapters = spark.createDataFrame([("c1",)], "chapter string")
    whole = merge.merge_book(nodes, edges, chapters, "book:x", "t")
    first = merge.merge_book(nodes.where("seq < 20"), edges, chapters, "book:x", "t")
    grown = merge.merge_incremental(
        first.nodes, first.edges, nodes.where("seq >= 20"), edges.limit(0), chapters, "book:x", "t"
    )
    assert pairs(grown.nodes, "id", "description", "aliases") == pairs(whole.nodes, "id", "description", "aliases")


def test_display_merge_drops_keyless_and_keeps_structure(spark):
    schema = NODE + ", canonical_key string, score double, updated_at timestamp"
    nodes = spark.createDataFrame(
        [
            (*node(1, "a", "N", "concept", "x", ["1"]), "k", None, None),
            (*node(2, "b", "M", "concept", "xyz", ["2", "1"]), "k", 0.5, None),
            (*node(3, "c", "M", "concept"), "", 0.5, None),
            (*node(4, "d", "M", "chapter"), None, 0.1, None),
            (*node(5, "d", "M2", "chapter"), None, 0.9, None),
        ],
        schema,
    )
    merged = merge.merge_nodes_display(nodes)
    assert pairs(merged, "id", "name", "description", "aliases", "score") == [
        ("a", "N", "xyz", ["1", "2"], 0.5),
        ("d", "M", "", [], 0.1),
    ]


def brute_display(rows):
    groups: dict = {}
    for seq, source, target, type_, weight, confidence, evidence in sorted(rows):
        groups.setdefault((source, target, type_), []).append((weight, confidence, evidence))
    out = []
    for key, members in groups.items():
        weight = reduce(lambda a, b: (a + b) / 2, [m[0] for m in members])
        text = ""
        for m in members:
            if m[2] and m[2] not in text:
                text = f"{text}; {m[2]}" if text else m[2]
        out.append((*key, round(weight, 9), max(m[1] for m in members), text))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 3, 1000])
def test_display_edges_equal_a_row_by_row_fold(spark, seed):
    rnd = random.Random(seed)
    rows = [
        (i, f"a{rnd.randrange(2)}", "b", "T", rnd.random() * 9, rnd.random(), rnd.choice(["x", "xy", "", "q", "zz"]))
        for i in range(200)
    ]
    edges = spark.createDataFrame(
        rows, "seq long, source_id string, target_id string, type string, weight double, confidence double, evidence string"
    ).withColumn("updated_at", F.lit(None).cast("timestamp"))
    got = [
        (r["source_id"], r["target_id"], r["type"], round(r["weight"], 9), r["confidence"], r["evidence"])
        for r in merge.merge_edges_display(edges).collect()
    ]
    assert sorted(got) == brute_display(rows)


def test_running_mean_and_long_evidence(spark):
    rows = [
        (1, "a", "b", "T", 1.0, 0.5, "e"),
        (2, "a", "b", "T", 3.0, 0.6, "e"),
        (3, "a", "b", "T", 9.0, None, ""),
        (4, "a", "b", "T", 4.0, 0.1, "f"),
        (5, "a", "b", "T", None, None, "long evidence of more than twenty"),
        (6, "", "b", "T", 1.0, 1.0, "e"),
    ]
    edges = spark.createDataFrame(
        rows, "seq long, source_id string, target_id string, type string, weight double, confidence double, evidence string"
    ).withColumn("updated_at", F.lit(None).cast("timestamp"))
    got = {r["evidence"]: (r["weight"], r["confidence"]) for r in merge.merge_edges_display(edges).collect()}
    assert got == {"e; f": (4.75, 0.6), "long evidence of more than twenty": (None, None)}


# --------------------------------------------------------------------- quality


def union_find(ids_, links):
    parent = {i: i for i in ids_}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        if a in parent and b in parent:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return sorted((i, root(i)) for i in ids_)


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rnd = random.Random(seed)
    names = [f"v{i:03d}" for i in range(120)]
    links = [(rnd.choice(names), rnd.choice(names + ["unknown"])) for _ in range(90)]
    links += [(names[i], names[i + 1]) for i in range(60, 100)] + [("v000", n) for n in names[:15]]
    nodes = spark.createDataFrame([node(i, n) for i, n in enumerate(names)], NODE)
    edges = spark.createDataFrame([edge(i, a, b) for i, (a, b) in enumerate(links)], EDGE)
    assert pairs(components.connected_components(nodes, edges), "id", "component") == union_find(names, links)


def test_components_without_edges(spark):
    nodes = spark.createDataFrame([node(1, "a"), node(2, "b")], NODE)
    edges = spark.createDataFrame([], EDGE)
    assert pairs(components.connected_components(nodes, edges), "id", "component") == [("a", "a"), ("b", "b")]


def test_evaluation_of_an_empty_side(spark):
    nodes = spark.createDataFrame([node(1, "a", "Deep Learning"), node(2, "b", "x")], NODE).withColumn(
        "subchapter", F.when(F.col("id") == "a", "s1").otherwise("未知子章节")
    )
    edges = spark.createDataFrame([edge(1, "a", "b"), edge(2, "a", "z"), edge(3, "q", "z", scope="other")], EDGE)
    outline = spark.createDataFrame([("s", "c", "s1"), ("s", "c2", None)], "scope string, chapter string, subchapter string")
    keywords = spark.createDataFrame([("s", "LEARN"), ("s", "zzz"), ("s", "x")], "scope string, keyword string")
    got = {r["scope"]: r for r in quality.evaluate_graph(nodes, edges, outline, keywords).collect()}
    s, other = got["s"], got["other"]
    assert (s["components"], s["connectivity_score"], s["relation_richness"]) == (1, 1.0, 1.0)
    assert s["subchapter_coverage"] == 0.5 and round(s["keyword_coverage"], 6) == round(2 / 3, 6)
    assert (other["connectivity_score"], other["relation_richness"], other["subchapter_coverage"]) == (0.0, 0.0, 1.0)
    assert "- 节点数量: 2" in s["kg_summary"]


def test_empty_graphs_are_measured(spark):
    outline = spark.createDataFrame([("o", "c", "t")], "scope string, chapter string, subchapter string")
    keywords = spark.createDataFrame([("k", "word")], "scope string, keyword string")
    nodes, edges = spark.createDataFrame([], NODE + ", subchapter string"), spark.createDataFrame([], EDGE)
    got = quality.evaluate_graph(nodes, edges, outline, keywords)
    assert pairs(got, "scope", "total_nodes", "subchapter_coverage", "keyword_coverage", "connectivity_score") == [
        ("k", 0, 1.0, 0.0, 0.0),
        ("o", 0, 0.0, 1.0, 0.0),
    ]
    assert all("- 关系数量: 0" in r["kg_summary"] for r in got.collect())


def test_pair_components_equal_connected_components(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice("xy"), rnd.randrange(80), rnd.randrange(80)) for _ in range(70)] + [("x", 500, i) for i in range(600, 700)] + [("z", 3, 3)]
    edges = spark.createDataFrame(rows, "scope string, a long, b long")
    ends = edges.where("a <> b").selectExpr("scope", "explode(array(a, b)) AS id").distinct()
    expected = components.connected_components(ends, edges, ["scope"], "a", "b").select("scope", "id", "component")
    found = components.pair_components(edges, "a", "b", ["scope"])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    assert components.pair_components(edges.limit(0), "a", "b").collect() == []


def test_keyword_hits_equal_containment(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abC 机") for _ in range(rnd.randrange(1, 9))) for _ in range(60)]
    texts = ["".join(rnd.choice("aBc 机") for _ in range(30)) for _ in range(25)]
    nodes = spark.createDataFrame([node(i, f"n{i}", x, description=x[::-1], aliases=[x[3:9]]) for i, x in enumerate(texts)], NODE)
    keywords = spark.createDataFrame([("s", w) for w in set(words)], "scope string, keyword string")
    expected = {w for w in words for x in texts for y in (x, x[::-1], x[3:9]) if w.lower() in y.lower()}
    assert {r["keyword"] for r in quality.keyword_hits(nodes, keywords).collect()} == expected


# ----------------------------------------------------------------------- store


STORED = "scope string, id string, name string, created_at timestamp, updated_at timestamp, seq long"


def test_upserts_are_idempotent(spark):
    import datetime as dt

    old, new = dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1)
    existing = spark.createDataFrame([("s", "a", "A", old, old, 1), ("s", "b", "B", old, old, 2)], STORED)
    incoming = spark.createDataFrame(
        [("s", "a", None, new, new, 1), ("s", "c", "C1", new, new, 2), ("s", "c", "C2", old, new, 3)], STORED
    )
    once = store.upsert_nodes(existing, incoming)
    assert pairs(once.where("id <> 'a'"), "id", "name", "created_at") == [("b", "B", old), ("c", "C2", new)]
    assert once.where("id = 'a'").first()["name"] is None
    assert pairs(store.upsert_nodes(once, incoming), *once.columns[1:2]) == [("a",), ("b",), ("c",)]
    assert sorted(map(str, store.upsert_nodes(once, incoming).collect())) == sorted(map(str, once.collect()))
    overlaid = store.overlay_properties(existing, incoming, store.NODE_KEY, now())
    assert overlaid.where("id = 'a'").first()["name"] == "A"
    assert store.upsert_stats(existing, incoming, store.NODE_KEY).first().asDict() == {"created": 1, "updated": 2}


def test_delete_scope_spares_nodes_in_use(spark):
    nodes = spark.createDataFrame([node(1, "a"), node(2, "b"), node(3, "c", scope="t")], NODE)
    edges = spark.createDataFrame([edge(1, "a", "b"), edge(2, "a", "c", scope="t")], EDGE)
    soft, hard = store.delete_scope(nodes, edges, "s"), store.delete_scope_hard(nodes, edges, "s")
    assert pairs(soft.nodes, "id") == [("a",), ("c",)] and soft.deleted.first()["deleted"] == 2
    assert pairs(hard.nodes, "id") == [("c",)] and hard.deleted.first()["deleted"] == 3


def test_promotion_is_idempotent(spark):
    edges = (
        spark.createDataFrame([edge(1, "a", "b", scope="section:1"), edge(2, "a", "b", scope="section:2")], EDGE)
        .withColumns({"src_section": F.lit("1"), "confidence": F.lit(None).cast("double"), "weight": F.lit(2.0)})
    )
    chosen = spark.createDataFrame([("1",), ("2",)], "section_id string")
    once = store.replace_book_edges(edges, chosen, "book:x")
    twice = store.replace_book_edges(once, chosen, "book:x")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    book = once.where("scope = 'book:x'").collect()
    assert [(r["seq"], r["confidence"], r["src_section"]) for r in book] == [(2, 0.8, None)]


# ----------------------------------------------------------------- graph reads


def brute_trails(links, center, depth):
    found, frontier = [], [((), (center,))]
    for _ in range(depth):
        step = []
        for rids, path in frontier:
            for rid, a, b in links:
                if rid in rids:
                    continue
                for x, y in {(a, b), (b, a)}:
                    if x == path[-1]:
                        step.append(((*rids, rid), (*path, y)))
        found += step
        frontier = step
    return found


@pytest.mark.parametrize("limit", [3, 12, 10_000])
def test_trails_equal_brute_force(spark, limit):
    rnd = random.Random(limit)
    links = [(f"r{i:02d}", f"n{rnd.randrange(7)}", f"n{rnd.randrange(7)}") for i in range(14)] + [("rx", "n0", "n0")]
    edges = spark.createDataFrame(links, "rid string, source_id string, target_id string")
    expected = sorted(brute_trails(links, "n0", 3), key=lambda p: (len(p[0]), p))
    got = graph_queries.first_trails(edges, ["n0"], 3, limit)
    assert [(tuple(r["rids"]), tuple(r["node_ids"])) for r in got.orderBy("length", "rids", "node_ids").collect()] == expected[:limit]
    centers = spark.createDataFrame([("n0",)], "center string")
    assert graph_queries.all_trails(edges, centers, 3).count() == len(expected)


def test_k_hop_of_unknown_or_lonely_node_is_empty(spark):
    nodes = spark.createDataFrame([node(1, "a"), node(2, "b")], NODE)
    edges = spark.createDataFrame([edge(1, "b", "b")], EDGE)
    for center in ("a", "zzz"):
        graph = graph_queries.k_hop(nodes, edges, center)
        assert graph.nodes.count() == 0 and graph.edges.count() == 0
    loop = graph_queries.k_hop(nodes, edges, "b")
    assert pairs(loop.nodes, "id", "is_center") == [("b", True)]


def test_section_view_of_unknown_section_is_empty(spark):
    nodes = spark.createDataFrame([node(1, "a")], NODE)
    edges = spark.createDataFrame([edge(1, "a", "a", scope="book:x")], EDGE).withColumn("src_section", F.lit("1"))
    known = graph_queries.section_view(edges, nodes, "1")
    assert known.edges.count() == 1 and graph_queries.section_view(edges, nodes, "2").edges.count() == 0


# ---------------------------------------------------- sections and documents


def test_attempts(spark):
    rows = [("a", 0, 5.0), ("a", 1, 8.0), ("a", 2, 9.0), ("b", 0, 1.0), ("b", 1, 2.0), ("b", 2, 9.0)]
    attempts = spark.createDataFrame(rows, "section_id string, attempt int, score double")
    assert pairs(sections.resolve_attempts(attempts, 2), "section_id", "attempt") == [("a", 1), ("b", 2)]
    assert pairs(sections.resolve_attempts(attempts, 1), "section_id", "attempt", "is_passed") == [("a", 1, True), ("b", 1, False)]


def test_blocks_written_in_order_are_the_book(spark):
    chapters = spark.createDataFrame([("d", 0, "One", "first"), ("d", 1, "", None), ("e", 0, " ", None)], "doc_id string, chapter_pos int, chapter string, outline string")
    rows = [("d", 0, 0, "s1", "A", None), ("d", 1, 0, "s2", "", "guide"), ("d", 1, 1, "s3", "C", None)]
    placed = spark.createDataFrame(rows, "doc_id string, chapter_pos int, subchapter_pos int, section_id string, subchapter string, outline string")
    content = spark.createDataFrame([("s1", " body "), ("s2", " ")], "section_id string, content string")
    qa = spark.createDataFrame([("s3", "Q")], "section_id string, qa_text string")
    blocks = assemble.book_blocks(chapters, placed, content, qa)
    written = {}
    for r in assemble.assemble_book(blocks).orderBy("chapter_pos", "subchapter_pos", "kind").collect():
        written[r["doc_id"]] = written.get(r["doc_id"], "") + r["content"]
    assert written == {
        "d": "# One\n\n> first\n\n## A\n\nbody\n\n# 章节\n\n## 小节\n\n_导学：guide_\n\n> [内容缺失]\n\n## C\n\n> [内容缺失]\n\n\n### 问答\n\nQ",
        "e": "#",
    }


def test_requests_are_filled_or_rejected(spark):
    asked = [(1, "agent", "a", None), (2, "agent", "b", None), (3, "agent", "c", None)]
    requests = spark.createDataFrame(asked, "request_id int, target_type string, target_id string, locale string")
    requests = requests.withColumn("values", F.create_map(F.lit("x"), F.lit("y")))
    bound = [("agent", "a", "zh", "pa", "p:m", None, 1), ("agent", "b", "zh", "pb", "p:m", None, 1)]
    bindings = spark.createDataFrame(
        bound, "target_type string, target_id string, locale string, prompt_file string, model_ref string, params map<string,string>, position int"
    )
    templates = spark.createDataFrame([("pa", 0, "user", "{{x}}", None)], "prompt_file string, pos int, role string, content string, meta map<string,string>")
    filled = assemble.prompt_batch(requests, bindings, templates, "dp", "dm")
    rejects = assemble.prompt_rejects(requests, bindings, templates)
    assert pairs(filled, "request_id") == [(1,)]
    assert pairs(rejects, "request_id", "reason") == [(2, "no template"), (3, "no binding")]


def test_requests_meet_bindings_and_templates_in_one_join(spark):
    requests = spark.createDataFrame([(1, "agent", "a", None)], "request_id int, target_type string, target_id string, locale string")
    requests = requests.withColumn("values", F.create_map(F.lit("x"), F.lit("y")))
    bindings = spark.createDataFrame(
        [("agent", "a", "zh", "pa", "p:m", None, 1)],
        "target_type string, target_id string, locale string, prompt_file string, model_ref string, params map<string,string>, position int",
    )
    templates = spark.createDataFrame([("pa", 0, "user", "{{x}}", None)], "prompt_file string, pos int, role string, content string, meta map<string,string>")
    filled = assemble.prompt_batch(requests, bindings, templates, "dp", "dm")
    plan = filled._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Window" not in plan  # what meets the requests was written before
    assert [r["messages"][0]["content"] for r in filled.collect()] == ["y"]


def test_placeholders_are_filled_in_one_pass(spark):
    values = F.create_map(F.lit("a"), F.lit("<{{ b }}>"), F.lit("b"), F.lit("B"))
    filled = assemble.fill_placeholders(F.lit("{{ a }}-{{b}}-{{ c }}\n"), values)
    raw = assemble.fill_placeholders(F.lit("x{{ a }}"), values, escape=False)
    assert tuple(spark.range(1).select(filled, raw).first()) == ("&lt;{{ b }}&gt;-B-", "x<{{ b }}>")


# ------------------------------------------------------------------- telemetry


def brute_circuit(calls, threshold, timeout):
    streak, state, opened, out = 0, "active", None, []
    for ts, ok in calls:
        if state == "circuit_open" and ts - opened >= timeout:
            state = "circuit_half_open"
        if ok:
            streak = 0
            if state in ("failed", "circuit_half_open"):
                state = "active"
        else:
            streak += 1
            if streak >= threshold:
                state, opened = "circuit_open", ts
            else:
                state = "failed"
        out.append((streak, state))
    return out


@pytest.mark.parametrize("chunk", ["minute", "hour", "year"])
def test_circuit_states_equal_the_fold(spark, chunk):
    rnd = random.Random(chunk)
    calls, at = [], 0
    for _ in range(300):
        at += rnd.choice([1, 10, 60, 400])
        calls.append((at, rnd.random() < 0.3))
    df = spark.createDataFrame(
        [(i, ts, 200 if ok else 500) for i, (ts, ok) in enumerate(calls)], "seq long, at long, status_code int"
    ).select("seq", F.timestamp_seconds("at").alias("ts"), "status_code", F.lit("p").alias("provider"), F.lit("k").alias("key_id"))
    got = telemetry.circuit_states(df, 3, 300.0, chunk).orderBy("seq").collect()
    assert [(r["consecutive_failures"], r["state"]) for r in got] == brute_circuit(calls, 3, 300)


def test_stage_durations_and_workflow(spark):
    rows = [
        (1, "r", 0, "workflow_start", None),
        (2, "r", 10, "stage_start", "a"),
        (3, "r", 4000, "stage_start", "b"),
        (4, "r", 4010, "stage_end", "b"),
        (5, "r", 9000, "stage_start", "c"),
        (6, "r", 9005, "workflow_end", None),
        (7, "q", 5, "stage_start", "a"),
    ]
    events = spark.createDataFrame(rows, "seq long, run_id string, at long, event string, stage string").withColumn(
        "ts", F.timestamp_seconds("at")
    )
    got = pairs(telemetry.stage_durations(events).where("seconds IS NOT NULL"), "run_id", "stage", "seconds")
    assert got == [("r", "a", 3990.0), ("r", "b", 10.0), ("r", "c", 5.0)]
    assert telemetry.stage_durations(events).where("seconds IS NULL").count() == 1
    assert telemetry.workflow_durations(events).where("run_id = 'r'").first()["seconds"] == 9005.0


def test_final_run_states_do_not_move(spark):
    rows = [(1, "a", "[info] run a started"), (2, "a", "[done] succeeded"), (3, "a", "[error] late"), (4, "b", "x")]
    events = spark.createDataFrame(rows, "seq long, run_id string, message string").withColumn("ts", F.timestamp_seconds("seq"))
    assert pairs(telemetry.run_states(events), "run_id", "status") == [("a", "succeeded"), ("b", "pending")]
    assert pairs(telemetry.latest_status(events), "run_id", "status") == [("a", "failed"), ("b", "pending")]


# -------------------------------------------------------------------- ordering


def test_row_index_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("seq")).repartition(7)
    rows = ordering.with_row_index(df, ["seq"]).collect()
    assert all(r["seq"] == r["row_index"] for r in rows) and len(rows) == 1000


def test_hot_key_is_limited_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("seq"))
    plan = ordering.first_wins(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


# ------------------------------------------------------------------ whole jobs


def test_malformed_output_yields_no_graph(spark):
    good = "### 节点\n- a: x\n- b: y\n### 关系\n- a -> b: t\n"
    bad = "### 节点\n- a: x\n### 关系\n- a: b -> c\n"
    outputs = spark.createDataFrame(
        [(1, "T", "C", "S1", "en", good), (2, "T", "C", "S2", "en", bad), (3, "T", "C", "S3", "en", "")],
        "seq long, topic string, chapter string, subchapter string, language string, raw string",
    )
    graphs = build_section_graphs(outputs, now())
    assert pairs(graphs.rejects, "seq", "reason") == [(2, "bad_relation_line"), (3, "empty_output")]
    assert graphs.nodes.count() == 2 and pairs(graphs.edges, "source_id", "target_id") == [
        ("a_concept_book_t_e", "b_concept_book_t_e")
    ]


def test_outputs_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return x

    raw = "### 节点\n- a: x\n- b: y\n### 关系\n- a -> b: t\n"
    rows = [(i, "T", "C", f"S{i}", "en", raw if i % 3 else "") for i in range(9)]
    outputs = spark.createDataFrame(rows, "seq long, topic string, chapter string, subchapter string, language string, raw string")
    outputs = outputs.withColumn("raw", F.udf(look, "string").asNondeterministic()("raw"))
    words = outputs.select(ids.section_id("topic", "chapter", "subchapter").alias("section_id"), F.lit("x").alias("keyword"))
    measured = section_insights(build_section_graphs(outputs, now()), words).collect()
    assert sorted(r["total_edges"] for r in measured) == [0] * 3 + [1] * 6
    assert seen.value == len(rows)


def test_sections_are_not_joined_by_the_size_of_their_files(spark, tmp_path):
    raw = "### 节点\n- a: x\n- b: y\n### 关系\n- a -> b: t\n"
    columns = {"topic": "T", "chapter": "C", "subchapter": "S", "language": "en", "raw": raw}
    same = spark.range(20).select(F.col("id").alias("seq"), *[F.lit(v).alias(c) for c, v in columns.items()])
    same.coalesce(1).write.parquet(f"{tmp_path}/outputs")
    outputs = spark.read.parquet(f"{tmp_path}/outputs")
    graphs = build_section_graphs(outputs, now())
    words = outputs.select(ids.section_id("topic", "chapter", "subchapter").alias("section_id"), F.lit("x").alias("keyword"))
    measured = section_insights(graphs, words)
    limit = int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b"))
    small = [df for df in (graphs.nodes, graphs.edges, graphs.sections) if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= limit]
    assert not small and "BroadcastHashJoin" not in measured._jdf.queryExecution().sparkPlan().toString()
    assert [(r["total_nodes"], r["total_edges"]) for r in measured.collect()] == [(40, 20)]


def test_unsized_rows_stay_the_same(spark):
    rows = spark.createDataFrame([(1, None, ["a", None]), (1, None, ["a", None]), (None, "x", [])], "k INT, t STRING, a ARRAY<STRING>")
    kept = cut_unsized(rows)
    assert kept.schema == rows.schema and sorted(map(str, kept.collect())) == sorted(map(str, rows.collect()))


def test_request_rules(spark):
    requests = spark.createDataFrame(
        [("t", None, 3, None), (None, "en", 21, "w")], "topic string, language string, chapter_count int, workflow_id string"
    )
    assert [r["errors"] for r in clean.validate_run_requests(requests).collect()] == [[], ["topic", "chapter_count"]]


def test_display_text_of_edges(spark):
    edges = spark.createDataFrame([(0.6, "a;b"), (0.6, "a"), (0.59, "a;b"), (None, "a;b")], "confidence double, evidence string")
    assert clean.filter_display(edges).count() == 1 and clean.filter_storage(edges).count() == 3


def test_ids_are_stable(spark):
    row = spark.range(1).select(ids.concept_id(F.lit("A b"), F.lit("t"), F.lit("c"), F.lit(None).cast("string"))).first()
    assert row[0].startswith("concept:a_b:") and len(row[0]) == len("concept:a_b:") + 6
