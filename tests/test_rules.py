"""Retrieval operators and content rules at their edges: nulls, empty inputs, ties, repeated rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.operators import policies, retrieval


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_chunks_cover_every_text(spark):
    texts = {1: "", 2: "x", 3: "ab" * 400, 4: "ab" * 401, 5: "".join(chr(97 + i % 26) for i in range(3001)), 6: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    chunks: dict = {}
    for r in retrieval.chunk_documents(docs).orderBy("doc_id", "chunk_no").collect():
        chunks.setdefault(r["doc_id"], []).append(r["text"])
    assert 6 not in chunks and {k: len(v) for k, v in chunks.items()} == {1: 1, 2: 1, 3: 1, 4: 2, 5: 5}
    for doc_id, parts in chunks.items():
        assert parts[0] + "".join(p[120:] for p in parts[1:]) == texts[doc_id]


def test_shortest_then_surest_path(spark):
    links = [("a", "b", 0.1), ("a", "c", 0.9), ("c", "b", 0.9), ("c", "d", 0.5), ("b", "d", 0.9), ("b", "d", None), ("a", "a", 1.0)]
    edges = spark.createDataFrame(links, "source_id string, target_id string, confidence double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "d"), ("a", "d"), ("a", "a"), ("d", "a"), (None, "a")], "a string, b string")
    assert rows(retrieval.explain_paths(edges, pairs), "a", "b", "length", "via", "confidence") == [
        ("a", "b", 1, None, 0.1),
        ("a", "d", 2, "c", 0.7),
    ]


def test_fused_channels(spark):
    schema = "query_id int, item_id int, score double"
    vector = spark.createDataFrame([(1, 1, 5.0), (1, 2, 3.0), (2, 9, 4.0)], schema)
    graph = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0)], schema)
    assert rows(retrieval.fuse(vector, graph, k=2), "query_id", "item_id", "score", "rank") == [(1, 1, 0.7, 1), (1, 2, 0.3, 2), (2, 9, 0.0, 1)]
    empty = spark.createDataFrame([], schema)
    assert retrieval.fuse(empty, empty).count() == 0


def test_unknown_payloads_do_not_match(spark):
    chunks = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, tenant string")
    tenant = F.col("tenant")
    assert rows(retrieval.payload_filter(chunks, must=[tenant == "a"]), "id") == [(1,)]
    assert rows(retrieval.payload_filter(chunks, must_not=[tenant == "a"]), "id") == [(2,), (3,)]
    assert rows(retrieval.payload_filter(chunks, should=[tenant == "a", tenant == "b"]), "id") == [(1,), (2,)]


def test_index_plan_with_null_hashes(spark):
    schema = "doc_id int, content_hash string"
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, None)], schema)
    index = spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (5, None)], schema)
    assert rows(retrieval.reindex_plan(docs, index), "doc_id", "action") == [(2, "changed"), (4, "new"), (5, "deleted")]


def test_measures_without_results(spark):
    gold = spark.createDataFrame([(1, 1), (1, 1), (2, 5)], "query_id int, item_id int")
    results = spark.createDataFrame([(1, 1, 7), (1, 2, 1)], "query_id int, rank int, item_id int")
    assert rows(retrieval.retrieval_metrics(results, gold), "queries", "hit_at_1", "hit_rate", "mean_evidence") == [(2, 0.0, 0.5, 0.5)]


def test_volumes_of_a_book(spark):
    sections = [("b", c, s, 20, None) for c in range(3) for s in range(2)] + [("b", 3, 0, None, 9)]
    table = spark.createDataFrame(sections, "book_id string, chapter_pos int, subchapter_pos int, tokens int, qa_count int")
    checked = policies.budget_check(table, section_tokens=15, book_tokens=50)
    assert rows(checked, "chapter_pos", "subchapter_pos", "volume", "section_over", "qa_over") == [
        (0, 0, 1, 5, 0), (0, 1, 1, 5, 0), (1, 0, 1, 5, 0), (1, 1, 2, 5, 0), (2, 0, 2, 5, 0), (2, 1, 3, 5, 0), (3, 0, 3, 0, 1),
    ]


def test_conflicts_by_rule(spark):
    made = [
        (1, "a", "b", "T", "section:1", 0.9, 10), (2, "a", "b", "T", "section:1", 0.1, 20),
        (3, "c", "d", "T", "section:1", 0.5, 10), (4, "c", "d", "T", "book:1", 0.5, 10), (5, "c", "d", "T", "book:2", 0.5, 10),
        (6, "e", "f", None, None, None, None),
    ]
    edges = spark.createDataFrame(made, "seq int, source_id string, target_id string, type string, scope string, confidence double, created_at int")
    assert rows(policies.resolve_conflicts(edges), "seq") == [(2,), (4,), (6,)]


def test_pages_join_to_the_table(spark):
    table = spark.range(25).withColumn("k", F.col("id") % 3)
    seen, after = [], None
    while page := policies.paginate(table, ["k", "id"], 10, after).collect():
        seen += [(r["k"], r["id"]) for r in page]
        after = seen[-1]
    assert seen == sorted((i % 3, i) for i in range(25))


def test_topic_codes_and_keys(spark):
    asked = [("x", None, 0), ("好 topic", "Latin", 20), (None, "English", None), ("a!b", "中文", 5)]
    requests = spark.createDataFrame(asked, "topic string, language string, chapter_count int")
    got = rows(policies.validate_topics(requests), "topic", "error_codes", "topic_allowed")
    assert got == sorted([("x", [4001, 4004], True), ("好 topic", [4003], True), (None, [4001, 4004], False), ("a!b", [], False)], key=repr)
    keys = requests.select("topic", policies.concept_key("topic").alias("key")).collect()
    import hashlib

    assert {r["topic"]: r["key"] for r in keys}["a!b"] == hashlib.md5(b"ab").hexdigest()[:8]
