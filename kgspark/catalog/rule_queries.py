"""Retrieval and content rules over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import policies, retrieval
from .registry import Data, query, rounded

# ------------------------------------------------------------------- retrieval

@query(
    """SELECT doc_id, chunk_no, doc_id || '#' || chunk_no AS chunk_id, substr(text, chunk_no * 680 + 1, 800) AS text FROM (
         SELECT doc_id, text, unnest(range(CAST(floor((greatest(length(text) - 120, 1) - 1) / 680) AS INT) + 1))::INT AS chunk_no
         FROM documents WHERE text IS NOT NULL) x"""
)
def chunk_documents(d: Data) -> DataFrame:
    """P1"""
    return retrieval.chunk_documents(d.table("documents"))

@query(
    """WITH links AS (SELECT source_id, target_id, max(confidence) AS confidence FROM raw_edges GROUP BY 1, 2),
        asked AS (SELECT DISTINCT source_id AS a, 'p7' AS b FROM raw_edges WHERE source_id <> 'p7'),
        paths AS (SELECT a, b, 1 AS length, NULL AS via, confidence FROM asked JOIN links ON source_id = a AND target_id = b
                  UNION ALL
                  SELECT a, b, 2, x.target_id, (x.confidence + y.confidence) / 2 FROM asked JOIN links x ON x.source_id = a
                  JOIN links y ON y.source_id = x.target_id AND y.target_id = b WHERE x.target_id NOT IN (a, b))
        SELECT a, b, length, via, round(confidence, 6) AS confidence,
               round(0.6 / length + 0.3 * confidence + 0.1 * ln(1 + length), 6) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY length, confidence DESC, via) AS r FROM paths) p WHERE r = 1""",
    "raw_edges",
)
def explain_paths(d: Data) -> DataFrame:
    """From every node to one node, scored with the path's length as its support"""
    edges = d.view("raw_edges")
    pairs = edges.select(F.col("source_id").alias("a"), F.lit("p7").alias("b"))
    paths = retrieval.explain_paths(edges, pairs)
    score = retrieval.path_score(F.col("length"), F.col("confidence"), F.col("length"))
    return paths.select("a", "b", "length", "via", rounded("confidence"), rounded(score, "score"))

CHANNELS = """vec AS (SELECT l_orderkey AS query_id, l_partkey AS item_id, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2),
    kg AS (SELECT l_orderkey AS query_id, l_suppkey AS item_id, max(l_quantity) / 50 AS score FROM lineitem GROUP BY 1, 2),
    bounds AS (SELECT query_id, min(score) AS lo, max(score) AS hi FROM vec GROUP BY 1),
    scaled AS (SELECT query_id, item_id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.0 END AS score FROM vec JOIN bounds USING (query_id))"""

def _channel(d: Data, item: str, score: str) -> DataFrame:
    lines = d.table("lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col(item).alias("item_id"))
    return lines.agg(F.max(score).alias("score"))

@query(f"WITH {CHANNELS} SELECT query_id, item_id, round(score, 6) AS score FROM scaled")
def minmax(d: Data) -> DataFrame:
    """P5"""
    scaled = retrieval.minmax(_channel(d, "l_partkey", "l_extendedprice"))
    return scaled.select("query_id", "item_id", rounded("score"))

@query(
    f"""WITH {CHANNELS}, fused AS (SELECT query_id, item_id, 0.7 * coalesce(v.score, 0) + 0.3 * coalesce(k.score, 0) AS score
            FROM scaled v FULL JOIN kg k USING (query_id, item_id))
        SELECT query_id, item_id, round(score, 6) AS score FROM fused"""
)
def fuse_all(d: Data) -> DataFrame:
    """P6 without a limit"""
    graph = _channel(d, "l_suppkey", "l_quantity").withColumn("score", F.col("score") / 50)
    fused = retrieval.fuse(_channel(d, "l_partkey", "l_extendedprice"), graph, k=None)
    return fused.select("query_id", "item_id", rounded("score"))

@query(
    f"""WITH {CHANNELS}, fused AS (SELECT query_id, 0.7 * coalesce(v.score, 0) + 0.3 * coalesce(k.score, 0) AS score
            FROM scaled v FULL JOIN kg k USING (query_id, item_id))
        SELECT query_id, r::INT AS rank, round(score, 6) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS r FROM fused) x WHERE r <= 4"""
)
def fuse(d: Data) -> DataFrame:
    """P6"""
    graph = _channel(d, "l_suppkey", "l_quantity").withColumn("score", F.col("score") / 50)
    fused = retrieval.fuse(_channel(d, "l_partkey", "l_extendedprice"), graph)
    return fused.select("query_id", "rank", rounded("score"))

@query(
    """SELECT doc_id FROM documents WHERE coalesce(length(text) > 100, false) AND NOT coalesce(lang = 'es', false)
       AND (coalesce(lang = 'en', false) OR coalesce(n_chars > 500, false))"""
)
def payload_filter(d: Data) -> DataFrame:
    """P7"""
    lang = F.col("lang")
    kept = retrieval.payload_filter(
        d.table("documents"), [F.length("text") > 100], [lang == "en", F.col("n_chars") > 500], [lang == "es"]
    )
    return kept.select("doc_id")

@query(
    """WITH gold AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS i FROM lineitem WHERE l_quantity > 25),
        found AS (SELECT q, min(l_linenumber) AS first, count(DISTINCT i) AS n FROM gold JOIN lineitem ON l_orderkey = q AND l_partkey = i GROUP BY 1)
        SELECT count(*) AS queries, round(count(*) FILTER (first = 1) / count(*), 6) AS hit_at_1, round(count(first) / count(*), 6) AS hit_rate,
               round(avg(coalesce(n, 0)), 6) AS mean_evidence FROM (SELECT DISTINCT q FROM gold) g LEFT JOIN found USING (q)"""
)
def retrieval_metrics(d: Data) -> DataFrame:
    """P8"""
    lines = d.table("lineitem").select(
        F.col("l_orderkey").alias("query_id"),
        F.col("l_linenumber").alias("rank"),
        F.col("l_partkey").alias("item_id"),
        "l_quantity",
    )
    measured = retrieval.retrieval_metrics(lines, lines.where("l_quantity > 25"))
    return measured.select("queries", rounded("hit_at_1"), rounded("hit_rate"), rounded("mean_evidence"))

@query(
    """WITH idx AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'old' ELSE md5(text) END AS h FROM labels JOIN documents USING (doc_id)
                    UNION ALL SELECT -doc_id - 1, 'gone' FROM labels WHERE quality = 0)
       SELECT * FROM (SELECT coalesce(d.doc_id, idx.doc_id) AS doc_id, CASE WHEN idx.doc_id IS NULL THEN 'new'
                             WHEN d.doc_id IS NULL THEN 'deleted' WHEN md5(text) IS DISTINCT FROM h THEN 'changed' END AS action
                      FROM documents d FULL JOIN idx ON idx.doc_id = d.doc_id) x WHERE action IS NOT NULL"""
)
def reindex_plan(d: Data) -> DataFrame:
    """P9"""
    docs = d.table("documents").select("doc_id", F.md5("text").alias("content_hash"))
    labels = d.table("labels")
    stored = labels.join(docs, "doc_id").select(
        "doc_id", F.when(F.col("toxic") == 1, "old").otherwise(F.col("content_hash")).alias("content_hash")
    )
    gone = labels.where("quality = 0").select((-F.col("doc_id") - 1).alias("doc_id"), F.lit("gone").alias("content_hash"))
    return retrieval.reindex_plan(docs, stored.unionByName(gone))

@query(
    """SELECT o_orderkey AS claim_id, count(DISTINCT l_suppkey) AS hits, count(DISTINCT l_suppkey) >= 3 AS sufficient
       FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"""
)
def evidence_sufficiency(d: Data) -> DataFrame:
    """P10"""
    claims = d.table("orders").select(F.col("o_orderkey").alias("claim_id"))
    hits = d.table("lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_suppkey").alias("hit_id"))
    return retrieval.evidence_sufficiency(claims, hits, 3)

# ------------------------------------------------------------------------ rules

@query(
    """WITH n AS (SELECT * FROM raw_nodes WHERE type IN ('PROMO', 'LARGE'))
       SELECT 'node' AS kind, scope, seq FROM n UNION ALL
       SELECT 'edge', scope, seq FROM raw_edges e WHERE type IN ('REQUIRES', 'PART_OF') AND weight >= 0.3
              AND EXISTS (FROM n WHERE n.scope = e.scope AND n.id = source_id) AND EXISTS (FROM n WHERE n.scope = e.scope AND n.id = target_id)""",
    "raw_nodes raw_edges",
)
def filter_graph(d: Data) -> DataFrame:
    """F11"""
    nodes, edges = policies.filter_graph(
        d.view("raw_nodes"), d.view("raw_edges"), ["PROMO", "LARGE"], ["REQUIRES", "PART_OF"], 0.3
    )
    return nodes.select(F.lit("node").alias("kind"), "scope", "seq").unionByName(
        edges.select(F.lit("edge").alias("kind"), "scope", "seq")
    )

@query(
    """SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey, o_orderkey) > (20, 100) ORDER BY o_custkey, o_orderkey LIMIT 100"""
)
def paginate(d: Data) -> DataFrame:
    """M4: the page behind one key"""
    orders = d.table("orders").select("o_orderkey", "o_custkey")
    return policies.paginate(orders, ["o_custkey", "o_orderkey"], 100, [20, 100])

CORE = """ends AS (SELECT scope, source_id AS id FROM raw_edges WHERE weight >= 0.7 UNION ALL
                    SELECT scope, target_id FROM raw_edges WHERE weight >= 0.7),
    degrees AS (SELECT scope, id, count(*) AS relations FROM ends SEMI JOIN raw_nodes USING (scope, id) GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY relations DESC, id)::INT AS rank FROM degrees)"""

@query(f"WITH {CORE} SELECT scope, id, relations, rank FROM ranked WHERE rank <= 20", "raw_nodes raw_edges")
def core_nodes(d: Data) -> DataFrame:
    """M5"""
    return policies.core_nodes(d.view("raw_nodes"), d.view("raw_edges"))

@query(f"WITH {CORE} SELECT scope, id, relations, rank FROM ranked", "raw_nodes raw_edges")
def core_nodes_all(d: Data) -> DataFrame:
    """M5 without a limit"""
    return policies.core_nodes(d.view("raw_nodes"), d.view("raw_edges"), None)

@query(
    """SELECT source_id, target_id, type, seq FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, type
              ORDER BY created_at DESC, confidence DESC, seq) AS r FROM raw_edges) x WHERE r = 1""",
    "raw_edges",
)
def resolve_conflicts(d: Data) -> DataFrame:
    """L6"""
    return policies.resolve_conflicts(d.view("raw_edges")).select("source_id", "target_id", "type", "seq")

@query(
    """SELECT section_id, (floor(coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY chapter_pos, subchapter_pos ROWS BETWEEN UNBOUNDED
              PRECEDING AND 1 PRECEDING), 0) / 50000) + 1)::BIGINT AS volume, greatest(n - 2000, 0)::BIGINT AS section_over, greatest(n % 13 - 8, 0)::BIGINT AS qa_over
       FROM (SELECT *, coalesce(length(content), 0) AS n FROM sections) s""",
    "sections",
)
def budget_check(d: Data) -> DataFrame:
    """O5, a character counted as a token"""
    size = F.coalesce(F.length("content"), F.lit(0))
    sections = d.view("sections").withColumn("book_id", F.col("doc_id"))
    checked = policies.budget_check(sections.withColumns({"tokens": size, "qa_count": size % 13}))
    return checked.select("section_id", "volume", F.col("section_over").cast("long").alias("section_over"), "qa_over")

@query(
    r"""SELECT p_partkey, concat_ws(',', CASE WHEN length(topic) < 2 THEN 4001 END, CASE WHEN length(topic) > 200 THEN 4002 END,
               CASE WHEN lang NOT IN ('中文', 'English') THEN 4003 END, CASE WHEN p_size % 25 NOT BETWEEN 1 AND 20 THEN 4004 END,
               CASE WHEN p_retailprice > 1500 THEN 4005 END) AS codes, regexp_matches(topic, '^[\x{4e00}-\x{9fa5}a-zA-Z0-9\s\-_]+$') AS topic_allowed
        FROM (SELECT *, CASE p_size % 4 WHEN 0 THEN 'x' WHEN 1 THEN repeat(p_name, 40) WHEN 2 THEN p_brand ELSE p_name END AS topic,
                     CASE p_size % 3 WHEN 0 THEN 'English' WHEN 1 THEN 'Latin' ELSE '中文' END AS lang FROM part) x"""
)
def validate_topics(d: Data) -> DataFrame:
    """F12"""
    size = F.col("p_size")
    topic = (
        F.when(size % 4 == 0, "x").when(size % 4 == 1, F.repeat("p_name", 40)).when(size % 4 == 2, F.col("p_brand"))
    ).otherwise(F.col("p_name"))
    language = F.when(size % 3 == 0, "English").when(size % 3 == 1, "Latin")
    requests = d.table("part").withColumns(
        {"topic": topic, "language": language, "chapter_count": size % 25, "content_length": F.col("p_retailprice")}
    )
    checked = policies.validate_topics(requests, 1500)
    codes = F.array_join(F.col("error_codes").cast("array<string>"), ",").alias("codes")
    return checked.select("p_partkey", codes, "topic_allowed")

@query(
    """WITH s AS (SELECT doc_id, length(text) % 11 AS a, doc_id % 11 AS b, n_chars % 11 AS c, (doc_id + n_chars) % 11 AS d FROM documents),
        t AS (SELECT *, round(0.3 * coalesce(a, 0) + 0.4 * b + 0.2 * coalesce(c, 0) + 0.1 * coalesce(d, 0), 6)::DOUBLE AS rubric_score FROM s)
        SELECT doc_id, rubric_score, coalesce(a, 0) >= 7 AND b >= 8 AND coalesce(c, 0) >= 6 AND coalesce(d, 0) >= 6 AS rubric_passed,
               CASE WHEN rubric_score < 5 THEN '强制重写' WHEN rubric_score < 7 THEN '针对性修订' END AS revision FROM t"""
)
def rubric_score(d: Data) -> DataFrame:
    """H28"""
    scores = d.table("documents").select(
        "doc_id",
        (F.length("text") % 11).cast("double").alias("content_completeness"),
        (F.col("doc_id") % 11).cast("double").alias("technical_accuracy"),
        (F.col("n_chars") % 11).cast("double").alias("logical_coherence"),
        ((F.col("doc_id") + F.col("n_chars")) % 11).cast("double").alias("language_expression"),
    )
    return policies.rubric_score(scores).select("doc_id", "rubric_score", "rubric_passed", "revision")

@query(
    rf"""SELECT p_partkey, substr(md5(CASE k WHEN '机器学习' THEN 'ml' ELSE k END), 1, 8) AS key FROM (
           SELECT p_partkey, regexp_replace(lower(CASE p_size % 3 WHEN 0 THEN '机器 学习!' ELSE p_name END), '[^\p{{L}}\p{{N}}_]', '', 'g') AS k
           FROM part) x"""
)
def concept_keys(d: Data) -> DataFrame:
    """C24"""
    name = F.when(F.col("p_size") % 3 == 0, "机器 学习!").otherwise(F.col("p_name"))
    return d.table("part").select("p_partkey", policies.concept_key(name).alias("key"))
