"""Column functions and extraction over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, status
from ..functions import text as t
from ..operators import extract
from .registry import Data, d_collapse, d_concept_id, d_node_id, d_rid, d_slug, d_strip, d_url_slug, joined, query

def now() -> Column:
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


@query(
    f"""SELECT seq, section_id, substr(md5(regexp_replace({d_strip("content")}, '{t.WS}+', ' ', 'g')), 1, 12) AS content_hash,
               CASE WHEN content = '' THEN '' ELSE md5(content) END AS content_hash_full
        FROM sections""",
    "sections",
)
def section_hashes(d: Data) -> DataFrame:
    """C1, C2, C3"""
    s = d.view("sections").drop("section_id")
    return s.select(
        "seq",
        ids.section_id("topic", "chapter", "subchapter").alias("section_id"),
        ids.content_hash("content").alias("content_hash"),
        ids.content_hash_full("content").alias("content_hash_full"),
    )


@query(f"SELECT conv_id, turn, {d_slug('text')} AS slug, {d_url_slug('text')} AS url_slug FROM conversations")
def slugs(d: Data) -> DataFrame:
    """C4, C5"""
    return d.table("conversations").select(
        "conv_id", "turn", t.slug("text").alias("slug"), t.url_slug("text").alias("url_slug")
    )


@query(
    f"""SELECT doc_id, {d_concept_id("name")} AS concept_id,
               'chapter:' || {d_slug("chapter")} || ':' || substr(md5(topic || '|' || chapter), 1, 6) AS chapter_id,
               'subchapter:' || {d_slug("subchapter")} || ':' ||
                   substr(md5(topic || '|' || chapter || '|' || subchapter), 1, 6) AS subchapter_id,
               'book:' || {d_slug("topic")} || CASE WHEN run = '' THEN '' ELSE ':' || substr(run, 1, 8) END AS book_id,
               'book_' || {d_url_slug("topic")} || CASE WHEN chapter = 'zh' THEN '' ELSE '_' || chapter END AS book_scope
        FROM (SELECT doc_id, text AS name, source AS topic, lang AS chapter, 'doc ' || doc_id AS subchapter,
                     CASE WHEN doc_id % 2 = 0 THEN '' ELSE md5(text) END AS run FROM documents) x"""
)
def structure_ids(d: Data) -> DataFrame:
    """C6, C7, C8, C9"""
    docs = d.table("documents").select(
        "doc_id",
        F.col("text").alias("name"),
        F.col("source").alias("topic"),
        F.col("lang").alias("chapter"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("subchapter"),
        F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.md5("text")).alias("run"),
    )
    return docs.select(
        "doc_id",
        ids.concept_id("name", "topic", "chapter", "subchapter").alias("concept_id"),
        ids.chapter_id("chapter", "topic").alias("chapter_id"),
        ids.subchapter_id("subchapter", "topic", "chapter").alias("subchapter_id"),
        ids.book_id("topic", "run").alias("book_id"),
        ids.book_scope("topic", "chapter").alias("book_scope"),
    )


@query(
    f"""SELECT seq, {d_rid("type", "source_id", "target_id", "scope")} AS rid,
               substr(sha256(source_id || '|' || target_id || '|' || type || '|' || scope ||
                      CASE WHEN type = 'REQUIRES' THEN '' ELSE '|' || evidence END), 1, 16) AS rid_sha,
               type || ':' || source_id || '->' || target_id AS legacy_id
        FROM raw_edges""",
    "raw_edges",
)
def relation_ids(d: Data) -> DataFrame:
    """C10, C11, C13"""
    description = F.when(F.col("type") == "REQUIRES", "").otherwise(F.col("evidence"))
    return d.view("raw_edges").select(
        "seq",
        ids.relation_rid("type", "source_id", "target_id", "scope").alias("rid"),
        ids.relation_rid_sha("source_id", "target_id", "type", "scope", description).alias("rid_sha"),
        ids.legacy_edge_id("type", "source_id", "target_id").alias("legacy_id"),
    )


@query(
    f"""SELECT 'part' AS kind, seq AS row_id, {d_node_id("name", "type", "scope")} AS node_id FROM raw_nodes
        UNION ALL
        SELECT 'turn', conv_id * 1000 + turn, {d_node_id("text", "'Concept'", "''")} FROM conversations""",
    "raw_nodes",
)
def node_ids(d: Data) -> DataFrame:
    """C12; the turns give names beyond the length limit"""
    parts = d.view("raw_nodes").select(
        F.lit("part").alias("kind"), F.col("seq").alias("row_id"), ids.node_id("name", "type", "scope").alias("node_id")
    )
    turns = d.table("conversations").select(
        F.lit("turn").alias("kind"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"),
        ids.node_id("text", F.lit("Concept"), F.lit("")).alias("node_id"),
    )
    return parts.unionByName(turns)


@query(f"SELECT doc_id, {d_collapse('text')} AS name, {d_collapse('text')} AS description FROM documents")
def normalized_text(d: Data) -> DataFrame:
    """C14"""
    return d.table("documents").select(
        "doc_id",
        t.normalize_name("text").alias("name"),
        t.normalize_description("text").alias("description"),
    )


@query(
    f"""WITH items AS (SELECT p_partkey, p_name, unnest([p_brand || '  ' || p_type, ' ' || p_name || ' ', p_brand, '  ',
                              p_brand || chr(9) || p_type, p_brand || ' ']) AS a FROM part),
        n AS (SELECT p_partkey, {d_collapse("a")} AS v FROM items WHERE {d_strip("a")} NOT IN ('', p_name)),
        s AS (SELECT p_partkey, {d_strip("a")} AS v FROM items WHERE {d_strip("a")} NOT IN ('', p_name))
        SELECT x.p_partkey, x.normalized, y.deduped
        FROM (SELECT p_partkey, string_agg(DISTINCT v, '~' ORDER BY v) AS normalized FROM n GROUP BY 1) x
        JOIN (SELECT p_partkey, string_agg(DISTINCT v, '~' ORDER BY v) AS deduped FROM s GROUP BY 1) y USING (p_partkey)"""
)
def alias_lists(d: Data) -> DataFrame:
    """C15, C16"""
    part = d.table("part")
    raw = F.array(
        F.concat("p_brand", F.lit("  "), "p_type"),
        F.concat(F.lit(" "), "p_name", F.lit(" ")),
        F.col("p_brand"),
        F.lit("  "),
        F.concat("p_brand", F.lit("\t"), "p_type"),
        F.concat("p_brand", F.lit(" ")),
    )
    listed = part.select(
        "p_partkey",
        t.normalize_aliases(raw, "p_name").alias("normalized"),
        t.dedupe_aliases(raw, "p_name").alias("deduped"),
    )
    return listed.select("p_partkey", joined("normalized"), joined("deduped"))


@query(
    rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower({d_strip("text")}), '[\-_/]+', ' ', 'g'),
               '[^0-9a-z\x{{4E00}}-\x{{9FA5}}]+', ' ', 'g'), ' +', ' ', 'g')) AS keyword
        FROM documents"""
)
def canonical_keywords(d: Data) -> DataFrame:
    """C17"""
    return d.table("documents").select("doc_id", t.canonical_keyword("text").alias("keyword"))


@query(
    r"""WITH r AS (SELECT conv_id, turn, text, upper(replace(text, 'ß', 'ss')) AS u FROM conversations),
        n AS (SELECT *, trim(regexp_replace(regexp_replace(u, '[^A-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '_') AS name FROM r)
        SELECT conv_id, turn, CASE WHEN name = '' THEN 'RELATED' WHEN regexp_matches(name, '^[0-9]') THEN 'REL_' || name
                                   ELSE name END AS rel_type,
               CASE WHEN text = '' THEN 1 ELSE len(string_split(text, ';')) END::INT AS evidence_count,
               substr(text, 1, 500) AS excerpt
        FROM n"""
)
def relation_text(d: Data) -> DataFrame:
    """C18, C19, C20"""
    return d.table("conversations").select(
        "conv_id",
        "turn",
        t.sanitize_rel_type("text").alias("rel_type"),
        t.evidence_count("text").alias("evidence_count"),
        t.truncate_text("text", 500).alias("excerpt"),
    )


@query(
    """SELECT event_id, CASE WHEN event_type IN ('signup', 'view') THEN 'info' WHEN event_type = 'error' THEN 'error'
                             ELSE 'debug' END AS level,
              CASE event_id % 6 WHEN 0 THEN 'rate_limit' WHEN 1 THEN 'invalid_request' WHEN 2 THEN 'server' WHEN 3 THEN 'http'
                   WHEN 4 THEN 'network' ELSE 'server' END AS error_class,
              event_id % 6 IN (0, 2, 4, 5) AS retryable,
              CASE WHEN event_id % 2 = 0 THEN 'p' || user_id ELSE 'dp' END AS provider,
              CASE WHEN event_id % 2 = 0 THEN 'm:' || event_type ELSE 'dm' END AS model,
              CASE WHEN length(event_type || user_id) <= 8 THEN '****' ELSE substr(event_type || user_id, 1, 4) || '...' ||
                   right(event_type || user_id, 4) END AS masked
       FROM events"""
)
def event_labels(d: Data) -> DataFrame:
    """C21, C22, C23, C25"""
    e = d.table("events")
    tag = F.when(F.col("event_type").isin("signup", "view"), "[info]").when(F.col("event_type") == "error", "[error]")
    sixth = F.col("event_id") % 6
    code = (
        F.when(sixth == 0, 429).when(sixth == 1, 404).when(sixth == 2, 503).when(sixth == 3, 302).when(sixth == 5, 500)
    )
    ref = F.when(
        F.col("event_id") % 2 == 0, F.concat(F.lit("p"), F.col("user_id").cast("string"), F.lit(":m:"), "event_type")
    ).otherwise(F.col("event_type"))
    return e.select(
        "event_id",
        status.log_level(F.concat(F.coalesce(tag, F.lit("[x]")), F.lit(" m"))).alias("level"),
        status.http_error_class(code).alias("error_class"),
        status.retryable(code).alias("retryable"),
        status.split_model_ref(ref, "dp", "dm")["provider"].alias("provider"),
        status.split_model_ref(ref, "dp", "dm")["model"].alias("model"),
        status.mask_key(F.concat("event_type", F.col("user_id").cast("string"))).alias("masked"),
    )


# ---------------------------------------------------------------- extraction


@query(
    f"""SELECT seq, name, description, {d_concept_id("name")} AS id, 'concept' AS type, pos
        FROM (SELECT p_partkey AS seq, p_type AS topic, p_brand AS chapter, 'S' || p_partkey % 20 AS subchapter,
                     p_name AS name, p_type || ': big' AS description, 1 AS pos FROM part
              UNION ALL
              SELECT p_partkey, p_type, p_brand, 'S' || p_partkey % 20, p_brand, 'brand', 3 FROM part) x"""
)
def extract_nodes(d: Data) -> DataFrame:
    """E1"""
    found = extract.extract_nodes(d.view("outputs"))
    return found.select("seq", "name", "description", "id", "type", "pos")


@query(
    f"""SELECT seq, source_name, target_name, {d_concept_id("source_name")} AS source_id,
               {d_concept_id("target_name")} AS target_id, type, '从文本中抽取的关系: ' || source_name || ' -> ' || target_name
               AS description, 0.8::DOUBLE AS confidence, 1.0::DOUBLE AS weight
        FROM (SELECT p_partkey AS seq, p_type AS topic, p_brand AS chapter, 'S' || p_partkey % 20 AS subchapter,
                     p_name AS source_name, p_brand AS target_name, 'PART_OF' AS type FROM part
              UNION ALL
              SELECT p_partkey, p_type, p_brand, 'S' || p_partkey % 20, p_brand, 'nobody', 'KNOWS' FROM part) x"""
)
def extract_edges(d: Data) -> DataFrame:
    """E2"""
    found = extract.extract_edges(d.view("outputs"))
    return found.select(
        "seq", "source_name", "target_name", "source_id", "target_id", "type", "description", "confidence", "weight"
    )


@query("SELECT p_partkey AS seq, '- ' || p_brand || chr(10) || '  - ' || p_name AS hierarchy FROM part")
def extract_hierarchy(d: Data) -> DataFrame:
    """E3"""
    return extract.extract_hierarchy(d.view("outputs")).select("seq", "hierarchy")


@query(
    """SELECT p_partkey AS seq, 'bad_relation_line' AS reason FROM part WHERE p_partkey % 50 = 0"""
)
def malformed_outputs(d: Data) -> DataFrame:
    """Outputs that yield no graph"""
    return extract.malformed_outputs(d.view("outputs")).select("seq", "reason")


@query(
    """SELECT 'node' AS kind, p_partkey AS seq, 'p' || p_partkey AS id, coalesce(CASE WHEN p_size > 3 THEN p_type END, 'Concept')
              AS type, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS scope, NULL::DOUBLE AS confidence,
              epoch_us(CASE p_partkey % 3 WHEN 0 THEN TIMESTAMP '2023-05-06 07:08:09' WHEN 1 THEN TIMESTAMP '2024-01-01' END)
              AS created_us FROM part
       UNION ALL
       SELECT 'edge', p_partkey, 'p' || p_partkey || '>', coalesce(CASE WHEN p_size > 3 THEN p_type END, 'RELATED_TO'),
              CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END, CASE WHEN p_size > 9 THEN p_size / 50 ELSE 0.8 END,
              epoch_us(CASE p_partkey % 3 WHEN 0 THEN TIMESTAMP '2023-05-06 07:08:09' WHEN 1 THEN TIMESTAMP '2024-01-01' END)
       FROM part"""
)
def standardize_graph(d: Data) -> DataFrame:
    """E4"""
    part = d.table("part")
    third = F.col("p_partkey") % 3
    raw = part.select(
        F.col("p_partkey").alias("seq"),
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_size") > 3, F.col("p_type")).alias("type"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("array<string>").alias("aliases"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("").alias("scope"),
        F.col("p_type").alias("topic"),
        F.when(third == 0, "2023-05-06T07:08:09Z").when(third == 1, "soon").alias("created_at"),
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("source_id"),
        F.lit(None).cast("string").alias("target_id"),
        F.when(F.col("p_size") > 9, F.col("p_size") / 50).alias("confidence"),
        F.lit(None).cast("double").alias("weight"),
        F.lit(None).cast("string").alias("src_section"),
    )
    nodes = extract.standardize_nodes(raw, now()).select(
        F.lit("node").alias("kind"),
        "seq",
        "id",
        "type",
        "scope",
        F.lit(None).cast("double").alias("confidence"),
        F.unix_micros("created_at").alias("created_us"),
    )
    edges = extract.standardize_edges(raw, now()).select(
        F.lit("edge").alias("kind"),
        "seq",
        F.concat("source_id", F.lit(">"), "target_id").alias("id"),
        "type",
        "scope",
        "confidence",
        F.unix_micros("created_at").alias("created_us"),
    )
    return nodes.unionByName(edges)


@query(
    """SELECT c_custkey, 0 AS chapter_pos, trim(c_name) AS chapter, 'about ' || c_mktsegment AS chapter_outline, subchapter_pos,
              CASE subchapter_pos WHEN 0 THEN 'one' ELSE 'two' END AS subchapter,
              c_name || CASE subchapter_pos WHEN 0 THEN ' - ' ELSE ' and ' END || c_mktsegment AS outline
       FROM customer, (VALUES (0), (1)) v(subchapter_pos)
       WHERE c_nationkey % 3 < 2 AND length(c_name || ' - ' || c_mktsegment) >= 30"""
)
def extract_outline(d: Data) -> DataFrame:
    """E5: accepted outlines"""
    return extract.extract_outline(d.view("plan_outputs")).rows


@query(
    """SELECT c_custkey, CASE WHEN c_nationkey % 3 = 2 THEN 'no_json' ELSE 'subchapter_outline_too_short' END AS reason,
              CASE WHEN c_nationkey % 3 = 2 THEN '' ELSE 'one' END AS title
       FROM customer WHERE c_nationkey % 3 = 2 OR length(c_name || ' - ' || c_mktsegment) < 30"""
)
def outline_rejects(d: Data) -> DataFrame:
    """E5: rejected outlines"""
    return extract.extract_outline(d.view("plan_outputs")).rejects


@query(
    """SELECT p_partkey, p_name || '~' || p_brand AS keywords, 'about ' || p_type AS summary,
              p_type || '~' || p_brand AS key_concepts FROM part"""
)
def extract_research(d: Data) -> DataFrame:
    """E6"""
    found = extract.extract_research(d.view("research_outputs"))
    return found.select("p_partkey", joined("keywords"), "summary", joined("key_concepts"))


@query(
    """SELECT doc_id, s::DOUBLE AS score, CASE WHEN doc_id % 3 = 0 THEN s >= 7 ELSE s >= 6 END AS verdict_passed, s >= 7 AS is_passed,
              'fix ' || doc_id AS rewrite_suggestions
       FROM (SELECT doc_id, length(text) % 11 AS s FROM documents) x"""
)
def extract_validation(d: Data) -> DataFrame:
    """E7"""
    return extract.extract_validation(d.view("reports")).drop("report")


@query(
    """SELECT doc_id, (length(text) % 11)::DOUBLE AS score, doc_id % 3 <> 0 AND length(text) % 11 >= 6 AS is_passed,
              'more ' || lang AS feedback FROM documents"""
)
def extract_validation_strict(d: Data) -> DataFrame:
    """E8"""
    return extract.extract_validation_strict(d.view("reports")).drop("report")


@query(
    """SELECT p_partkey, 1 AS pos, 'what is ' || p_name || '?' AS question, 'a ' || p_type || chr(10) || 'thing' AS answer,
              '初级' AS level, '概念' AS kind, p_brand AS keywords, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS qa_count FROM part
       UNION ALL
       SELECT p_partkey, 2, 'how big?', p_size::STRING, '高级', '应用', 'size', 2 FROM part WHERE p_size % 2 = 0"""
)
def extract_qa(d: Data) -> DataFrame:
    """E9"""
    outputs = d.view("qa_outputs").withColumn("qa_count", extract.qa_count("raw"))
    return extract.extract_qa(outputs)


@query(
    """SELECT event_id AS seq, CASE event_type WHEN 'view' THEN 'stage_start' ELSE 'stage_end' END AS event,
              's' || event_id % 7 AS stage
       FROM events WHERE event_type IN ('view', 'click')"""
)
def extract_progress(d: Data) -> DataFrame:
    """E10"""
    return extract.extract_progress(d.view("run_events")).select("seq", "event", "stage")


@query(
    """SELECT c_custkey, 0 AS chapter_pos, c_name AS chapter, c_mktsegment AS chapter_outline, 0 AS subchapter_pos,
              CASE WHEN c_nationkey % 2 = 0 THEN 'first' ELSE c_name END AS subchapter,
              CASE WHEN c_nationkey % 2 = 0 THEN 'o1' ELSE c_mktsegment END AS outline FROM customer
       UNION ALL
       SELECT c_custkey, 0, c_name, c_mktsegment, 1, 'second', 'o2' FROM customer WHERE c_nationkey % 2 = 0"""
)
def outline_to_sections(d: Data) -> DataFrame:
    """E11"""
    subs = F.array(
        F.struct(F.lit(" first ").alias("title"), F.lit("o1").alias("outline")),
        F.struct(F.lit("second").alias("title"), F.lit("o2").alias("outline")),
    )
    chapters = d.table("customer").select(
        "c_custkey",
        F.array(
            F.struct(
                F.concat("c_name", F.lit(" ")).alias("title"),
                F.col("c_mktsegment").alias("outline"),
                F.when(F.col("c_nationkey") % 2 == 0, subs).alias("subchapters"),
            )
        ).alias("chapters"),
    )
    return extract.outline_to_sections(chapters)
