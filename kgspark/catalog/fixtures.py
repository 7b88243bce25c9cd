"""Graph-shaped views of the shared test tables, as SQL that Spark and DuckDB both run on the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def _views(table: Callable[[str], str], hex60: Callable[[str], str], nl: str = "chr(10)") -> dict[str, str]:
    customer, part, lineitem, orders = table("customer"), table("part"), table("lineitem"), table("orders")
    documents, events, conversations = table("documents"), table("events"), table("conversations")
    benchmark = table("benchmark")
    line_order = (
        "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT), "
        "CAST(l_quantity AS BIGINT), CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT), "
        "l_returnflag, l_linestatus)"
    )
    return {
        # seq is arrival order; for lines it is a hash of the row, since the table has no unique key
        "sections": f"""
            SELECT doc_id AS seq, source AS topic, lang AS chapter, 'doc-' || CAST(doc_id AS STRING) AS subchapter,
                   text AS content, source AS doc_id,
                   CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS chapter_pos,
                   CAST(doc_id AS INT) AS subchapter_pos,
                   substr(md5(source || '|' || lang || '|doc-' || CAST(doc_id AS STRING)), 1, 12) AS section_id
            FROM {documents}""",
        "raw_nodes": f"""
            SELECT p_partkey AS seq, 'p' || CAST(p_partkey AS STRING) AS id, p_name AS name, p_type AS type,
                   p_brand || ' ' || p_type || ' ' || CAST(p_size AS STRING) AS description,
                   split(p_brand || ',size ' || CAST(p_size AS STRING), ',') AS aliases,
                   p_brand AS chapter, 'S' || CAST(p_partkey % 20 AS STRING) AS subchapter,
                   p_retailprice / 2000.0 AS score,
                   'section:S' || CAST(p_partkey % 20 AS STRING) AS scope
            FROM {part}""",
        "raw_edges": f"""
            SELECT {hex60(line_order)} AS seq,
                   'p' || CAST(l_partkey AS STRING) AS source_id,
                   'p' || CAST((l_partkey * 7 + l_suppkey) % (SELECT count(*) FROM {part}) AS STRING) AS target_id,
                   CASE l_returnflag WHEN 'A' THEN 'REQUIRES' WHEN 'N' THEN 'PART_OF' ELSE 'SIMILAR_TO' END AS type,
                   l_quantity / 50 AS weight, 1 - 5 * l_discount AS confidence,
                   CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag || ';' || l_linestatus
                        WHEN l_linenumber = 7 THEN 'seen in a long passage of ' || l_linestatus
                        ELSE l_returnflag END AS evidence,
                   'S' || CAST(l_partkey % 20 AS STRING) AS src_section,
                   'section:S' || CAST(l_partkey % 20 AS STRING) AS scope,
                   CAST(l_shipdate AS TIMESTAMP) AS created_at
            FROM {lineitem}""",
        "incoming_nodes": f"""
            SELECT {hex60(line_order)} AS seq, 'p' || CAST(l_partkey AS STRING) AS id,
                   'section:S' || CAST(l_partkey % 20 AS STRING) AS scope,
                   CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag || l_linestatus END AS name,
                   CASE WHEN l_quantity > 25 THEN 'seen ' || CAST(l_orderkey AS STRING) END AS description,
                   CAST(l_shipdate AS TIMESTAMP) AS created_at, CAST(l_shipdate AS TIMESTAMP) AS updated_at
            FROM {lineitem}
            UNION ALL
            SELECT {hex60(line_order)}, 'v' || CAST(l_suppkey AS STRING), 'section:new', l_linestatus,
                   CAST(l_orderkey AS STRING), CAST(l_shipdate AS TIMESTAMP), CAST(l_shipdate AS TIMESTAMP)
            FROM {lineitem}""",
        "incoming_edges": f"""
            SELECT o_orderkey AS seq, CASE o_orderpriority WHEN '1-URGENT' THEN 'REQUIRES' ELSE 'PART_OF' END AS type,
                   'p' || CAST(o_orderkey % (SELECT count(*) FROM {part}) AS STRING) AS source_id,
                   CASE o_orderstatus WHEN 'F' THEN 'c' ELSE 'p' END ||
                       CAST(o_custkey % (SELECT count(*) FROM {part}) AS STRING) AS target_id,
                   o_totalprice / 1000000 AS confidence, CAST(NULL AS DOUBLE) AS weight,
                   'S' || CAST(o_custkey % 5 AS STRING) AS src_section,
                   'section:S' || CAST(o_custkey % 5 AS STRING) AS scope, CAST(o_orderdate AS TIMESTAMP) AS created_at
            FROM {orders}""",
        "call_events": f"""
            SELECT event_id AS seq, CAST(ts AS TIMESTAMP) AS ts, 'prov' || CAST(user_id % 3 AS STRING) AS provider,
                   'key' || CAST(user_id % 12 AS STRING) AS key_id, 'agent' || CAST(user_id % 5 AS STRING) AS agent,
                   'model' || CAST(user_id % 2 AS STRING) AS model,
                   CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 429 ELSE 200 END AS status_code,
                   CAST(floor(value * 10) AS BIGINT) AS latency_ms, event_id % 300 AS prompt_tokens,
                   event_id % 200 AS completion_tokens,
                   CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 500 END AS total_tokens
            FROM {events}""",
        "attempts": f"""
            SELECT CAST(conv_id AS STRING) AS section_id, CAST(turn AS INT) AS attempt, text AS content,
                   CAST(length(text) % 101 AS DOUBLE) / 10 AS score
            FROM {conversations}""",
        "reports": f"""
            SELECT doc_id, '## 验证报告' || {nl} || '### 总体评分：' || CAST(length(text) % 11 AS STRING) || '/10' || {nl}
                   || CASE WHEN doc_id % 3 = 0 THEN ''
                           WHEN length(text) % 11 >= 6 THEN '### 是否通过：是' || {nl} ELSE '### 是否通过：否' || {nl} END
                   || '### 改进建议：more ' || lang || {nl}
                   || '### 重写建议：' || 'fix ' || CAST(doc_id AS STRING) || {nl} || '### end' AS report
            FROM {documents}""",
        "outputs": f"""
            SELECT p_partkey AS seq, p_partkey AS doc_id, p_type AS topic, p_brand AS chapter,
                   'S' || CAST(p_partkey % 20 AS STRING) AS subchapter, 'en' AS language,
                   '## 知识图谱' || {nl} || '### 节点' || {nl} || '- ' || p_name || ' :  ' || p_type || ': big' || {nl} ||
                   'noise' || {nl} || '  - ' || p_brand || ': brand' || {nl} || '### 关系' || {nl} || '- ' || p_name ||
                   ' -> ' || p_brand || ': part_of' || {nl} || '- ' || p_brand || ' -> nobody: knows' || {nl} ||
                   CASE WHEN p_partkey % 50 = 0 THEN '- broken: a -> b' || {nl} ELSE '' END ||
                   '### 层次结构' || {nl} || '- ' || p_brand || {nl} || '  - ' || p_name || ' ' AS raw
            FROM {part}""",
        "plan_outputs": f"""
            SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'Plan:' || {nl} || '```json' || {nl} || doc || {nl} || '```'
                                                   WHEN 1 THEN 'Plan ' || doc || ' end' ELSE 'no plan' END AS raw
            FROM (SELECT c_custkey, c_nationkey,
                         '{{"chapters": [{{"title": " ' || c_name || '", "outline": "about ' || c_mktsegment ||
                         '", "subchapters": [{{"title": "one", "outline": "' || c_name || ' - ' || c_mktsegment ||
                         '"}}, {{"title": "two", "outline": "' || c_name || ' and ' || c_mktsegment || '"}}]}}]}}' AS doc
                  FROM {customer}) c""",
        "research_outputs": f"""
            SELECT p_partkey, '## 子章节关键词' || {nl} || p_name || ', ' || p_brand || ' , ,' || {nl} || 'rest' || {nl} ||
                   '## 子章节研究总结' || {nl} || ' about ' || p_type || {nl} || {nl} || '## 关键概念' || {nl} ||
                   p_type || ',' || p_brand AS raw
            FROM {part}""",
        "qa_outputs": f"""
            SELECT p_partkey, '### Q1: what is ' || p_name || '?' || {nl} || '**A:** a ' || p_type || {nl} || 'thing' ||
                   {nl} || '**难度:** 初级' || {nl} || '**类型:** 概念' || {nl} || '**关键词:** ' || p_brand || {nl} || {nl} ||
                   CASE WHEN p_size % 2 = 0 THEN '### Q2: how big?' || {nl} || '**A:** ' || CAST(p_size AS STRING) || {nl}
                   || '**难度:** 高级' || {nl} || '**类型:** 应用' || {nl} || '**关键词:** size' ELSE '' END AS raw
            FROM {part}""",
        "run_events": f"""
            SELECT event_id AS seq, 'run' || CAST(user_id AS STRING) AS run_id, CAST(ts AS TIMESTAMP) AS ts,
                   CASE event_type
                     WHEN 'signup' THEN '[info] run started'
                     WHEN 'view' THEN '[progress] stage_start | {{"stage": "s' || CAST(event_id % 7 AS STRING) || '"}}'
                     WHEN 'click' THEN '[progress] stage_end | {{"stage": "s' || CAST(event_id % 7 AS STRING) || '"}}'
                     WHEN 'purchase' THEN '[done] succeeded' ELSE '[error] failed' END AS message
            FROM {events}""",
        "keywords": f"""
            SELECT DISTINCT 'section:S' || CAST(p_partkey % 20 AS STRING) AS scope, word AS keyword
            FROM (SELECT p_partkey, p_brand AS word FROM {part} UNION ALL SELECT p_partkey, p_name FROM {part}
                  UNION ALL SELECT p_partkey, 'No ' || p_type FROM {part}) w""",
        "outline": f"""
            SELECT DISTINCT 'section:S' || CAST(p_partkey % 20 AS STRING) AS scope, p_brand AS chapter,
                   CASE WHEN p_size % 2 = 0 THEN 'S' || CAST(p_partkey % 20 AS STRING) END AS subchapter
            FROM {part}""",
        "keyword_sections": f"""
            SELECT p_partkey AS seq, p_type AS topic, p_brand AS chapter,
                   CAST(substr(p_brand, 7) AS INT) AS chapter_pos, CAST(p_partkey AS INT) AS subchapter_pos,
                   'sub ' || CAST(p_partkey AS STRING) AS subchapter,
                   split(CASE WHEN p_size > 2 THEN ' ' || p_name || ',,Size_' || CAST(p_size AS STRING) ||
                                      ', ' || upper(p_name) ELSE ' ' END, ',') AS keywords
            FROM {part}""",
        "named_nodes": f"""
            SELECT 'b' || CAST(item_id AS STRING) AS id, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS name,
                   split(split_part(text, ' ', 3) || '~' || split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) ||
                         ' ' || split_part(text, ' ', 3), '~') AS aliases
            FROM {benchmark}
            UNION ALL
            SELECT 'p' || CAST(p_partkey AS STRING), p_name, split(p_brand || '~size ' || CAST(p_size AS STRING), '~')
            FROM {part}""",
        "mentions": f"""
            SELECT DISTINCT 'o' || CAST(l_orderkey AS STRING) AS chunk_id, 'p' || CAST(l_partkey AS STRING) AS node_id
            FROM {lineitem}""",
    }


def duckdb_views() -> dict[str, str]:
    return _views(lambda name: name, lambda x: f"CAST('0x' || substr(md5({x}), 1, 15) AS BIGINT)")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view over the parquet files in ``sf_dir``."""
    views = _views(
        lambda table: f"parquet.`{sf_dir}/{table}.parquet`",
        lambda x: f"CAST(conv(substr(md5({x}), 1, 15), 16, 10) AS BIGINT)",
    )
    return spark.sql(views[name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(*names: str) -> str:
    """``WITH`` clause for DuckDB that defines the named fixture views."""
    views = duckdb_views()
    return "WITH " + ", ".join(f"{name} AS ({views[name]})" for name in names)
