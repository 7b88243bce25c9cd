"""Normalisation, thresholds and row filters of graphs and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as t
from ..schemas import DEFAULT_CONTENT_LANGUAGE

# Thresholds and defaults.
THETA_ADD = 0.55
THETA_SHOW = 0.60
MIN_EVIDENCE = 2
DEFAULT_NODE_SCORE = 1.0
DEFAULT_EDGE_WEIGHT = 1.0
DEFAULT_EDGE_CONFIDENCE = 0.8
DEFAULT_RAW_RELATION = "MENTIONS"
NODE_SOURCE = "llm_generated"
RAW_EDGE_EVIDENCE = "从文本中抽取的关系: %s -> %s"
DEFAULT_WORKFLOW = "textbook"
DEFAULT_CHAPTER_COUNT = 8


def normalize_nodes(nodes: DataFrame) -> DataFrame:
    """Clean names, descriptions and aliases; nodes without a name are dropped."""
    return (
        nodes.withColumn("name", t.normalize_name("name"))
        .where("name <> ''")
        .withColumn("description", t.normalize_description("description"))
        .withColumn("aliases", t.normalize_aliases("aliases", "name"))
    )


def normalize_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumn("description", t.normalize_description("description"))


def normalize_raw_nodes(raw: DataFrame, now: Column) -> DataFrame:
    """Raw nodes with id and type pass through; the rest get a concept id, a canonical key and defaults."""
    done = F.col("id").isNotNull() & F.col("type").isNotNull()

    def unless_done(name: str, value: Column) -> Column:
        return F.when(done, F.col(name)).otherwise(value).alias(name)

    return raw.where(done | (t.or_empty("name") != "")).select(
        unless_done("id", ids.concept_id("name", "topic", "chapter", "subchapter")),
        unless_done("type", F.lit("concept")),
        "name",
        unless_done("description", t.or_empty("description")),
        unless_done("canonical_key", t.slug("name")),
        unless_done("aliases", F.coalesce("aliases", F.array().cast("array<string>"))),
        "chapter",
        "subchapter",
        unless_done("score", F.coalesce("score", F.lit(DEFAULT_NODE_SCORE))),
        unless_done("source", F.lit(NODE_SOURCE)),
        unless_done("created_at", now),
        unless_done("updated_at", now),
        "seq",
    )


def normalize_raw_edges(raw: DataFrame, now: Column) -> DataFrame:
    """Raw relations with id and endpoints pass through; the rest are resolved from endpoint names."""
    done = F.col("id").isNotNull() & F.col("source_id").isNotNull() & F.col("target_id").isNotNull()

    def unless_done(name: str, value: Column) -> Column:
        return F.when(done, F.col(name)).otherwise(value).alias(name)

    named = (t.or_empty("source_name") != "") & (t.or_empty("target_name") != "")
    type_ = F.upper(F.coalesce("type", F.lit(DEFAULT_RAW_RELATION)))
    source = ids.concept_id("source_name", "topic", "chapter", "subchapter")
    target = ids.concept_id("target_name", "topic", "chapter", "subchapter")
    return raw.where(done | named).select(
        unless_done("id", ids.legacy_edge_id(type_, source, target)),
        unless_done("type", type_),
        unless_done("source_id", source),
        unless_done("target_id", target),
        "source_name",
        "target_name",
        unless_done("weight", F.coalesce("weight", F.lit(DEFAULT_EDGE_WEIGHT))),
        unless_done("confidence", F.coalesce("confidence", F.lit(DEFAULT_EDGE_CONFIDENCE))),
        unless_done(
            "evidence", F.coalesce("evidence", F.format_string(RAW_EDGE_EVIDENCE, "source_name", "target_name"))
        ),
        "chapter",
        "src_section",
        unless_done("created_at", now),
        unless_done("updated_at", now),
        "seq",
    )


def filter_storage(edges: DataFrame, theta_add: float = THETA_ADD) -> DataFrame:
    """Relations confident enough to be stored; a missing confidence counts as 0."""
    return edges.where(F.coalesce("confidence", F.lit(0.0)) >= theta_add)


def filter_display(edges: DataFrame, theta_show: float = THETA_SHOW, min_evidence: int = MIN_EVIDENCE) -> DataFrame:
    """Relations confident and evidenced enough to be shown."""
    return edges.where(
        (F.coalesce("confidence", F.lit(0.0)) >= theta_show) & (t.evidence_count("evidence") >= min_evidence)
    )


def drop_dangling(edges: DataFrame, nodes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Relations whose two endpoints exist (within the same ``by`` group)."""
    by = by or []
    known = nodes.select(*by, "id")
    for end in ("source_id", "target_id"):
        edges = edges.join(known.withColumnRenamed("id", end), [*by, end], "left_semi")
    return edges


def scope_filter(df: DataFrame, scope: str | None) -> DataFrame:
    """Rows of one scope; ``None`` means all. On a scope-partitioned table this prunes partitions."""
    return df if scope is None else df.where(F.col("scope") == scope)


def graph_view(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Display projection of a graph."""
    view_nodes = nodes.select(
        "id",
        F.coalesce(F.nullif("name", F.lit("")), F.col("id")).alias("label"),
        F.coalesce(F.nullif("type", F.lit("")), F.lit("concept")).alias("type"),
    )
    pair = F.concat("source_id", F.lit("-"), "target_id")
    view_edges = edges.select(
        F.coalesce(F.nullif("rid", F.lit("")), pair).alias("id"),
        F.col("source_id").alias("source"),
        F.col("target_id").alias("target"),
        t.or_empty("type").alias("label"),
        F.coalesce(F.nullif("type", F.lit("")), F.lit("relation")).alias("type"),
    )
    return view_nodes, view_edges


def _with_errors(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``errors``: names of the broken rules. A rule that evaluates to NULL is broken."""
    broken = [F.when(F.coalesce(rule, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, rule in rules.items()]
    return df.withColumn("errors", F.array_compact(F.array(*broken)))


def validate_run_requests(requests: DataFrame) -> DataFrame:
    """Fill the defaults of run requests and list the broken rules in ``errors`` (empty when valid)."""
    filled = (
        requests.withColumn("language", F.coalesce("language", F.lit(DEFAULT_CONTENT_LANGUAGE)))
        .withColumn("chapter_count", F.coalesce("chapter_count", F.lit(DEFAULT_CHAPTER_COUNT)))
        .withColumn("workflow_id", F.coalesce("workflow_id", F.lit(DEFAULT_WORKFLOW)))
    )
    return _with_errors(
        filled, {"topic": F.col("topic").isNotNull(), "chapter_count": F.col("chapter_count").between(1, 20)}
    )


def validate_requests(requests: DataFrame) -> DataFrame:
    """Model requests with the broken rules in ``errors``."""
    return _with_errors(
        requests,
        {
            "model": t.or_empty("model") != "",
            "messages": F.size("messages") > 0,
            "temperature": F.col("temperature").between(0, 2),
            "max_tokens": F.col("max_tokens") >= 1,
        },
    )
