"""Graph quality per scope: structure, richness, coverage, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .components import connected_components
from .containment import contained

# Score weights and markers.
UNKNOWN_SUBCHAPTER = "未知子章节"
UNKNOWN_RELATION = "UNKNOWN"
SUBCHAPTER_WEIGHT, KEYWORD_WEIGHT, CONNECTIVITY_WEIGHT, RICHNESS_WEIGHT = 0.4, 0.3, 0.2, 0.1
QUALITY_CONNECTIVITY, QUALITY_RICHNESS, QUALITY_COVERAGE = 0.3, 0.3, 0.4
REPORT = (
    "知识图谱评估结果:\n- 节点数量: %d\n- 关系数量: %d\n- 连通性得分: %s\n- 关系丰富度: %s\n"
    "- 知识覆盖度: %s\n- 总体质量分数: %s"
)
BRIEF = "知识图谱构建摘要：\n- 节点数量: %d\n- 边数量: %d\n- 连通性分数: %s\n- 覆盖度分数: %s"


def _zero(name: str, kind: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0).cast(kind)).alias(name)


def graph_totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Row counts of the whole store."""
    rows = nodes.select(F.lit(1).alias("is_node")).unionByName(edges.select(F.lit(0).alias("is_node")))
    return rows.agg(
        F.count_if(F.col("is_node") == 1).alias("total_nodes"), F.count_if(F.col("is_node") == 0).alias("total_edges")
    )


def scope_totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    rows = nodes.select("scope", F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(
        edges.select("scope", F.lit(0).alias("n"), F.lit(1).alias("e"))
    )
    return rows.groupBy("scope").agg(F.sum("n").alias("total_nodes"), F.sum("e").alias("total_edges"))


def graph_structure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Components and connectivity per scope. Connectivity divides the largest component by node rows."""
    sizes = connected_components(nodes, edges).groupBy("scope", "component").agg(F.count(F.lit(1)).alias("size"))
    components = sizes.groupBy("scope").agg(
        F.count(F.lit(1)).alias("components"), F.max("size").alias("max_component_size")
    )
    joined = scope_totals(nodes, edges).join(components, "scope", "left")
    return joined.select(
        "scope",
        F.coalesce(F.col("max_component_size") / F.nullif("total_nodes", F.lit(0)), F.lit(0.0)).alias(
            "connectivity_score"
        ),
        _zero("components", "long"),
        _zero("max_component_size", "long"),
        "total_nodes",
        "total_edges",
    )


def relation_types(edges: DataFrame) -> DataFrame:
    """Relations per scope and type."""
    return edges.groupBy("scope", F.coalesce("type", F.lit(UNKNOWN_RELATION)).alias("type")).agg(
        F.count(F.lit(1)).alias("relations")
    )


def _richness() -> Column:
    some = F.col("total_nodes") > 0
    return F.when(some, F.least(F.lit(1.0), F.try_divide("total_edges", "total_nodes"))).otherwise(F.lit(0.0))


def relation_richness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Relations per node, at most 1; dangling relations count."""
    return scope_totals(nodes, edges).withColumn("relation_richness", _richness())


def subchapter_coverage(nodes: DataFrame, outline: DataFrame) -> DataFrame:
    """Covered subchapters over outline titles per scope (1 without an outline); may exceed 1."""
    named = (t.or_empty("subchapter") != "") & (F.col("subchapter") != UNKNOWN_SUBCHAPTER)
    covered = nodes.groupBy("scope").agg(
        F.count_distinct(F.when(named, F.col("subchapter"))).alias("covered_subchapters")
    )
    titles = outline.groupBy("scope").agg(
        F.count_distinct(F.coalesce("subchapter", "chapter")).alias("total_subchapters")
    )
    joined = covered.join(titles, "scope", "full")
    ratio = F.coalesce("covered_subchapters", F.lit(0)) / F.nullif("total_subchapters", F.lit(0))
    return joined.select(
        "scope",
        _zero("covered_subchapters", "long"),
        _zero("total_subchapters", "long"),
        F.coalesce(ratio, F.lit(1.0)).alias("subchapter_coverage"),
    )


def keyword_hits(nodes: DataFrame, keywords: DataFrame) -> DataFrame:
    """Distinct (scope, keyword) pairs where the keyword occurs in a name, description or alias, ignoring case.

    Keywords meet the distinct texts of their scope on their rarest characters; see ``containment.contained``.
    """
    needles = keywords.select("scope", "keyword", F.lower("keyword").alias("name"))
    texts = nodes.select(
        "scope",
        F.explode(
            F.concat(F.array("name", "description"), F.coalesce("aliases", F.array().cast("array<string>")))
        ).alias("text"),
    ).select("scope", F.lower("text").alias("text"))
    return contained(texts, needles, ["scope"]).join(needles, ["scope", "name"]).select("scope", "keyword").distinct()


def keyword_coverage(nodes: DataFrame, keywords: DataFrame) -> DataFrame:
    """Hit keywords over distinct keywords per scope."""
    total = keywords.groupBy("scope").agg(F.count_distinct("keyword").alias("total_keywords"))
    hits = keyword_hits(nodes, keywords).groupBy("scope").agg(F.count(F.lit(1)).alias("covered_keywords"))
    return total.join(hits, "scope", "left").select(
        "scope",
        _zero("covered_keywords", "long"),
        "total_keywords",
        (F.coalesce("covered_keywords", F.lit(0)) / F.col("total_keywords")).alias("keyword_coverage"),
    )


def coverage_score() -> Column:
    return (
        SUBCHAPTER_WEIGHT * F.col("subchapter_coverage")
        + KEYWORD_WEIGHT * F.col("keyword_coverage")
        + CONNECTIVITY_WEIGHT * F.col("connectivity_score")
        + RICHNESS_WEIGHT * F.col("relation_richness")
    )


def evaluate_graph(nodes: DataFrame, edges: DataFrame, outline: DataFrame, keywords: DataFrame) -> DataFrame:
    """All measures of every scope that has nodes, edges, an outline or keywords; the last two carry ``scope``.

    A scope without outline or without keywords counts as covered in that respect; an empty graph has no connectivity.
    """
    joined = (
        graph_structure(nodes, edges)
        .join(subchapter_coverage(nodes, outline), "scope", "full")
        .join(keyword_coverage(nodes, keywords), "scope", "full")
        .withColumns(
            {
                "connectivity_score": F.coalesce("connectivity_score", F.lit(0.0)),
                "components": _zero("components", "long"),
                "max_component_size": _zero("max_component_size", "long"),
                "total_nodes": _zero("total_nodes", "long"),
                "total_edges": _zero("total_edges", "long"),
                "subchapter_coverage": F.coalesce("subchapter_coverage", F.lit(1.0)),
                "keyword_coverage": F.coalesce("keyword_coverage", F.lit(1.0)),
                "covered_subchapters": _zero("covered_subchapters", "long"),
                "total_subchapters": _zero("total_subchapters", "long"),
                "covered_keywords": _zero("covered_keywords", "long"),
                "total_keywords": _zero("total_keywords", "long"),
            }
        )
        .withColumn("relation_richness", _richness())
    )
    quality = (
        QUALITY_CONNECTIVITY * F.col("connectivity_score")
        + QUALITY_RICHNESS * F.col("relation_richness")
        + QUALITY_COVERAGE * F.col("coverage_score")
    )
    report = F.format_string(
        REPORT,
        "total_nodes",
        "total_edges",
        t.two_decimals("connectivity_score"),
        t.two_decimals("relation_richness"),
        t.two_decimals("coverage_score"),
        t.two_decimals("quality_score"),
    )
    return (
        joined.withColumn("coverage_score", coverage_score())
        .withColumn("quality_score", quality)
        .withColumn("kg_summary", report)
    )


def brief_summary() -> Column:
    """Short text over the columns of ``evaluate_graph``."""
    return F.format_string(
        BRIEF, "total_nodes", "total_edges", t.two_decimals("connectivity_score"), t.two_decimals("coverage_score")
    )
