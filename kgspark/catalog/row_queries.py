"""Rows, in place of totals, of operators whose other queries compare counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean, graph_queries, store
from ..operators.graph_queries import Graph
from ..sources import tables
from .graph_queries import TRAILS, _book_edges, _listed, _rid_edges
from .registry import Data, joined, query
from .run_queries import _graphs
from .storage_queries import _stored


def _left(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select(F.lit("node").alias("kind"), "seq", F.col("id").alias("what")).unionByName(
        edges.select(F.lit("edge").alias("kind"), "seq", F.col("type").alias("what"))
    )


@query(
    """WITH touched AS (SELECT source_id AS id FROM incoming_edges WHERE scope <> 'section:S3' UNION
                        SELECT target_id FROM incoming_edges WHERE scope <> 'section:S3')
        SELECT 'node' AS kind, seq, id AS what FROM raw_nodes WHERE scope <> 'section:S3' OR id IN (SELECT id FROM touched)
        UNION ALL SELECT 'edge', seq, type FROM incoming_edges WHERE scope <> 'section:S3'""",
    "raw_nodes incoming_edges",
)
def delete_scope_rows(d: Data) -> DataFrame:
    """What is left"""
    left = store.delete_scope(d.view("raw_nodes"), d.view("incoming_edges"), "section:S3")
    return _left(left.nodes, left.edges)


@query(
    """SELECT 'node' AS kind, seq, id AS what FROM raw_nodes WHERE scope <> 'section:S3'
       UNION ALL SELECT 'edge', seq, type FROM incoming_edges WHERE scope <> 'section:S3'""",
    "raw_nodes incoming_edges",
)
def delete_scope_hard_rows(d: Data) -> DataFrame:
    """What is left"""
    left = store.delete_scope_hard(d.view("raw_nodes"), d.view("incoming_edges"), "section:S3")
    return _left(left.nodes, left.edges)


@query(
    """SELECT 'scope' AS rule, seq FROM raw_edges WHERE scope <> 'section:S3'
       UNION ALL SELECT 'src', seq FROM raw_edges WHERE src_section <> 'S4'""",
    "raw_edges",
)
def delete_edges_rows(d: Data) -> DataFrame:
    """The relations left"""
    by_scope, _ = store.delete_edges_by_scope(d.view("raw_edges"), "section:S3")
    by_source, _ = store.delete_edges_by_src(d.view("raw_edges"), "S4")
    return by_scope.select(F.lit("scope").alias("rule"), "seq").unionByName(by_source.select(F.lit("src").alias("rule"), "seq"))


@query(
    """SELECT 'edge' AS kind, seq, source_id || target_id AS what FROM raw_edges WHERE confidence >= 0.9
       UNION ALL SELECT 'node', seq, id FROM raw_nodes WHERE id IN (SELECT source_id FROM raw_edges WHERE confidence >= 0.9
           UNION SELECT target_id FROM raw_edges WHERE confidence >= 0.9)""",
    "raw_nodes raw_edges",
)
def section_view_rows(d: Data) -> DataFrame:
    """Nodes and relations of the book that a section belongs to"""
    return _listed(graph_queries.section_view(_book_edges(d), d.view("raw_nodes"), "S7"))


@query(
    f"""WITH {TRAILS} SELECT len AS length, array_to_string(rids, '~') AS rids, array_to_string(ids, '~') AS node_ids
        FROM trails WHERE len <= 2""",
    "raw_edges",
)
def all_trails_rows(d: Data) -> DataFrame:
    """G8 without limit: the trails"""
    edges = clean.scope_filter(_rid_edges(d), "section:S1")
    center = clean.scope_filter(d.view("raw_nodes"), "section:S1").where("id = 'p1'").select(F.col("id").alias("center"))
    return graph_queries.all_trails(edges, center, 2).select("length", joined("rids"), joined("node_ids"))


@query(
    """SELECT seq, scope, CASE WHEN scope = 'section:S3' THEN 'new' ELSE name END AS name, type, array_to_string(aliases, '~') AS aliases
       FROM raw_nodes""",
    "raw_nodes",
)
def write_graph_rows(d: Data) -> DataFrame:
    """A2: all nodes after one scope was written again"""
    path = _stored(d)
    one = tables.load_graph(d.spark, path, "section:S3")
    tables.write_graph(Graph(one.nodes.withColumn("name", F.lit("new")), one.edges), path)
    return tables.load_graph(d.spark, path).nodes.select("seq", "scope", "name", "type", joined("aliases"))


@query(
    """SELECT DISTINCT substr(md5(p_type || '|' || p_brand || '|S' || p_partkey % 20), 1, 12) AS section_id, unnest([p_name, p_brand]) AS name
       FROM part WHERE p_partkey % 50 <> 0"""
)
def build_section_graphs_rows(d: Data) -> DataFrame:
    """The names of every section"""
    return _graphs(d).nodes.select("section_id", "name").distinct()
