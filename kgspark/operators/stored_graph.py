"""Mutations of a stored graph that cost as much as the batch: only the buckets it falls into are read and written.

Nodes lie in buckets by ``id``, edges by ``scope``. The rules are those of ``operators.store``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import ids
from ..sources.buckets import BUCKETS, BucketTable
from . import store
from .graph_queries import Graph


FEW_SCOPES = 100_000  # of a batch, that are sent to every task


class StoredGraph(NamedTuple):
    nodes: BucketTable
    edges: BucketTable


def open_graph(spark: SparkSession, path: str, buckets: int = BUCKETS) -> StoredGraph:
    """The graph stored at ``path``; it may be empty."""
    return StoredGraph(
        BucketTable(spark, f"{path}/nodes", schemas.KG_NODES, ["id"], ["id", "scope"], buckets),
        BucketTable(spark, f"{path}/edges", schemas.KG_EDGES, ["scope"], ["scope", "rid"], buckets),
    )


def stored_rows(stored: StoredGraph) -> Graph:
    """All nodes and edges."""
    return Graph(stored.nodes.read(), stored.edges.read())


def scope_edges(stored: StoredGraph, scope: str) -> DataFrame:
    """The edges of one scope, from its bucket alone."""
    return stored.edges.read_key(scope=scope)


def _known(stored: StoredGraph, edges: DataFrame) -> DataFrame:
    """The edges whose endpoints are stored in any scope; nodes are read from the endpoints' buckets."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    known = stored.nodes.read(stored.nodes.touched(ends)).select("id").distinct()
    for end in ("source_id", "target_id"):
        edges = edges.join(known.withColumnRenamed("id", end), end, "left_semi")
    return edges


def _outside(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """The rows of other scopes; as long as the scopes are few, the rows stay where they are."""
    few = scopes.limit(FEW_SCOPES + 1).count() <= FEW_SCOPES
    return rows.join(F.broadcast(scopes) if few else scopes, "scope", "left_anti")


def _shaped(df: DataFrame, ddl: str) -> DataFrame:
    fields = df.sparkSession.createDataFrame([], ddl).schema.fields
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def upsert_nodes(stored: StoredGraph, incoming: DataFrame) -> int:
    """Nodes merge by type and id; scope is one of the values that an incoming node sets."""
    batch = _shaped(incoming, schemas.KG_NODES)
    return stored.nodes.merge(batch, lambda old, new: store.upsert_nodes(old, new, store.MERGE_KEY))


def upsert_edges(stored: StoredGraph, incoming: DataFrame) -> int:
    """Edges merge by scope and rid; one without both endpoints is not written."""
    batch = _known(stored, _shaped(incoming, schemas.KG_EDGES))
    return stored.edges.merge(batch, lambda old, new: store.upsert(old, new, store.EDGE_KEY))


def overlay_nodes(stored: StoredGraph, incoming: DataFrame, now: Column) -> int:
    """Present values win, absent ones stay; by scope and id."""
    batch = _shaped(incoming, schemas.KG_NODES)
    return stored.nodes.merge(batch, lambda old, new: store.overlay_properties(old, new, store.NODE_KEY, now))


def replace_sections(stored: StoredGraph, new_nodes: DataFrame, new_edges: DataFrame, now: Column) -> tuple[int, int]:
    """Replaces the edges of every section of the batch and overlays its nodes; gives both new versions.

    ``new_nodes`` and ``new_edges`` carry ``src_section``. A section without edges in the batch loses those it has. The
    node table changes first, so a batch that is cut short between the two is applied again with the same result. The
    edges of other sections have no key in common with the batch and are copied; those without a scope may.
    """
    nodes = new_nodes.withColumn("scope", F.coalesce("scope", F.lit("")))
    node_version = overlay_nodes(stored, nodes, now)
    sections = new_nodes.select("src_section").unionByName(new_edges.select("src_section")).distinct()
    scopes = sections.select(ids.section_scope("src_section").alias("scope"))
    fresh = _shaped(_known(stored, store.stamp_section_scope(new_edges)), schemas.KG_EDGES)
    marked = fresh.withColumn("_new", F.lit(True)).unionByName(scopes.withColumn("_new", F.lit(False)), allowMissingColumns=True)

    def combine(old: DataFrame, batch: DataFrame) -> DataFrame:
        return store.overlay_properties(old.where("scope IS NULL"), batch.where("_new").drop("_new"), store.EDGE_KEY, now)

    def stays(old: DataFrame, batch: DataFrame) -> DataFrame:
        return _outside(old.where("scope IS NOT NULL"), batch.select("scope").distinct())

    return node_version, stored.edges.merge(marked, combine, stays)
