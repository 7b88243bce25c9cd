"""Mutations of the stored graph: upsert, overlay, delete, replace, promote.

A stored row is keyed by scope and id (nodes) or rid (edges). Every upsert is one union and one partial-aggregated
group-by: existing rows rank before incoming rows, incoming rows rank by ``seq``.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as t
from .ordering import last_wins

NODE_KEY = ("scope", "id")
MERGE_KEY = ("type", "id")  # of nodes that are merged whatever their scope
EDGE_KEY = ("scope", "rid")

# Defaults of promoted relations.
PROMOTED_CONFIDENCE = 0.8
PROMOTED_WEIGHT = 1.0


class Deleted(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    deleted: DataFrame


def _ranked_union(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    old = existing.withColumn("_rank", F.struct(F.lit(0).alias("batch"), F.col("seq").alias("seq")))
    new = incoming.withColumn("_rank", F.struct(F.lit(1).alias("batch"), F.col("seq").alias("seq")))
    return old.unionByName(new, allowMissingColumns=True)


def upsert(existing: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """The last incoming row of a key replaces the stored one but for ``created_at``."""
    rows = _ranked_union(existing, incoming)
    payload = [c for c in rows.columns if c not in (*key, "created_at", "_rank")]
    merged = rows.groupBy(*key).agg(
        F.max_by(F.struct(*payload), "_rank").alias("_row"), F.min_by("created_at", "_rank").alias("created_at")
    )
    return merged.select(*key, "_row.*", "created_at").select(*[c for c in rows.columns if c != "_rank"])


def upsert_nodes(existing: DataFrame, incoming: DataFrame, key: Sequence[str] = NODE_KEY) -> DataFrame:
    """Incoming values replace stored ones; ``created_at`` is set only when the node is created.

    By default scopes are kept apart. With ``key=MERGE_KEY`` nodes are the same by type and id, and the scope is one of
    the values set, as in ``stored_graph.upsert_nodes``.
    """
    return upsert(existing, incoming, key)


def upsert_edges(
    existing: DataFrame, incoming: DataFrame, nodes: DataFrame, key: Sequence[str] = EDGE_KEY
) -> DataFrame:
    """As for nodes; an incoming edge is written only when both endpoints are stored."""
    known = nodes.select("id").distinct()
    for end in ("source_id", "target_id"):
        incoming = incoming.join(known.withColumnRenamed("id", end), end, "left_semi")
    return upsert(existing, incoming, key)


def overlay_properties(existing: DataFrame, incoming: DataFrame, key: Sequence[str], now: Column) -> DataFrame:
    """Present incoming properties win, absent ones keep the stored value; touched rows get ``updated_at = now``."""
    rows = _ranked_union(existing, incoming)
    plain = [c for c in rows.columns if c not in (*key, "_rank", "created_at", "updated_at")]
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_rank"))).alias(c) for c in plain]
    created = F.max_by("created_at", F.when(F.col("created_at").isNotNull(), F.col("_rank")))
    merged = rows.groupBy(*key).agg(
        *latest,
        created.alias("_created"),
        F.max_by("updated_at", "_rank").alias("_stored_update"),
        F.max("_rank.batch").alias("_batch"),
    )
    touched = F.col("_batch") == 1
    return (
        merged.withColumn("created_at", F.when(touched, F.coalesce("_created", now)).otherwise(F.col("_created")))
        .withColumn("updated_at", F.when(touched, now).otherwise(F.col("_stored_update")))
        .select(*[c for c in rows.columns if c != "_rank"])
    )


def upsert_stats(existing: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """``created`` and ``updated`` counts: the first sight of a key creates it, every repeat updates it."""
    per_key = incoming.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    stored = existing.select(*key).distinct().withColumn("_stored", F.lit(1))
    matched = per_key.join(stored, list(key), "left")
    created = F.count_if(F.col("_stored").isNull())
    return matched.agg(
        created.alias("created"), (F.coalesce(F.sum("_rows"), F.lit(0)) - created).alias("updated")
    )


def delete_scope(nodes: DataFrame, edges: DataFrame, scope: str) -> Deleted:
    """Delete the edges of a scope, then its nodes that no remaining edge of any scope touches."""
    in_scope = F.col("scope") == scope
    kept_edges = edges.where(~in_scope)
    touched = (
        kept_edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct().withColumn("_used", F.lit(1))
    )
    candidates = nodes.where(in_scope).join(touched, "id", "left")
    survivors = candidates.where("_used IS NOT NULL").drop("_used").select(*nodes.columns)
    gone = (
        edges.where(in_scope)
        .select(F.lit("edge").alias("kind"))
        .unionByName(candidates.where("_used IS NULL").select(F.lit("node").alias("kind")))
    )
    return Deleted(nodes.where(~in_scope).unionByName(survivors), kept_edges, _deleted_counts(gone))


def delete_scope_hard(nodes: DataFrame, edges: DataFrame, scope: str) -> Deleted:
    """Delete all edges and nodes of a scope."""
    in_scope = F.col("scope") == scope
    gone = (
        edges.where(in_scope)
        .select(F.lit("edge").alias("kind"))
        .unionByName(nodes.where(in_scope).select(F.lit("node").alias("kind")))
    )
    return Deleted(nodes.where(~in_scope), edges.where(~in_scope), _deleted_counts(gone))


def _deleted_counts(gone: DataFrame) -> DataFrame:
    return gone.agg(
        F.count_if(F.col("kind") == "edge").alias("edges_deleted"),
        F.count_if(F.col("kind") == "node").alias("nodes_deleted"),
        F.count(F.lit(1)).alias("deleted"),
    )


def delete_edges_by_scope(edges: DataFrame, scope: str) -> tuple[DataFrame, DataFrame]:
    """Remaining edges and the count of deleted ones."""
    return _delete_edges(edges, F.col("scope") == scope)


def delete_edges_by_src(edges: DataFrame, section_id: str) -> tuple[DataFrame, DataFrame]:
    """Delete the relations that one section contributed."""
    return _delete_edges(edges, F.col("src_section") == section_id)


def _delete_edges(edges: DataFrame, doomed: Column) -> tuple[DataFrame, DataFrame]:
    doomed = F.coalesce(doomed, F.lit(False))
    return edges.where(~doomed), edges.agg(F.count_if(doomed).alias("edges_deleted"))


def stamp_section_scope(edges: DataFrame) -> DataFrame:
    """Edges of a section graph as they are stored: section scope and the rid that follows from it."""
    scoped = edges.withColumn("scope", ids.section_scope("src_section"))
    return scoped.withColumn("rid", ids.relation_rid("type", "source_id", "target_id", "scope"))


class Replaced(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    stats: DataFrame


def replace_section_graph(
    nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, now: Column
) -> Replaced:
    """Replace the stored edges of every section in the batch and overlay its nodes.

    ``new_nodes`` and ``new_edges`` carry ``src_section``. Works on any number of sections at once; applying the same
    batch twice gives the same tables.
    """
    stamped = stamp_section_scope(new_edges)
    scopes = (
        new_nodes.select("src_section").unionByName(new_edges.select("src_section")).distinct()
        .select("src_section", ids.section_scope("src_section").alias("scope"))
    )
    kept = edges.join(scopes, "scope", "left_anti")
    batch_nodes = new_nodes.drop("src_section").withColumn("scope", t.or_empty("scope"))
    merged_nodes = overlay_properties(nodes, batch_nodes, NODE_KEY, now)
    known = merged_nodes.select("id").distinct()
    writable = stamped
    for end in ("source_id", "target_id"):
        writable = writable.join(known.withColumnRenamed("id", end), end, "left_semi")
    merged_edges = overlay_properties(kept, writable, EDGE_KEY, now)
    counts = (
        new_nodes.select("src_section", F.lit("node").alias("kind"))
        .unionByName(new_edges.select("src_section", F.lit("edge").alias("kind")))
        .unionByName(edges.join(scopes, "scope").select(scopes["src_section"], F.lit("old").alias("kind")))
    )
    stats = counts.groupBy("src_section").agg(
        F.lit(True).alias("success"),
        F.count_if(F.col("kind") == "node").alias("nodes_written"),
        F.count_if(F.col("kind") == "edge").alias("edges_written"),
        F.count_if(F.col("kind") == "old").alias("edges_deleted"),
    )
    return Replaced(merged_nodes, merged_edges, stats)


def promote_to_book(edges: DataFrame, section_ids: DataFrame, book_id: str) -> DataFrame:
    """Book-scope copies of the section edges: new rid, no source section, equal relations collapse (the last wins)."""
    scopes = section_ids.select(ids.section_scope("section_id").alias("scope")).distinct()
    return last_wins(
        edges.join(scopes, "scope", "left_semi")
        .withColumn("scope", F.lit(book_id))
        .withColumn("src_section", F.lit(None).cast("string"))
        .withColumn("confidence", F.coalesce("confidence", F.lit(PROMOTED_CONFIDENCE)))
        .withColumn("weight", F.coalesce("weight", F.lit(PROMOTED_WEIGHT)))
        .withColumn("rid", ids.relation_rid("type", "source_id", "target_id", "scope")),
        ["rid"],
    )


def replace_book_edges(edges: DataFrame, section_ids: DataFrame, book_id: str) -> DataFrame:
    """The stored edges with the old book scope dropped and the promoted section edges added."""
    return edges.where(F.col("scope") != book_id).unionByName(promote_to_book(edges, section_ids, book_id))


def check_unique(nodes: DataFrame) -> DataFrame:
    """Violations of id uniqueness per node type."""
    return nodes.groupBy("type", "id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
