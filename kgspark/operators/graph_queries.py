"""Read queries on a stored graph: details, neighbourhoods, search, scope graphs, statistics."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .clean import scope_filter

# Result bounds of the query API.
CHUNK_IDS = 10
SUBGRAPH_DEPTH = 2
SUBGRAPH_TRAILS = 50
SEARCH_LIMIT = 20
CHUNK_ENTITIES = 30
CHUNK_PATHS = 20
BOOK_PREFIX = "book:"

PUSHED_IDS = 1000

TRAIL = "center STRING, length INT, rids ARRAY<STRING>, node_ids ARRAY<STRING>"


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


# -------------------------------------------------------------- scope graphs


def _induced(edges: DataFrame, nodes: DataFrame) -> Graph:
    """The edges with the nodes at their ends."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return Graph(nodes.join(ends, "id", "left_semi").select(*nodes.columns), edges)


def section_graph(edges: DataFrame, nodes: DataFrame, section_id: str) -> Graph:
    """Relations of one section and their endpoint nodes; without relations there are no nodes."""
    return _induced(edges.where(F.col("src_section") == section_id), nodes)


def book_scope_of(book_id: str) -> str:
    return book_id if book_id.startswith(BOOK_PREFIX) else BOOK_PREFIX + book_id


def book_graph(edges: DataFrame, nodes: DataFrame, book_id: str) -> Graph:
    """Relations of a book scope and their endpoint nodes; the prefix of the id may be left out."""
    return _induced(edges.where(F.col("scope") == book_scope_of(book_id)), nodes)


def book_of_section(edges: DataFrame, section_id: str) -> DataFrame:
    """One row ``book_id``: the scope (least, if several) that holds relations of the section, without prefix."""
    scopes = edges.where(F.col("src_section") == section_id).agg(F.min("scope").alias("scope")).where("scope IS NOT NULL")
    return scopes.select(F.regexp_replace("scope", f"^{BOOK_PREFIX}", "").alias("book_id"))


def section_view(edges: DataFrame, nodes: DataFrame, section_id: str) -> Graph:
    """The whole book graph that a section belongs to; empty for an unknown section."""
    scope = book_of_section(edges, section_id).select(F.concat(F.lit(BOOK_PREFIX), "book_id").alias("scope"))
    return _induced(edges.join(scope, "scope", "left_semi").select(*edges.columns), nodes)


def graph_stats(graph: Graph) -> DataFrame:
    rows = graph.nodes.select(F.lit(1).alias("is_node")).unionByName(graph.edges.select(F.lit(0).alias("is_node")))
    return rows.agg(
        F.count_if(F.col("is_node") == 1).alias("total_nodes"), F.count_if(F.col("is_node") == 0).alias("total_edges")
    )


def book_stats(nodes: DataFrame, edges: DataFrame, book_id: str) -> DataFrame:
    """Distinct nodes and edges of a scope and the types that occur; no row for a scope without nodes."""
    rows = (
        nodes.where(F.col("scope") == book_id)
        .select(F.lit("node").alias("kind"), "id", "type")
        .unionByName(edges.where(F.col("scope") == book_id).select(F.lit("edge").alias("kind"), F.col("rid").alias("id"), "type"))
    )
    totals = rows.groupBy("kind").agg(F.count_distinct("id").alias("_total"))
    types = rows.where("type <> ''").select("kind", "type").distinct()
    per_kind = totals.join(types, "kind", "left")

    def total(kind: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("_total"))), F.lit(0))

    def listed(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("type"))))

    return (
        per_kind.agg(
            total("node").alias("total_nodes"),
            total("edge").alias("total_edges"),
            listed("node").alias("node_types"),
            listed("edge").alias("edge_types"),
        )
        .where("total_nodes > 0")
        .select(F.lit(book_id).alias("book_id"), "*")
    )


# ------------------------------------------------------------------- details


def chunk_evidence(mentions: DataFrame, limit: int = CHUNK_IDS) -> DataFrame:
    """Per node: the first ``limit`` chunk ids and the number of distinct chunks."""
    pairs = mentions.select("node_id", "chunk_id").distinct()
    counts = pairs.groupBy("node_id").agg(F.count(F.lit(1)).alias("evidence_count"))
    rank = F.row_number().over(Window.partitionBy("node_id").orderBy("chunk_id"))
    first = (
        pairs.withColumn("_rank", rank)
        .where(F.col("_rank") <= limit)
        .groupBy("node_id")
        .agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))
    )
    return counts.join(first, "node_id")


def node_details(nodes: DataFrame, mentions: DataFrame) -> DataFrame:
    """Nodes with their evidence; a node that no chunk mentions has none."""
    evidence = chunk_evidence(mentions).withColumnRenamed("node_id", "id")
    return nodes.join(evidence, "id", "left").withColumns(
        {
            "chunk_ids": F.coalesce("chunk_ids", F.array().cast("array<string>")),
            "evidence_count": F.coalesce("evidence_count", F.lit(0)),
        }
    )


def node_detail(nodes: DataFrame, mentions: DataFrame, node_id: str, scope: str | None = None) -> DataFrame:
    found = scope_filter(nodes.where(F.col("id") == node_id), scope)
    return node_details(found, mentions.where(F.col("node_id") == node_id)).orderBy("scope").limit(1)


def edge_details(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with name and type of both ends. ``nodes`` is unique by scope and id."""
    ends = nodes.select("scope", "id", "name", "type")

    def end(prefix: str) -> DataFrame:
        return ends.select(
            "scope",
            F.col("id").alias(f"{prefix}_id"),
            F.struct("id", "name", "type").alias(prefix),
        )

    return (
        edges.join(end("source"), ["scope", "source_id"])
        .join(end("target"), ["scope", "target_id"])
        .select(
            "rid",
            "type",
            t.or_empty("description").alias("description"),
            F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
            F.coalesce("weight", F.lit(1.0)).alias("weight"),
            "scope",
            "src_section",
            "created_at",
            "source",
            "target",
        )
    )


def edge_detail(edges: DataFrame, nodes: DataFrame, rid: str, scope: str | None = None) -> DataFrame:
    found = scope_filter(edges.where(F.col("rid") == rid), scope)
    return edge_details(found, nodes).orderBy("scope").limit(1)


# ------------------------------------------------------------ neighbourhoods


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in both directions (a loop once)."""
    both = F.array_distinct(
        F.array(
            F.struct(F.col("source_id").alias("here"), F.col("target_id").alias("there")),
            F.struct(F.col("target_id").alias("here"), F.col("source_id").alias("there")),
        )
    )
    return edges.select("rid", F.explode(both).alias("_arc")).select("rid", "_arc.here", "_arc.there")


def _extend(trails: DataFrame, arcs: DataFrame) -> DataFrame:
    """Trails that are one edge longer and use no edge twice."""
    return (
        trails.withColumn("here", F.element_at("node_ids", -1))
        .join(arcs, "here")
        .where(~F.array_contains("rids", F.col("rid")))
        .select(
            "center",
            (F.col("length") + 1).alias("length"),
            F.array_append("rids", F.col("rid")).alias("rids"),
            F.array_append("node_ids", F.col("there")).alias("node_ids"),
        )
    )


def _start(centers: DataFrame) -> DataFrame:
    return centers.select(
        "center",
        F.lit(0).alias("length"),
        F.array().cast("array<string>").alias("rids"),
        F.array("center").alias("node_ids"),
    )


def all_trails(edges: DataFrame, centers: DataFrame, depth: int) -> DataFrame:
    """Every trail of 1 to ``depth`` edges from the given ``center`` values, unlimited."""
    arcs, frontier, found = both_ways(edges), _start(centers), None
    for _ in range(depth):
        frontier = _extend(frontier, arcs)
        found = frontier if found is None else found.unionByName(frontier)
    return found


def _touching(edges: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Edges at the given nodes; a short list goes to the file scan, where statistics skip what cannot match."""
    if len(ids) > PUSHED_IDS:
        return edges
    return edges.where(F.col("source_id").isin(*ids) | F.col("target_id").isin(*ids))


def first_trails(edges: DataFrame, centers: Sequence[str], depth: int, limit: int) -> DataFrame:
    """The first ``limit`` trails by length, center and relation ids.

    Shorter trails come first, so the search ends at the length that fills the limit. Whatever is expanded further is
    fewer than ``limit`` trails: the broadcast side and the rows on the driver are bounded by it, however many
    neighbours a hub has.
    """
    spark = edges.sparkSession
    frontier = _start(spark.createDataFrame([(c,) for c in centers], "center STRING"))
    ends = sorted(set(centers))
    found: list = []
    for _ in range(depth):
        room = limit - len(found)
        arcs = both_ways(_touching(edges, ends))
        step = _extend(F.broadcast(frontier), arcs).orderBy("center", "rids", "node_ids").limit(room)
        rows = step.collect()
        ends = sorted({r["node_ids"][-1] for r in rows})
        found += rows
        if not rows or len(found) >= limit:
            break
        frontier = spark.createDataFrame(rows, TRAIL)
    return spark.createDataFrame(found, TRAIL)


def k_hop(
    nodes: DataFrame,
    edges: DataFrame,
    center: str,
    depth: int = SUBGRAPH_DEPTH,
    limit: int | None = SUBGRAPH_TRAILS,
    scope: str | None = None,
) -> Graph:
    """Neighbourhood of a node: the center, the ends of its trails (``is_center`` tells) and the edges used.

    ``limit`` counts trails. A center that is unknown or has no edges gives an empty graph.
    """
    scoped_nodes, scoped_edges = scope_filter(nodes, scope), scope_filter(edges, scope)
    known = scoped_nodes.where(F.col("id") == center).select("id").limit(1)
    if limit is None:
        trails = all_trails(scoped_edges, known.withColumnRenamed("id", "center"), depth)
    else:
        trails = first_trails(scoped_edges, [r["id"] for r in known.collect()], depth, limit)
    ids = trails.select(F.explode(F.array("center", F.element_at("node_ids", -1))).alias("id")).distinct()
    rids = trails.select(F.explode("rids").alias("rid")).distinct()
    return Graph(
        scoped_nodes.join(ids, "id", "left_semi").withColumn("is_center", F.col("id") == center),
        scoped_edges.join(rids, "rid", "left_semi"),
    )


class ChunkEntities(NamedTuple):
    entities: DataFrame
    paths: DataFrame


def chunk_entities(
    chunk_id: str,
    mentions: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    scope: str | None = None,
    limit: int = CHUNK_ENTITIES,
    paths: int = CHUNK_PATHS,
) -> ChunkEntities:
    """Entities that a chunk mentions (the first ``limit`` by id) and the first ``paths`` trails of up to 2 edges."""
    named = mentions.where(F.col("chunk_id") == chunk_id).select(F.col("node_id").alias("id")).distinct()
    entities = scope_filter(nodes, scope).join(named, "id", "left_semi").orderBy("id", "scope").limit(limit)
    centers = sorted({r["id"] for r in entities.select("id").collect()})
    return ChunkEntities(entities, first_trails(scope_filter(edges, scope), centers, 2, paths))


# -------------------------------------------------------------------- search


def search_nodes(
    nodes: DataFrame,
    query: str,
    scope: str | None = None,
    types: Sequence[str] | None = None,
    limit: int = SEARCH_LIMIT,
) -> DataFrame:
    """Nodes whose name or an alias contains the query, ignoring case: exact names, then prefixes, then by name."""
    needle = F.lower(F.lit(query))
    name = F.lower("name")
    hit = F.contains(name, needle) | F.exists(
        F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.contains(F.lower(a), needle)
    )
    found = scope_filter(nodes, scope).where(hit)
    if types:
        found = found.where(F.col("type").isin(*types))
    return found.orderBy(
        F.when(name == needle, 1).otherwise(2),
        F.when(F.startswith(name, needle), 1).otherwise(2),
        "name",
        "id",
    ).limit(limit)


def search_nodes_simple(nodes: DataFrame, query: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Nodes whose name contains the query, in arrival order."""
    return nodes.where(F.contains(F.lower("name"), F.lower(F.lit(query)))).orderBy("seq").limit(limit)
