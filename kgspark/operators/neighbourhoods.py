"""Neighbourhoods of many nodes at once: trails, subgraphs, entities of chunks, scored paths of many searches.

One plan serves all centers: they stand together in a frontier table that grows by one relation at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .clean import scope_filter
from .containment import containing
from .graph_queries import (
    CHUNK_ENTITIES,
    CHUNK_PATHS,
    SEARCH_LIMIT,
    SUBGRAPH_DEPTH,
    SUBGRAPH_TRAILS,
    ChunkEntities,
    Graph,
    both_ways,
)
from .hot_keys import join_crowded
from .retrieval import CONFIDENCE_WEIGHT, LENGTH_WEIGHT, SUPPORT_WEIGHT, path_score, undirected_links

# Defaults of the retrieval guide.
GRAPH_HOPS, GRAPH_RESULTS = 2, 8

ROUNDING = 1e-8  # scores are rounded to 9 places


def first_trails_of(
    edges: DataFrame, starts: DataFrame, depth: int, limit: int, by: Sequence[str] = ("center",)
) -> DataFrame:
    """``by, center, length, rids, node_ids``: per group the first ``limit`` trails by length, center and relation ids.

    ``starts`` has the columns ``by`` and ``center``, each row once. Trails use no relation twice. What can be among the
    first decides what is looked at: of a node the relations of least id, as many as the limit and the length of a trail
    can ask for, and of a group the trails that come first until those behind them certainly fill its limit. So a group
    costs a few times its limit, however many neighbours a hub has.

    The relations of a node travel as one row, and the numbers of relations tell how many of them a group takes: trails
    of one relation become rows only after the last shuffle.
    """
    by = list(by)
    own = [*by, *(c for c in ("center",) if c not in by)]
    place = F.dense_rank().over(Window.partitionBy("here").orderBy("rid"))
    near = both_ways(edges.where("rid IS NOT NULL")).withColumn("place", place).where(F.col("place") < limit + depth)
    listed = cut_lineage(
        near.where("here IS NOT NULL").groupBy("here").agg(
            F.array_sort(F.collect_list(F.struct("rid", "there"))).alias("arcs"), F.max("place").alias("degree")
        )
    )
    chosen = _first_starts(listed, starts, limit, by, own)
    found = _as_trails(_with_relations(chosen, listed, limit), own, F.col("taken"))
    if depth == 1:
        return found
    chosen = chosen.where(F.col("total") < limit).withColumn("room", F.lit(limit) - F.col("total"))
    trails = _as_trails(_with_relations(chosen, listed, limit), own, F.col("taken"), "before", "room", "total")
    # a start with many relations leaves its group little room, so few of them are looked at again
    few = F.slice("arcs", 1, F.greatest(F.lit(limit + 1) - F.size("arcs"), F.lit(0)))
    first = _with_relations(chosen, listed.withColumn("arcs", few).where(F.size("arcs") > 0), limit)
    ahead = F.slice("taken", 1, F.greatest(F.col("room") + 1 - F.col("before"), F.lit(0)).cast("int"))
    ahead = _as_trails(first, own, ahead, "room", "total")
    for left in range(depth - 1, 0, -1):
        needed = _needed(ahead, trails, listed, by, own)
        more = F.filter("arcs", lambda arc: ~F.array_contains("rids", arc["rid"]))
        longer = (
            needed.join(listed.select("here", "arcs"), "here")
            .withColumn("arc", F.explode(F.slice(more, 1, (F.col("room") - F.col("before")).cast("int"))))
            .select(
                *own,
                (F.col("length") + 1).alias("length"),
                F.array_append("rids", F.col("arc.rid")).alias("rids"),
                F.array_append("node_ids", F.col("arc.there")).alias("node_ids"),
                "room",
            )
        )
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("center", "rids", "node_ids"))
        step = longer.withColumn("rank", rank).where((F.col("rank") <= limit) & (F.col("rank") <= F.col("room")))
        if left > 1:
            step = cut_lineage(step)
        found = found.unionByName(step.drop("rank", "room"))
        total = F.count(F.lit(1)).over(Window.partitionBy(*by))
        trails = step.withColumn("total", total).withColumn("room", F.col("room") - F.col("total")).where("room > 0")
        ahead = trails.where("rank <= room + 1").drop("rank")
    return found


def _first_starts(listed: DataFrame, starts: DataFrame, limit: int, by: list[str], own: list[str]) -> DataFrame:
    """``own, before, total, copies``: the starts with relations among the first ``limit`` of their group.

    ``before`` and ``total`` count the relations of the group: those of lesser starts, and all.
    """
    sized = starts.select(*own).join(
        listed.select(F.col("here").alias("center"), F.size("arcs").cast("long").alias("n")), "center"
    )
    group, start = Window.partitionBy(*by), Window.partitionBy(*own)
    chosen = (
        sized.withColumn("until", F.sum("n").over(group.orderBy("center")))
        .withColumn("total", F.sum("n").over(group))
        .withColumn("before", F.col("until") - F.sum("n").over(start))
        .withColumn("copies", F.count(F.lit(1)).over(start))
        .withColumn("copy", F.row_number().over(start.orderBy("center")))
        .where((F.col("copy") == 1) & (F.col("before") < limit))
    )
    return cut_lineage(chosen.select(*own, "before", "total", F.col("copies").cast("int").alias("copies")))


def _with_relations(chosen: DataFrame, listed: DataFrame, limit: int) -> DataFrame:
    """The starts with ``taken``: their relations among the first ``limit`` of their group, in order.

    The relations come as they do where trails grow longer, by ``here``, so that both read what one shuffle wrote.
    """
    repeated = F.flatten(F.transform("arcs", lambda arc: F.array_repeat(arc, F.col("copies"))))
    arcs = F.when(F.col("copies") == 1, F.col("arcs")).otherwise(repeated)
    taken = F.slice(arcs, 1, (F.lit(limit) - F.col("before")).cast("int"))
    met = chosen.withColumnRenamed("center", "here").join(listed.select("here", "arcs"), "here")
    return met.withColumn("taken", taken).withColumnRenamed("here", "center").drop("arcs", "copies")


def _as_trails(first: DataFrame, own: list[str], arcs: Column, *others: str) -> DataFrame:
    """Trails of one relation as rows."""
    return first.select(*own, *others, F.explode(arcs).alias("arc")).select(
        *own,
        F.lit(1).alias("length"),
        F.array("arc.rid").alias("rids"),
        F.array("center", "arc.there").alias("node_ids"),
        *others,
    )


def _needed(ahead: DataFrame, trails: DataFrame, listed: DataFrame, by: list[str], own: list[str]) -> DataFrame:
    """The trails whose longer ones can be among the first ``room`` of their group, with ``here`` and ``before``.

    ``before`` is how many longer trails certainly come first. ``ahead`` holds of each group one trail more than it has
    room for; all of its ``trails`` are looked at where the first of them do not fill the room.
    """
    degrees = listed.select("here", "degree")

    def placed(rows: DataFrame) -> DataFrame:
        ends = rows.withColumn("here", F.element_at("node_ids", -1)).join(degrees, "here", "left")
        certain = F.greatest(F.coalesce("degree", F.lit(0)) - F.col("length"), F.lit(0))
        until = F.sum(certain).over(Window.partitionBy(*by).orderBy("center", "rids"))
        equal = F.sum(certain).over(Window.partitionBy(*own, "rids"))
        return ends.withColumn("until", until).withColumn("before", F.col("until") - equal)

    some = cut_lineage(
        placed(ahead)
        .withColumn("short", (F.max("before").over(Window.partitionBy(*by)) < F.col("room")) & (F.col("total") > F.col("room") + 1))
        .where("before < room")
    )
    columns = [*own, "length", "rids", "node_ids", "room", "here", "before"]
    short = some.where("short").select(*by).distinct()
    if short.isEmpty():
        return some.select(*columns)
    rest = placed(trails.join(short, by, "left_semi").drop("before")).where("before < room")
    return some.where("NOT short").select(*columns).unionByName(rest.select(*columns))


def k_hop_all(
    nodes: DataFrame,
    edges: DataFrame,
    centers: DataFrame,
    depth: int = SUBGRAPH_DEPTH,
    limit: int = SUBGRAPH_TRAILS,
    scope: str | None = None,
) -> Graph:
    """``graph_queries.k_hop`` of every row of ``centers(center)``: nodes and edges with the ``center`` they belong to.

    A center that is unknown or has no relations gives nothing; one listed twice counts once.
    """
    scoped_nodes, scoped_edges = scope_filter(nodes, scope), scope_filter(edges, scope)
    known = centers.select("center").distinct().join(
        scoped_nodes.select(F.col("id").alias("center")).distinct(), "center", "left_semi"
    )
    trails = first_trails_of(scoped_edges, known, depth, limit)
    ids = trails.select("center", F.explode(F.array("center", F.element_at("node_ids", -1))).alias("id")).distinct()
    rids = trails.select("center", F.explode("rids").alias("rid")).distinct()
    return Graph(
        ids.join(scoped_nodes, "id").withColumn("is_center", F.col("id") == F.col("center")),
        rids.join(scoped_edges, "rid"),
    )


def chunk_entities_all(
    mentions: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    scope: str | None = None,
    limit: int = CHUNK_ENTITIES,
    paths: int = CHUNK_PATHS,
) -> ChunkEntities:
    """``graph_queries.chunk_entities`` of every chunk of ``mentions(chunk_id, node_id)``, with its ``chunk_id``."""
    pairs = mentions.select("chunk_id", F.col("node_id").alias("id")).where("chunk_id IS NOT NULL").distinct()
    nodes = scope_filter(nodes, scope)
    rank = F.row_number().over(Window.partitionBy("chunk_id").orderBy("id", "scope"))
    same = Window.partitionBy("chunk_id", "id", "scope").orderBy("_rank")
    # the choice needs keys alone; what else a node holds is read for the nodes that were chosen
    named = pairs.join(nodes.select("id", "scope"), "id")
    kept = named.withColumn("_rank", rank).where(F.col("_rank") <= limit).withColumn("_copy", F.row_number().over(same))
    kept = cut_lineage(kept.withColumn("_first", F.row_number().over(Window.partitionBy("chunk_id", "id").orderBy("_rank")) == 1).drop("_rank"))
    numbered = nodes.withColumn("_copy", F.row_number().over(Window.partitionBy("id", "scope").orderBy("id")))
    chosen = kept.select(F.col("chunk_id").alias("_chunk"), F.col("id").alias("_id"), F.col("scope").alias("_scope"), F.col("_copy").alias("_nth"))
    entities = numbered.join(
        chosen,
        (F.col("id") == F.col("_id")) & F.equal_null("scope", "_scope") & (F.col("_copy") == F.col("_nth")),
    ).select("id", F.col("_chunk").alias("chunk_id"), *(c for c in nodes.columns if c != "id"))
    starts = kept.where("_first").select("chunk_id", F.col("id").alias("center"))
    return ChunkEntities(entities, first_trails_of(scope_filter(edges, scope), starts, 2, paths, ["chunk_id"]))


# ------------------------------------------------------- searches on the graph


def search_nodes_all(nodes: DataFrame, queries: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    """``query_id, id, rank``: ``graph_queries.search_nodes`` for every row of ``queries(query_id, query)``.

    Names and aliases meet the queries on a query's rarest characters. An empty query finds nothing here; an id that
    several nodes bear is found once, by its least name.
    """
    asked = queries.select("query_id", F.lower("query").alias("name")).where("name <> ''")
    texts = nodes.select(
        "id",
        F.lower("name").alias("own"),
        "name",
        F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("text"),
    ).select("id", "name", "own", F.lower("text").alias("text"))
    met = containing(texts.select("text").where("text IS NOT NULL"), asked.select("name"))
    hits = texts.distinct().join(met.withColumnRenamed("name", "needle"), "text")
    order = [
        F.when(F.col("own") == F.col("needle"), 1).otherwise(2),
        F.when(F.startswith("own", F.col("needle")), 1).otherwise(2),
        F.col("name"),
        F.col("id"),
    ]
    places = F.min(F.struct(order[0].alias("exact"), order[1].alias("prefix"), "name")).alias("place")
    ids = hits.groupBy("needle", "id").agg(places)
    rank = F.row_number().over(Window.partitionBy("needle").orderBy("place", "id"))
    first = ids.withColumn("rank", rank).where(F.col("rank") <= limit)
    return join_crowded(asked.withColumnRenamed("name", "needle"), first, ["needle"]).select("query_id", "id", "rank")


def _reach(length: Column, confidence: Column, support: Column, hops: int, bounds: dict[str, Column]) -> Column:
    """The best score that a path can have after one to ``hops`` more relations."""
    steps = []
    for j in range(1, hops + 1):
        more = [bounds["confidence"], *[bounds["any_confidence"]] * (j - 1)]
        seen = [bounds["support"], *[bounds["any_support"]] * (j - 1)]
        total = sum(more, confidence) / (length + j)
        steps.append(LENGTH_WEIGHT / (length + j) + CONFIDENCE_WEIGHT * total + SUPPORT_WEIGHT * F.log1p(sum(seen, support)))
    return F.greatest(*steps) if len(steps) > 1 else steps[0]


def kg_topk(
    nodes: DataFrame,
    edges: DataFrame,
    mentions: DataFrame,
    queries: DataFrame,
    hops: int = GRAPH_HOPS,
    k: int = GRAPH_RESULTS,
    seeds: int = SEARCH_LIMIT,
) -> DataFrame:
    """``query_id, rank, node_id, score, seed, length, path``: the ``k`` best nodes near what each query finds.

    Of ``queries(query_id, query)`` each finds its first ``seeds`` nodes by name or alias. Paths of up to ``hops``
    relations lead on from there, in either direction and past no node twice; a path scores by its length, the mean
    confidence of its relations (the surest one between two nodes) and the mentions of its nodes, see ``path_score``. A
    node counts with its best path, ties to the least path; nodes rank by score, to nine places, ties to the smaller id.

    Once ``k`` nodes of a query are known, the score of the last of them is a bound: a path whose score can no longer
    reach it, whatever follows, is not extended. The result is that of all paths.
    """
    links = undirected_links(edges)
    counts = mentions.groupBy(F.col("node_id").alias("there")).agg(F.count_distinct("chunk_id").alias("support"))
    arcs = links.join(counts, "there", "left").fillna(0, ["support"])
    arcs = cut_lineage(arcs.select("here", "there", F.col("confidence").alias("more_confidence"), F.col("support").alias("more_support")))
    most = arcs.agg(F.max("more_confidence"), F.max("more_support")).first()
    best = arcs.groupBy("here").agg(F.max("more_confidence").alias("best_confidence"), F.max("more_support").alias("best_support"))
    found = search_nodes_all(nodes, queries, seeds).select("query_id", F.col("id").alias("there"))
    paths = found.join(counts, "there", "left").select(
        "query_id",
        F.array("there").alias("path"),
        F.lit(0).alias("length"),
        F.lit(0.0).alias("confidence"),
        F.coalesce("support", F.lit(0)).alias("support"),
        F.lit(None).cast("double").alias("bound"),
    )
    bounds = {
        "confidence": F.col("best_confidence"), "support": F.col("best_support"),
        "any_confidence": F.lit(float(most[0] or 0.0)), "any_support": F.lit(most[1] or 0),
    }
    kept = None
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    for hop in range(hops):
        left = hops - hop
        ends = paths.withColumn("here", F.element_at("path", -1)).join(best, "here")
        reach = _reach(F.col("length"), F.col("confidence"), F.col("support"), left, bounds)
        open_ends = ends.where(F.col("bound").isNull() | (reach >= F.col("bound") - ROUNDING))
        step = (
            open_ends.join(arcs, "here")
            .where(~F.array_contains("path", F.col("there")))
            .select(
                "query_id",
                F.array_append("path", F.col("there")).alias("path"),
                (F.col("length") + 1).alias("length"),
                (F.col("confidence") + F.col("more_confidence")).alias("confidence"),
                (F.col("support") + F.col("more_support")).alias("support"),
                "bound",
            )
        )
        scored = step.withColumn("score", F.round(path_score(F.col("length"), F.col("confidence") / F.col("length"), F.col("support")), 9))
        if left > 1:
            scored = cut_lineage(scored)
        choice = F.struct((-F.col("score")).alias("loss"), "path")
        per_node = (
            scored.where(F.col("bound").isNull() | (F.col("score") >= F.col("bound")))
            .groupBy("query_id", F.element_at("path", -1).alias("node_id"))
            .agg(F.min(choice).alias("best"))
            .select("query_id", "node_id", (-F.col("best.loss")).alias("score"), "best.path")
        )
        if kept is not None:
            both = kept.unionByName(per_node).groupBy("query_id", "node_id").agg(F.min(choice).alias("best"))
            per_node = both.select("query_id", "node_id", (-F.col("best.loss")).alias("score"), "best.path")
        kept = per_node.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if left > 1:
            kept = cut_lineage(kept)
            last = kept.where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
            paths = scored.drop("bound", "score").join(last, "query_id", "left")
            kept = kept.drop("rank")
    return kept.select(
        "query_id", "rank", "node_id", "score", F.col("path")[0].alias("seed"), (F.size("path") - 1).alias("length"), "path"
    )
