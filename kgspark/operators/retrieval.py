"""Retrieval over documents and graph: chunks, filters, paths, fused ranks, measures, index plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hot_keys import join_crowded

# Defaults of the retrieval guide.
CHUNK_SIZE, CHUNK_OVERLAP = 800, 120
ALPHA, BETA, FUSED_RESULTS = 0.7, 0.3, 4
LENGTH_WEIGHT, CONFIDENCE_WEIGHT, SUPPORT_WEIGHT = 0.6, 0.3, 0.1


def chunk_documents(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Windows of ``size`` characters that share ``overlap`` with the next: ``doc_id, chunk_no, chunk_id, text``.

    No chunk lies wholly inside the overlap of the one before. A null text has no chunk, an empty one has one.
    """
    step = size - overlap
    last = F.floor((F.greatest(F.length("text") - overlap, F.lit(1)) - 1) / step).cast("int")
    numbered = docs.where("text IS NOT NULL").select(
        "doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no")
    )
    return numbered.select(
        "doc_id",
        "chunk_no",
        F.concat_ws("#", "doc_id", "chunk_no").alias("chunk_id"),
        F.substr("text", F.col("chunk_no") * step + 1, F.lit(size)).alias("text"),
    )


def path_score(length: Column, confidence: Column, support: Column) -> Column:
    """Shorter, surer and better supported paths score higher."""
    return LENGTH_WEIGHT / length + CONFIDENCE_WEIGHT * confidence + SUPPORT_WEIGHT * F.log1p(support)


def undirected_links(edges: DataFrame) -> DataFrame:
    """``here, there, confidence``: both directions of every relation, the surest between two nodes; no loops.

    Relations of two nodes meet once, whichever way they point; only the surest is turned round.
    """
    pairs = (
        edges.where("source_id <> target_id")
        .groupBy(F.least("source_id", "target_id").alias("low"), F.greatest("source_id", "target_id").alias("high"))
        .agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))
    )
    both = F.array(
        F.struct(F.col("low").alias("here"), F.col("high").alias("there")),
        F.struct(F.col("high").alias("here"), F.col("low").alias("there")),
    )
    return pairs.select(F.explode(both).alias("arc"), "confidence").select("arc.here", "arc.there", "confidence")


def explain_paths(edges: DataFrame, pairs: DataFrame, directed: bool = True) -> DataFrame:
    """The shortest path of at most two relations between ``a`` and ``b`` for each distinct row of ``pairs``.

    Returns ``a, b, length, via, confidence``; of equally short paths the surest counts, then the least ``via``. With
    ``directed`` both relations point from ``a`` to ``b``, else their direction makes no difference.

    A pair is met from its end with fewer relations: these are followed, and looked up among those of the other end. So
    it costs as much as the smaller end has relations, and a pair of a hub and a leaf as much as the leaf.
    """
    if directed:
        links = edges.where("source_id <> target_id").groupBy(
            F.col("source_id").alias("here"), F.col("target_id").alias("there")
        ).agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))
    else:
        links = undirected_links(edges)
    asked = pairs.select("a", "b").where("a <> b").distinct()
    leaving = links.groupBy(F.col("here").alias("a")).agg(F.count(F.lit(1)).alias("_from_a"))
    entering = links.groupBy(F.col("there").alias("b")).agg(F.count(F.lit(1)).alias("_to_b"))
    sized = join_crowded(join_crowded(asked, leaving, ["a"]), entering, ["b"])
    first = links.select(F.col("here").alias("a"), F.col("there").alias("via"), F.col("confidence").alias("_first"))
    last = links.select(F.col("here").alias("via"), F.col("there").alias("b"), F.col("confidence").alias("_second"))
    middle = ((F.col("_first") + F.col("_second")) / 2).alias("confidence")

    def met(ends: DataFrame) -> DataFrame:
        return ends.where("via <> a AND via <> b").select("a", "b", F.lit(2).alias("length"), "via", middle)

    forward = sized.where("_from_a <= _to_b").select("a", "b")
    backward = sized.where("_from_a > _to_b").select("a", "b")
    if directed:
        through = met(forward.join(first, "a").join(last, ["via", "b"])).unionByName(
            met(backward.join(last, "b").join(first, ["a", "via"]))
        )
    else:  # links are the same from either end: turned pairs go the way of the others
        turned = forward.withColumn("_turned", F.lit(False)).unionByName(
            backward.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("_turned"))
        )
        found = turned.join(first, "a").where("via <> a AND via <> b").join(last, ["via", "b"])
        start, end = F.when(F.col("_turned"), F.col("b")).otherwise(F.col("a")), F.when(F.col("_turned"), F.col("a")).otherwise(F.col("b"))
        through = found.select(start.alias("a"), end.alias("b"), F.lit(2).alias("length"), "via", middle)
    direct = asked.join(links.select(F.col("here").alias("a"), F.col("there").alias("b"), "confidence"), ["a", "b"])
    paths = direct.select("a", "b", F.lit(1).alias("length"), F.lit(None).cast("string").alias("via"), "confidence")
    best = F.min(F.struct("length", (-F.col("confidence")).alias("_doubt"), "via", "confidence")).alias("_best")
    return paths.unionByName(through).groupBy("a", "b").agg(best).select("a", "b", "_best.length", "_best.via", "_best.confidence")


def minmax(scores: DataFrame, by: str = "query_id", score: str = "score") -> DataFrame:
    """Scores scaled to 0..1 within a query; 0 where all are equal. The bounds are partial-aggregated, then joined."""
    bounds = scores.groupBy(by).agg(F.min(score).alias("_least"), F.max(score).alias("_most"))
    width = F.col("_most") - F.col("_least")
    scaled = F.when(width > 0, (F.col(score) - F.col("_least")) / width).otherwise(F.lit(0.0))
    return scores.join(bounds, by).withColumn(score, scaled).drop("_least", "_most")


def fuse(
    vector: DataFrame, graph: DataFrame, alpha: float = ALPHA, beta: float = BETA, k: int | None = FUSED_RESULTS
) -> DataFrame:
    """Weighted sum of both channels: ``query_id, item_id, score, rank``.

    Both inputs have ``query_id, item_id, score``, one row an item; vector scores are scaled first. An item missing in a
    channel has 0 there. Ties go to the smaller item; ``k=None`` ranks them all.
    """
    left = minmax(vector.select("query_id", "item_id", "score")).withColumnRenamed("score", "_vector")
    right = graph.select("query_id", "item_id", F.col("score").alias("_graph"))
    score = alpha * F.coalesce("_vector", F.lit(0.0)) + beta * F.coalesce("_graph", F.lit(0.0))
    fused = left.join(right, ["query_id", "item_id"], "full").select("query_id", "item_id", score.alias("score"))
    ranked = fused.withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    )
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def payload_filter(
    chunks: DataFrame, must: Sequence[Column] = (), should: Sequence[Column] = (), must_not: Sequence[Column] = ()
) -> DataFrame:
    """Chunks that meet all of ``must``, any of ``should`` (if there are any) and none of ``must_not``; unknown is false."""

    def holds(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    kept = F.lit(True)
    for c in must:
        kept = kept & holds(c)
    for c in must_not:
        kept = kept & ~holds(c)
    if should:
        some = F.lit(False)
        for c in should:
            some = some | holds(c)
        kept = kept & some
    return chunks.where(kept)


def retrieval_metrics(results: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of queries whose first result, or any result, is in ``gold``, and the mean of gold results.

    ``results``: query_id, rank (from 1), item_id. ``gold``: query_id, item_id. Queries are those of ``gold``.
    """
    right = gold.select("query_id", "item_id").distinct()
    found = results.select("query_id", "rank", "item_id").join(right, ["query_id", "item_id"])
    per_query = found.groupBy("query_id").agg(
        F.min("rank").alias("_first"), F.count_distinct("item_id").alias("_evidence")
    )
    asked = right.select("query_id").distinct().join(per_query, "query_id", "left")
    return asked.agg(
        F.count(F.lit(1)).alias("queries"),
        (F.count_if(F.col("_first") == 1) / F.count(F.lit(1))).alias("hit_at_1"),
        (F.count("_first") / F.count(F.lit(1))).alias("hit_rate"),
        F.avg(F.coalesce("_evidence", F.lit(0))).alias("mean_evidence"),
    )


def reindex_plan(docs: DataFrame, index: DataFrame) -> DataFrame:
    """What an index update has to do: ``doc_id, action`` (new, changed or deleted); unchanged documents are left out.

    Both inputs have ``doc_id, content_hash``; one outer join tells all three.
    """
    wanted = docs.select("doc_id", F.col("content_hash").alias("_wanted"), F.lit(True).alias("_given"))
    stored = index.select("doc_id", F.col("content_hash").alias("_stored"), F.lit(True).alias("_indexed"))
    action = (
        F.when(F.col("_indexed").isNull(), "new")
        .when(F.col("_given").isNull(), "deleted")
        .when(~F.equal_null("_wanted", "_stored"), "changed")
    )
    return wanted.join(stored, "doc_id", "full").select("doc_id", action.alias("action")).where("action IS NOT NULL")


def evidence_sufficiency(claims: DataFrame, hits: DataFrame, n: int) -> DataFrame:
    """Every claim with its number of distinct hits and whether they are at least ``n``."""
    counts = hits.groupBy("claim_id").agg(F.count_distinct("hit_id").alias("_hits"))
    found = F.coalesce("_hits", F.lit(0).cast("long"))
    return claims.join(counts, "claim_id", "left").withColumns({"hits": found, "sufficient": found >= n}).drop("_hits")
