"""Connected components of an undirected graph by alternating large-star and small-star rounds.

Published scheme: Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014). Edges are kept as
(big, small) pairs; every round replaces them by shorter ones until each vertex points at the least id it can reach.
A hub is never gathered: each round is a partial-aggregated minimum per vertex plus an equi join, whose hot side
adaptive execution may split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def connected_components(
    nodes: DataFrame,
    edges: DataFrame,
    by: Sequence[str] = ("scope",),
    source: str = "source_id",
    target: str = "target_id",
) -> DataFrame:
    """Columns ``by``, ``id``, ``component`` (least id of the component); edges with an unknown endpoint are ignored."""
    by = list(by)
    vertices = nodes.select(*by, "id").distinct()
    pairs = _known_pairs(vertices, edges.select(*by, F.col(source).alias("u"), F.col(target).alias("v")), by)
    stars = _contract(pairs, by)
    return vertices.join(
        stars.withColumnRenamed("big", "id").withColumnRenamed("small", "component"), [*by, "id"], "left"
    ).withColumn("component", F.coalesce("component", "id"))


def pair_components(pairs: DataFrame, source: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Columns ``by``, ``id``, ``component`` of every vertex that the pairs name; no list of vertices is asked for."""
    by = list(by)
    ends = pairs.select(*by, F.col(source).alias("u"), F.col(target).alias("v")).where("u <> v")
    stars = _contract(ends.select(*by, F.greatest("u", "v").alias("big"), F.least("u", "v").alias("small")).distinct(), by)
    roots = stars.select(*by, F.col("small").alias("id"), F.col("small").alias("component")).distinct()
    return stars.select(*by, F.col("big").alias("id"), F.col("small").alias("component")).unionByName(roots)


def _known_pairs(vertices: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    pairs = (
        edges.where("u <> v")
        .select(*by, F.greatest("u", "v").alias("big"), F.least("u", "v").alias("small"))
        .distinct()
    )
    return pairs.join(vertices.withColumnRenamed("id", "big"), [*by, "big"], "left_semi").join(
        vertices.withColumnRenamed("id", "small"), [*by, "small"], "left_semi"
    )


def _contract(pairs: DataFrame, by: list[str]) -> DataFrame:
    pairs = cut_lineage(pairs.select(*by, "big", "small"))
    state = _fingerprint(pairs, by)
    while True:
        pairs = cut_lineage(_small_star(_large_star(pairs, by), by))
        new_state = _fingerprint(pairs, by)
        if new_state == state:
            return pairs
        state = new_state


def _least_neighbour(pairs: DataFrame, by: list[str], key: str) -> DataFrame:
    return pairs.groupBy(*by, F.col("big").alias(key)).agg(F.min("small").alias("least"))


def _large_star(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Every vertex hands its larger neighbours on to the least vertex it knows."""
    least = _least_neighbour(pairs, by, "small")
    return pairs.join(least, [*by, "small"], "left").select(*by, "big", F.coalesce("least", "small").alias("small"))


def _small_star(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Every vertex and its smaller neighbours are linked to the least of them."""
    least = _least_neighbour(pairs, by, "big")
    neighbours = (
        pairs.join(least, [*by, "big"])
        .where("small <> least")
        .select(*by, F.col("small").alias("big"), F.col("least").alias("small"))
    )
    own = least.select(*by, "big", F.col("least").alias("small"))
    return neighbours.unionByName(own).distinct()


def _fingerprint(pairs: DataFrame, by: list[str]) -> tuple:
    """Row count and order-free hash of the pairs: the convergence test, one row to the driver."""
    row = pairs.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*by, "big", "small")).alias("digest")
    ).first()
    return row["n"], row["digest"]
