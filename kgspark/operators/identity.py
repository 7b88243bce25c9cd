"""Idempotent ids: the same graph gets the same node and relation ids on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as t
from .ordering import first_wins


def assign_node_ids(nodes: DataFrame) -> DataFrame:
    """Give nodes their final id; the old one stays in ``raw_id``. ``scope`` is part of the id."""
    return (
        nodes.withColumn("raw_id", F.col("id"))
        .withColumn("name", t.normalize_name("name"))
        .withColumn("id", ids.node_id("name", "type", "scope"))
        .withColumn("aliases", t.dedupe_aliases("aliases", "name"))
    )


def assign_idempotent_ids(nodes: DataFrame, edges: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Final ids for nodes and edges of the graphs told apart by ``by``.

    Raw node ids map to final ids (the last mapping of a raw id wins); an endpoint may also name a final id. Edges are
    remapped, dangling ones dropped, and the first edge per source, target, type and scope is kept.
    """
    named = assign_node_ids(nodes)
    lookup = _id_lookup(named, by)
    remapped = edges
    for end in ("source_id", "target_id"):
        remapped = (
            remapped.join(lookup.withColumnRenamed("key", end), [*by, end])
            .drop(end)
            .withColumnRenamed("final_id", end)
        )
    kept = first_wins(remapped, [*by, "source_id", "target_id", "type", "scope"])
    return named, kept.withColumn(
        "rid", ids.relation_rid_sha("source_id", "target_id", "type", "scope", "description")
    )


def _id_lookup(named: DataFrame, by: list[str]) -> DataFrame:
    """One row per name an endpoint may use. Raw ids come before final ids; among raw ids the latest row wins."""
    raw = F.struct(F.col("raw_id").alias("key"), F.struct(F.lit(1).alias("raw"), "seq").alias("rank"))
    final = F.struct(F.col("id").alias("key"), F.struct(F.lit(0).alias("raw"), "seq").alias("rank"))
    return (
        named.select(*by, "id", F.explode(F.array(raw, final)).alias("_name"))
        .select(*by, "id", "_name.key", "_name.rank")
        .where("key IS NOT NULL")
        .groupBy(*by, "key")
        .agg(F.max_by("id", "rank").alias("final_id"))
    )
