"""Section and graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import ids
from ..operators.clean import scope_filter
from ..operators.graph_queries import Graph

GRAPH_PARTITION = "scope"


def load_sections(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Sections with language, section id and content hash filled in where they are missing."""
    raw = spark.read.schema(schemas.SECTIONS).format(fmt).load(path)
    return raw.withColumns(
        {
            "language": F.coalesce("language", F.lit(schemas.DEFAULT_CONTENT_LANGUAGE)),
            "section_id": F.coalesce("section_id", ids.section_id("topic", "chapter", "subchapter")),
            "content_hash": F.coalesce("content_hash", ids.content_hash("content")),
        }
    )


def load_graph(spark: SparkSession, path: str, scope: str | None = None) -> Graph:
    """Stored nodes and edges. The tables are partitioned by scope, so one scope reads only its own files."""
    nodes = spark.read.schema(schemas.KG_NODES).parquet(f"{path}/nodes")
    edges = spark.read.schema(schemas.KG_EDGES).parquet(f"{path}/edges")
    return Graph(scope_filter(nodes, scope), scope_filter(edges, scope))


def write_graph(graph: Graph, path: str) -> None:
    """Write nodes and edges; the scopes present in the data are replaced, all others stay.

    The rebalance hint gives every scope few files and lets adaptive execution split a huge one over many tasks; rows
    are sorted by the id that lookups ask for, so file statistics prune.
    """
    for name, df, lookup in (("nodes", graph.nodes, "id"), ("edges", graph.edges, "source_id")):
        (
            df.hint("rebalance", GRAPH_PARTITION)
            .sortWithinPartitions(GRAPH_PARTITION, lookup)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(GRAPH_PARTITION)
            .parquet(f"{path}/{name}")
        )
