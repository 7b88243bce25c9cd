"""Micro-batches of section outputs into an append-only graph store.

Every batch writes its own ``batch=<id>`` partition of ``rejects``, ``nodes``, ``edges`` and, last, ``sections``. The
newest batch of a section holds its graph; readers ignore older ones, and ``compact`` copies a store without them. So a
batch writes its own rows only (it reads the hashes of the stored sections), a repeated batch overwrites itself, and a
half-written batch is not visible.

A malformed output changes nothing in the graph: its section keeps the nodes and edges it has, and the output is listed in
``rejects`` with its reason.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions import ids
from ..operators import extract
from ..operators.clean import drop_dangling
from ..operators.graph_queries import Graph
from ..operators.merge import Book, merge_book
from ..operators.ordering import last_wins
from ..operators.store import EDGE_KEY, NODE_KEY, stamp_section_scope
from ..plans.graph_build import build_section_graphs
from ..session import cut_lineage

SECTION_VERSIONS = "section_id STRING, content_hash STRING, chapter STRING, batch BIGINT"
REJECTS = "seq BIGINT, section_id STRING, reason STRING"


def changed_outputs(outputs: DataFrame, stored: DataFrame) -> DataFrame:
    """The latest output per section, if its section is new or its text differs (whitespace apart) from the stored one."""
    hashed = outputs.withColumn("section_id", ids.section_id("topic", "chapter", "subchapter")).withColumn(
        "content_hash", ids.content_hash("raw")
    )
    current = stored.groupBy("section_id").agg(F.max_by("content_hash", "batch").alias("content_hash"))
    return last_wins(hashed, ["section_id"]).join(current, ["section_id", "content_hash"], "left_anti")


def _read(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The table at ``path``; empty before the first batch."""
    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl)


def conformed(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` with exactly the stored columns."""
    stored = df.sparkSession.createDataFrame([], ddl).schema
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in stored.fields
        ]
    )


def _write(df: DataFrame, path: str, batch_id: int) -> None:
    (
        df.withColumn("batch", F.lit(batch_id).cast("long"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch")
        .parquet(path)
    )


def store_batch(spark: SparkSession, outputs: DataFrame, path: str, now: Column, batch_id: int) -> None:
    """Add the section graphs of a batch of outputs to the store.

    The last well-formed output of a section counts; unchanged sections are skipped, malformed outputs are rejected.
    """
    keyed = outputs.withColumn("section_id", ids.section_id("topic", "chapter", "subchapter"))
    _write(conformed(extract.malformed_outputs(keyed), REJECTS), f"{path}/rejects", batch_id)
    usable = outputs.where(extract.output_fault().isNull())
    stored = _read(spark, f"{path}/sections", SECTION_VERSIONS).where(F.col("batch") < batch_id)
    fresh = cut_lineage(changed_outputs(usable, stored))
    graphs = build_section_graphs(fresh.drop("section_id", "content_hash"), now)

    def scalar_seq(df: DataFrame) -> DataFrame:
        return df.withColumn("seq", F.col("seq.seq"))

    # The last line wins, so rows are chosen while they still carry output and line.
    node_rows = last_wins(graphs.nodes.withColumn("scope", ids.section_scope("section_id")), NODE_KEY)
    edge_rows = last_wins(drop_dangling(stamp_section_scope(graphs.edges), node_rows, ["scope"]), EDGE_KEY)
    _write(conformed(scalar_seq(node_rows), schemas.KG_NODES), f"{path}/nodes", batch_id)
    _write(conformed(scalar_seq(edge_rows), schemas.KG_EDGES), f"{path}/edges", batch_id)
    _write(fresh.select("section_id", "content_hash", "chapter"), f"{path}/sections", batch_id)


def _current_sections(spark: SparkSession, path: str) -> DataFrame:
    return (
        _read(spark, f"{path}/sections", SECTION_VERSIONS)
        .groupBy("section_id")
        .agg(F.max("batch").alias("batch"), F.max_by("chapter", "batch").alias("chapter"))
    )


def current_graph(spark: SparkSession, path: str) -> Graph:
    """The graph of the newest version of every section."""
    versions = _current_sections(spark, path).select(ids.section_scope("section_id").alias("scope"), "batch")

    def newest(name: str, ddl: str) -> DataFrame:
        rows = _read(spark, f"{path}/{name}", ddl + ", batch BIGINT")
        return rows.join(versions, ["scope", "batch"], "left_semi").drop("batch")

    return Graph(newest("nodes", schemas.KG_NODES), newest("edges", schemas.KG_EDGES))


def current_book(spark: SparkSession, path: str, book_id: str, topic: str) -> Book:
    """The book graph merged from the newest version of every section."""
    graph = current_graph(spark, path)
    return merge_book(graph.nodes, graph.edges, _current_sections(spark, path), book_id, topic)


def rejected_outputs(spark: SparkSession, path: str) -> DataFrame:
    """Every output that was rejected: ``seq, section_id, reason, batch``."""
    return _read(spark, f"{path}/rejects", REJECTS + ", batch BIGINT")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Copy the store to ``target`` with the newest version of every section only.

    Rows keep their batch, so a stream goes on from ``target`` under the same checkpoint. Run it between batches.
    """
    versions = _read(spark, f"{path}/sections", SECTION_VERSIONS)
    newest = versions.groupBy("section_id").agg(F.max("batch").alias("batch"))
    scoped = newest.select(ids.section_scope("section_id").alias("scope"), "batch")
    kept = {
        "rejects": rejected_outputs(spark, path),
        "nodes": _read(spark, f"{path}/nodes", schemas.KG_NODES + ", batch BIGINT").join(scoped, ["scope", "batch"], "left_semi"),
        "edges": _read(spark, f"{path}/edges", schemas.KG_EDGES + ", batch BIGINT").join(scoped, ["scope", "batch"], "left_semi"),
        "sections": versions.join(newest, ["section_id", "batch"], "left_semi"),
    }
    for name, rows in kept.items():
        # files follow the size of a batch: a large one, such as the first load, is split over tasks
        rows.hint("rebalance", "batch").write.partitionBy("batch").parquet(f"{target}/{name}")


POINTER = "path STRING, version BIGINT"


def current_path(spark: SparkSession, root: str) -> str:
    """Where the store below ``root`` lies now: the path published last, ``root`` itself before that."""
    rows = _read_pointer(spark, root)
    newest = rows.agg(F.max_by("path", "version")).first()[0]
    return root if newest is None else newest


def _read_pointer(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(POINTER).json(f"{root}/_current")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], POINTER)


def publish(spark: SparkSession, root: str, target: str) -> None:
    """Makes ``target`` the store that ``current_path`` names.

    The pointer is one file of its own version and is moved into place whole, so readers take the old store or the new
    one; of two that publish at a time one fails.
    """
    version = (_read_pointer(spark, root).agg(F.max("version")).first()[0] or 0) + 1
    row = spark.createDataFrame([(target,)], "path STRING").coalesce(1)
    row.write.mode("errorifexists").json(f"{root}/_current/version={version}")


def compact_store(spark: SparkSession, root: str, target: str) -> None:
    """Compacts the store below ``root`` into ``target`` and publishes it."""
    compact(spark, current_path(spark, root), target)
    publish(spark, root, target)


def incremental_graph(outputs: DataFrame, path: str, checkpoint: str, now: Column, **trigger) -> StreamingQuery:
    """Keep the store at ``path`` up to date with a stream of section outputs (one checkpoint per store)."""

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        store_batch(batch.sparkSession, batch, path, now, batch_id)

    return (
        outputs.writeStream.foreachBatch(each_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
