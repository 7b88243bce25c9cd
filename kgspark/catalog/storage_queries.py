"""Round trips through the stored formats: what is written is read again and compared with the source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.status import log_level
from ..operators.graph_queries import Graph
from ..session import scratch_path
from ..sources import runs, tables
from ..streaming import run_log
from ..streaming.incremental import conformed
from .registry import Data, query
from .run_queries import _book, _qa


@query(
    """SELECT section_id, substr(md5(trim(regexp_replace(content, '\\s+', ' ', 'g'))), 1, 12) AS content_hash, '中文' AS language
       FROM sections""",
    "sections",
)
def load_sections(d: Data) -> DataFrame:
    """A1: sections stored without id, hash and language"""
    path = scratch_path(d.spark, "sections")
    d.view("sections").select("topic", "chapter", "subchapter", "content").write.parquet(path)
    return tables.load_sections(d.spark, path).select("section_id", "content_hash", "language")


def _stored(d: Data) -> str:
    path = scratch_path(d.spark, "graph")
    edges = d.view("raw_edges").withColumn("rid", F.concat(F.lit("r"), F.col("seq").cast("string")))
    graph = Graph(conformed(d.view("raw_nodes"), schemas.KG_NODES), conformed(edges, schemas.KG_EDGES))
    tables.write_graph(graph, path)
    return path


@query(
    """SELECT 'node' AS kind, seq, name AS what FROM raw_nodes WHERE scope = 'section:S3'
       UNION ALL SELECT 'edge', seq, type FROM raw_edges WHERE scope = 'section:S3'""",
    "raw_nodes raw_edges",
)
def load_graph(d: Data) -> DataFrame:
    """A2: one scope of a stored graph"""
    graph = tables.load_graph(d.spark, _stored(d), "section:S3")
    return graph.nodes.select(F.lit("node").alias("kind"), "seq", F.col("name").alias("what")).unionByName(
        graph.edges.select(F.lit("edge").alias("kind"), "seq", F.col("type").alias("what"))
    )


@query(
    """SELECT scope, count(*) AS nodes, sum(CASE WHEN scope = 'section:S3' THEN 1 ELSE 0 END)::BIGINT AS renamed
       FROM raw_nodes GROUP BY 1""",
    "raw_nodes",
)
def write_graph(d: Data) -> DataFrame:
    """A2: writing one scope again replaces that scope only"""
    path = _stored(d)
    one = tables.load_graph(d.spark, path, "section:S3")
    tables.write_graph(Graph(one.nodes.withColumn("name", F.lit("new")), one.edges), path)
    nodes = tables.load_graph(d.spark, path).nodes
    return nodes.groupBy("scope").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("name") == "new").alias("renamed")
    )


def _leveled(d: Data) -> DataFrame:
    return d.view("run_events").withColumn("level", log_level("message"))


LEVELS = """SELECT run_id, epoch_us(ts) // 1000 AS ms, message, CASE WHEN contains(message, '[info]') THEN 'info'
    WHEN contains(message, '[error]') THEN 'error' ELSE 'debug' END AS level FROM run_events"""


@query(LEVELS, "run_events")
def read_run_log(d: Data) -> DataFrame:
    """Run logs written and read in batch"""
    path = scratch_path(d.spark, "logs")
    runs.write_run_log(_leveled(d), path)
    return runs.read_run_log(d.spark, path).select("run_id", F.unix_millis("ts").alias("ms"), "message", "level")


@query(LEVELS, "run_events")
def stream_run_log(d: Data) -> DataFrame:
    """Run logs tailed as a stream and appended by a stream"""
    path = scratch_path(d.spark, "tail")
    runs.write_run_log(_leveled(d).withColumn("level", F.lit("?")), f"{path}/in")
    tailed = run_log.stream_run_log(d.spark, f"{path}/in")
    run_log.append_run_log(tailed, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return runs.read_run_log(d.spark, f"{path}/out").select(
        "run_id", F.unix_millis("ts").alias("ms"), "message", "level"
    )


def _outputs(d: Data) -> str:
    path = scratch_path(d.spark, "books")
    blocks = _book(d)
    books = blocks.select(F.col("doc_id").alias("run_id")).distinct()
    keyed = d.view("sections").select(F.col("doc_id").alias("run_id"), "section_id")
    metadata = books.select(
        "run_id",
        F.lit("succeeded").alias("status"),
        F.lit(None).cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("updated_at"),
        F.lit("textbook").alias("workflow_id"),
        F.lit(None).cast("map<string,string>").alias("workflow_params"),
        F.lit(None).cast("map<string,string>").alias("processing_stats"),
        F.lit(4).alias("chapter_count"),
        F.array(F.lit("a"), F.lit("b")).alias("section_ids"),
    )
    qa = _qa(d).join(keyed, "section_id").select("run_id", "section_id", "qa_text")
    ids = books.select("run_id", F.concat(F.lit("book:"), "run_id").alias("book_id"))
    runs.write_book_outputs(path, blocks, metadata, qa, keyed, ids)
    return path


@query(
    """SELECT source AS run_id, count(*) + count(DISTINCT lang) + 1 AS blocks, count(*) AS sections,
              count(l.doc_id) AS questions FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1"""
)
def write_book_outputs(d: Data) -> DataFrame:
    """Headings, sections and questions found again in the written books"""
    path = _outputs(d)
    text = d.spark.read.option("lineSep", "\n\n").text(f"{path}/book")
    heading = F.col("value").startswith("# ") | F.col("value").startswith("## doc-")
    blocks = text.groupBy("run_id").agg(
        F.count_if(heading).alias("blocks"), F.count_if(F.col("value").startswith("## doc-")).alias("sections")
    )
    qa = d.spark.read.json(f"{path}/qa").groupBy("run_id").agg(F.count(F.lit(1)).alias("questions"))
    return blocks.join(qa, "run_id", "left").withColumn("questions", F.coalesce("questions", F.lit(0)))


@query(
    """SELECT DISTINCT source AS run_id, unnest(['text', 'json']) AS type FROM documents"""
)
def artifact_inventory(d: Data) -> DataFrame:
    """A4, M3: file types per run folder"""
    return runs.artifact_inventory(d.spark, _outputs(d)).where("size > 0").select("run_id", "type").distinct()
