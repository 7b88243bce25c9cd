"""Stored tables in buckets, evidence and hierarchies as rows, sketches, streams that hold rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators import extract, merge, ordering, store, stored_graph, telemetry
from ..session import scratch_path
from ..streaming import stateful
from ..streaming.incremental import conformed
from .graph_queries import LAST_ARRIVED, STORED_EDGES, _display_edges, micros, now
from .registry import Data, query, rounded
from .run_queries import _event_stream, _messages, _written

PAST = "2020-01-01 00:00:00"


SLICES = 16  # tasks that share a bucket


def _stored_nodes(d: Data) -> stored_graph.StoredGraph:
    """Nodes of the parts in 16 buckets; no edges."""
    stored = stored_graph.open_graph(d.spark, scratch_path(d.spark, "buckets"), 16)
    past = F.lit(PAST).cast("timestamp")
    nodes = d.view("raw_nodes").withColumns({"created_at": past, "updated_at": past})
    stored.nodes.write(conformed(nodes, schemas.KG_NODES))
    return stored


def _stored(d: Data) -> stored_graph.StoredGraph:
    """Nodes and edges of the parts in 16 buckets. The edges of a key meet in a slice of their bucket and are written there."""
    stored = _stored_nodes(d)
    stamped = store.stamp_section_scope(d.view("raw_edges"))
    place = {"_bucket": stored.edges.bucket(), "_slice": F.pmod(F.xxhash64("rid"), F.lit(SLICES))}
    dealt = stamped.withColumns(place).repartition(*place)
    edges = ordering.last_wins(dealt, [*place, *store.EDGE_KEY]).withColumn("updated_at", F.col("created_at"))
    stored.edges.write(conformed(edges, schemas.KG_EDGES), placed=True)
    return stored


@query(
    """WITH arriving AS (SELECT coalesce(n.type, 'New') AS type, i.* EXCLUDE (scope), 'section:moved' AS scope
                         FROM incoming_nodes i LEFT JOIN raw_nodes n USING (id)),
        latest AS (SELECT * FROM arriving QUALIFY row_number() OVER (PARTITION BY type, id ORDER BY seq DESC) = 1),
        firsts AS (SELECT type, id, arg_min(created_at, seq) AS created_at FROM arriving GROUP BY 1, 2)
        SELECT type, id, CASE WHEN l.id IS NULL THEN s.scope ELSE l.scope END AS scope,
               CASE WHEN l.id IS NULL THEN s.name ELSE l.name END AS name,
               epoch_us(CASE WHEN s.id IS NULL THEN f.created_at ELSE TIMESTAMP '2020-01-01' END) AS created_us
        FROM raw_nodes s FULL JOIN latest l USING (type, id) LEFT JOIN firsts f USING (type, id)""",
    "raw_nodes incoming_nodes",
)
def merge_stored_nodes(d: Data) -> DataFrame:
    """B1 by type and id, the scope being set, in the buckets of the batch"""
    stored = _stored_nodes(d)
    types = d.view("raw_nodes").select("id", "type")
    arriving = d.view("incoming_nodes").join(types, "id", "left").withColumn("type", F.coalesce("type", F.lit("New")))
    stored_graph.upsert_nodes(stored, arriving.withColumn("scope", F.lit("section:moved")))
    return stored.nodes.read().select("type", "id", "scope", "name", micros("created_at"))


@query(
    f"""WITH {STORED_EDGES}, {LAST_ARRIVED}
        SELECT scope, rid, type, source_id, target_id FROM latest UNION ALL
        SELECT scope, rid, type, source_id, target_id FROM stored WHERE scope NOT IN (SELECT scope FROM arrived)""",
    "raw_nodes raw_edges incoming_edges",
)
def replace_stored_sections(d: Data) -> DataFrame:
    """Relations after five sections were replaced in their buckets"""
    stored = _stored(d)
    arrived = d.view("incoming_edges").withColumn("updated_at", F.col("created_at"))
    nodes = d.view("raw_nodes").withColumn("src_section", F.col("subchapter"))
    sections = arrived.select("src_section").distinct()
    stored_graph.replace_sections(stored, nodes.join(sections, "src_section", "left_semi"), arrived, now())
    return stored.edges.read().select("scope", "rid", "type", "source_id", "target_id")


@query(f"WITH {STORED_EDGES} SELECT scope, rid, type, seq FROM stored WHERE scope = 'section:S3'", "raw_edges")
def load_scope_edges(d: Data) -> DataFrame:
    """A2: one scope of a store whose folders do not grow with the scopes"""
    return stored_graph.scope_edges(_stored(d), "section:S3").select("scope", "rid", "type", "seq")


@query(
    """WITH t AS (SELECT source_id || '->' || target_id || ':' || type ||
                         CASE WHEN length(evidence) > 20 THEN ':' || substr(md5(evidence), 1, 8) ELSE '' END AS edge_key,
                         evidence AS text, min(seq) AS seen FROM raw_edges WHERE evidence <> '' GROUP BY 1, 2)
       SELECT * FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.edge_key = a.edge_key AND b.text <> a.text
                                           AND contains(b.text, a.text) AND b.seen < a.seen)""",
    "raw_edges",
)
def folded_evidence(d: Data) -> DataFrame:
    """H8: the evidence that is shown, as rows"""
    return merge.folded_evidence(_display_edges(d))


@query(
    """SELECT p_partkey AS seq, 1 AS line, 1 AS level, p_brand AS title, NULL AS parent FROM part
       UNION ALL SELECT p_partkey, 2, 2, p_name, 1 FROM part"""
)
def extract_levels(d: Data) -> DataFrame:
    """Levels of the hierarchy"""
    return extract.extract_levels(d.view("outputs")).select("seq", "line", "level", "title", "parent")


@query("SELECT agent, count(*) AS calls, true AS p50, true AS p95, true AS p99 FROM call_events GROUP BY 1", "call_events")
def latency_percentiles(d: Data) -> DataFrame:
    """Whether the ranks of the estimates, merged over days, are off by 2 % of the calls at most"""
    calls = d.view("call_events")
    found = telemetry.latency_percentiles(telemetry.latency_sketches(calls), ["agent"])
    below = calls.join(found, "agent").groupBy("agent").agg(
        F.max("calls").alias("calls"),
        *(F.avg((F.col("latency_ms") < F.col(p)).cast("int")).alias(f"{p}_lt") for p in ("p50", "p95", "p99")),
        *(F.avg((F.col("latency_ms") <= F.col(p)).cast("int")).alias(f"{p}_le") for p in ("p50", "p95", "p99")),
    )
    near = ((F.col(f"{p}_lt") <= q + 0.02) & (F.col(f"{p}_le") >= q - 0.02) for p, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))
    return below.select("agent", "calls", *(n.alias(p) for n, p in zip(near, ("p50", "p95", "p99"))))


STAGES_HELD = """marks AS (SELECT run_id, seq, ts, contains(message, 'stage_start') AS is_start,
                     regexp_extract(message, '"stage": "([^"]*)"', 1) AS stage
              FROM run_events WHERE contains(message, 'stage_')),
    linked AS (SELECT *, lead(ts) OVER (PARTITION BY run_id ORDER BY ts, seq) AS ended FROM marks),
    mark AS (SELECT epoch_ms(max(ts)) - 3600000 AS ms FROM marks)"""


@query(
    f"""WITH {STAGES_HELD} SELECT run_id, stage, epoch_us(ts) AS started_us, epoch_us(ended) AS ended_us
        FROM linked, mark WHERE is_start AND ended IS NOT NULL AND epoch_us(ended) < ms * 1000""",
    "run_events",
)
def stage_stream_held(d: Data) -> DataFrame:
    """Stages that the watermark has passed"""
    progress = extract.extract_progress(_messages(_event_stream(d)))
    found = _written(d, stateful.stage_stream(progress, "1 hour"), "held_stages")
    return found.select("run_id", "stage", F.unix_micros("started_at").alias("started_us"), F.unix_micros("ended_at").alias("ended_us"))
