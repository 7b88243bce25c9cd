"""Neighbourhoods of all nodes, all chunks and a table of searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import neighbourhoods, retrieval
from .graph_queries import _rid_edges
from .registry import Data, joined, query, rounded

ARCS = """arcs AS (SELECT 'r' || seq AS rid, source_id AS a, target_id AS b FROM raw_edges
                   UNION SELECT 'r' || seq, target_id, source_id FROM raw_edges)"""


def _trails(starts: str, group: str, limit: int) -> str:
    """The first trails of up to two relations of each group, from ``starts(group, center)``."""
    return f"""{ARCS}, starts AS ({starts}),
        l1 AS (SELECT {group} AS g, center, [rid] AS rids, [center, b] AS ids FROM starts JOIN arcs ON a = center),
        short AS (SELECT g FROM (SELECT {group} AS g, count(rid) AS n FROM starts LEFT JOIN arcs ON a = center GROUP BY 1) x
                  WHERE n < {limit}),
        l2 AS (SELECT g, center, list_append(rids, rid) AS rids, list_append(ids, b) AS ids
               FROM l1 JOIN short USING (g) JOIN arcs ON a = ids[2] WHERE rids[1] <> rid),
        top AS (SELECT * FROM (SELECT 1 AS len, * FROM l1 UNION ALL SELECT 2, * FROM l2) x
                QUALIFY row_number() OVER (PARTITION BY g ORDER BY len, center, rids, ids) <= {limit})"""


@query(
    f"""WITH {_trails("SELECT id AS center FROM raw_nodes", "center", 70)}
        SELECT center, len AS length, array_to_string(rids, '~') AS rids, array_to_string(ids, '~') AS node_ids FROM top""",
    "raw_nodes raw_edges",
)
def first_trails_all(d: Data) -> DataFrame:
    """The first 70 trails of every node"""
    centers = d.view("raw_nodes").select(F.col("id").alias("center"))
    trails = neighbourhoods.first_trails_of(_rid_edges(d), centers, 2, 70)
    return trails.select("center", "length", joined("rids"), joined("node_ids"))


@query(
    f"""WITH {_trails("SELECT id AS center FROM raw_nodes", "center", 50)}
        SELECT DISTINCT 'node' AS kind, center, unnest([center, ids[-1]]) AS what FROM top
        UNION ALL SELECT DISTINCT 'edge', center, unnest(rids) FROM top""",
    "raw_nodes raw_edges",
)
def k_hop_all(d: Data) -> DataFrame:
    """The neighbourhood of every node"""
    nodes = d.view("raw_nodes")
    found = neighbourhoods.k_hop_all(nodes, _rid_edges(d), nodes.select(F.col("id").alias("center")))
    return found.nodes.select(F.lit("node").alias("kind"), "center", F.col("id").alias("what")).unionByName(
        found.edges.select(F.lit("edge").alias("kind"), "center", F.col("rid").alias("what"))
    )


@query(
    f"""WITH {_trails("SELECT DISTINCT chunk_id, node_id AS center FROM mentions JOIN raw_nodes ON id = node_id", "chunk_id", 20)}
        SELECT 'entity' AS kind, chunk_id, center AS what FROM starts
        UNION ALL SELECT 'path', g, array_to_string(rids, '~') || '>' || array_to_string(ids, '~') FROM top""",
    "raw_nodes raw_edges mentions",
)
def chunk_entities_all(d: Data) -> DataFrame:
    """G9 of every chunk"""
    found = neighbourhoods.chunk_entities_all(d.view("mentions"), d.view("raw_nodes"), _rid_edges(d))
    path = F.concat(F.array_join("rids", "~"), F.lit(">"), F.array_join("node_ids", "~"))
    return found.entities.select(F.lit("entity").alias("kind"), "chunk_id", F.col("id").alias("what")).unionByName(
        found.paths.select(F.lit("path").alias("kind"), "chunk_id", path.alias("what"))
    )


SEEDS = """asked AS (SELECT DISTINCT unnest([split_part(name, ' ', 1), split_part(name, ' ', 2), substr(name, 2, 2)]) AS q FROM raw_nodes),
    seeds AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN lower(name) = q THEN 1 ELSE 2 END,
                     CASE WHEN starts_with(lower(name), q) THEN 1 ELSE 2 END, name, id) AS rank
              FROM asked JOIN raw_nodes ON contains(lower(name), q) OR len(list_filter(aliases, lambda x: contains(lower(x), q))) > 0
              QUALIFY rank <= 20)"""


def _searches(d: Data) -> DataFrame:
    words = F.split("name", " ")
    parts = F.array(words[0], words[1], F.substr("name", F.lit(2), F.lit(2)))
    found = d.view("raw_nodes").select(F.explode(parts).alias("query")).distinct()
    return found.select(F.col("query").alias("query_id"), "query")


@query(f"WITH {SEEDS} SELECT q AS query_id, id, CAST(rank AS INTEGER) AS rank FROM seeds", "raw_nodes")
def search_nodes_all(d: Data) -> DataFrame:
    """G10, M1 for a table of searches"""
    return neighbourhoods.search_nodes_all(d.view("raw_nodes"), _searches(d))


@query(
    f"""WITH {SEEDS},
        links AS (SELECT here, there, max(confidence) AS c FROM (
                      SELECT source_id AS here, target_id AS there, confidence FROM raw_edges
                      UNION ALL SELECT target_id, source_id, confidence FROM raw_edges) x WHERE here <> there GROUP BY 1, 2),
        supports AS (SELECT node_id, count(DISTINCT chunk_id) AS s FROM mentions GROUP BY 1),
        arcs AS (SELECT here, there, c, coalesce(s, 0) AS s FROM links LEFT JOIN supports ON node_id = there),
        h0 AS (SELECT q, [id] AS path, 0.0::DOUBLE AS c, coalesce(s, 0) AS s FROM seeds LEFT JOIN supports ON node_id = id),
        h1 AS (SELECT q, list_append(path, there) AS path, h.c + a.c AS c, h.s + a.s AS s FROM h0 h JOIN arcs a ON here = path[-1]),
        h2 AS (SELECT q, list_append(path, there) AS path, h.c + a.c AS c, h.s + a.s AS s FROM h1 h JOIN arcs a ON here = path[-1]
               WHERE NOT list_contains(path, there)),
        scored AS (SELECT q, path, round(0.6 / (len(path) - 1) + 0.3 * (c / (len(path) - 1)) + 0.1 * ln(1 + s), 9) AS score
                   FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) x),
        best AS (SELECT q, path[-1] AS node_id, path, score FROM scored
                 QUALIFY row_number() OVER (PARTITION BY q, path[-1] ORDER BY score DESC, path) = 1)
        SELECT q AS query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, node_id) AS INTEGER) AS rank,
               node_id, round(score, 6) AS score, array_to_string(path, '~') AS path
        FROM best QUALIFY rank <= 8""",
    "raw_nodes raw_edges mentions",
)
def kg_topk(d: Data) -> DataFrame:
    """P4"""
    found = neighbourhoods.kg_topk(d.view("raw_nodes"), d.view("raw_edges"), d.view("mentions"), _searches(d))
    return found.select("query_id", "rank", "node_id", rounded("score"), joined("path"))


@query(
    """WITH arcs AS (SELECT source_id AS here, target_id AS there, confidence FROM raw_edges
                     UNION ALL SELECT target_id, source_id, confidence FROM raw_edges),
        links AS (SELECT here, there, max(confidence) AS confidence FROM arcs WHERE here <> there GROUP BY 1, 2),
        asked AS (SELECT DISTINCT a, b FROM (
                      SELECT id AS a, 'p' || (seq * 13 + 5) % (SELECT count(*) FROM raw_nodes) AS b FROM raw_nodes
                      UNION ALL SELECT id, 'p7' FROM raw_nodes) x WHERE a <> b),
        paths AS (SELECT a, b, 1 AS length, NULL AS via, confidence FROM asked JOIN links ON here = a AND there = b
                  UNION ALL
                  SELECT a, b, 2, x.there, (x.confidence + y.confidence) / 2 FROM asked JOIN links x ON x.here = a
                  JOIN links y ON y.here = x.there AND y.there = b WHERE x.there <> b)
        SELECT a, b, length, via, round(confidence, 6) AS confidence FROM paths
        QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY length, confidence DESC, via) = 1""",
    "raw_nodes raw_edges",
)
def explain_paths_undirected(d: Data) -> DataFrame:
    """G17 in either direction, to many nodes and to one that all ask for"""
    nodes = d.view("raw_nodes").select("seq", F.col("id").alias("a"))
    total = d.view("raw_nodes").agg(F.count(F.lit(1)).alias("total"))
    other = F.concat(F.lit("p"), (F.col("seq") * 13 + 5) % total.scalar())
    pairs = nodes.select("a", other.alias("b")).unionByName(nodes.select("a", F.lit("p7").alias("b")))
    found = retrieval.explain_paths(d.view("raw_edges"), pairs, directed=False)
    return found.withColumn("confidence", rounded("confidence"))
