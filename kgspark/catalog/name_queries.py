"""Mentions, similar concepts and synonyms over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import containment, similar
from .registry import Data, d_collapse, joined, query

LETTER = r"[\p{L}\p{N}_]"

MENTIONS = rf"""names AS (
        SELECT DISTINCT id, {d_collapse("lower(name)")} AS name
        FROM (SELECT id, name FROM named_nodes UNION ALL SELECT id, unnest(aliases) FROM named_nodes) x
    ), wanted AS (
        SELECT DISTINCT name, regexp_extract(name, '^{LETTER}+') AS first_word, length(name) AS n,
               regexp_matches(name, '{LETTER}$') AS open_end
        FROM names WHERE regexp_matches(name, '{LETTER}')
    ), texts AS (
        SELECT doc_id, {d_collapse("lower(coalesce(text, ''))")} AS t FROM documents
    ), segments AS (
        SELECT doc_id, unnest(regexp_extract_all(t, '[^\p{{L}}\p{{N}}_]*{LETTER}+')) AS piece,
               generate_subscripts(regexp_extract_all(t, '[^\p{{L}}\p{{N}}_]*{LETTER}+'), 1) AS i
        FROM texts
    ), words AS (
        SELECT doc_id, regexp_extract(piece, '{LETTER}+$') AS word,
               sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(regexp_extract(piece, '{LETTER}+$')) + 1 AS s
        FROM segments
    ), found AS (
        SELECT doc_id, s, s + n AS e, name
        FROM words JOIN wanted ON first_word = word JOIN texts USING (doc_id)
        WHERE substr(t, CAST(s AS BIGINT), n) = name
          AND NOT (open_end AND regexp_matches(substr(t, CAST(s + n AS BIGINT), 1), '{LETTER}'))
    ), folded AS (
        SELECT doc_id, list_reduce(
                   list({{'s': s, 'e': e, 'names': [name]}} ORDER BY s, e DESC),
                   lambda a, x: CASE WHEN x.s >= a.e THEN {{'s': a.s, 'e': x.e, 'names': list_concat(a.names, x.names)}} ELSE a END
               ) AS kept
        FROM found GROUP BY doc_id
    ), counted AS (SELECT doc_id, unnest(kept.names) AS name FROM folded)"""


@query(
    f"""WITH {MENTIONS}
        SELECT 'doc-' || doc_id AS chunk_id, id AS node_id, count(*) AS n FROM counted JOIN names USING (name) GROUP BY 1, 2""",
    "named_nodes",
)
def build_mentions(d: Data) -> DataFrame:
    """G16"""
    chunks = d.table("documents").select(F.concat(F.lit("doc-"), "doc_id").alias("chunk_id"), "text")
    return containment.build_mentions(chunks, d.view("named_nodes"))


def _groups(links: str) -> str:
    """Components of ``links(kind, a, b)``, both ways, over ``known(kind, name)``."""
    return f"""links AS ({links}),
        reach AS (SELECT kind, name, name AS other FROM known
                  UNION SELECT r.kind, l.b, r.other FROM reach r JOIN links l ON l.kind = r.kind AND l.a = r.name AND l.b > r.other),
        grouped AS (SELECT kind, name, min(other) AS group_name FROM reach GROUP BY 1, 2)"""


ALIKE = f"""concepts AS (SELECT seq, id, name || ' ' || chapter AS name, type, description, aliases FROM raw_nodes),
    known AS (SELECT DISTINCT type AS kind, lower(name) AS name FROM concepts),
    {_groups('''SELECT a.kind, a.name AS a, b.name AS b FROM known a JOIN known b ON a.kind = b.kind AND a.name <> b.name
                WHERE levenshtein(a.name, b.name) <= floor(0.2 * greatest(length(a.name), length(b.name)) + 1e-9)''')}"""


@query(
    f"""WITH RECURSIVE {ALIKE},
        members AS (SELECT c.*, group_name FROM concepts c JOIN grouped g ON g.kind = c.type AND g.name = lower(c.name)),
        firsts AS (SELECT type, group_name, count(*) AS n, arg_min(id, seq) AS id, arg_min(name, seq) AS name,
                          arg_min(array_to_string(aliases, '~'), seq) AS own FROM members GROUP BY 1, 2),
        longest AS (SELECT type, group_name, description FROM members
                    QUALIFY row_number() OVER (PARTITION BY type, group_name ORDER BY length(description) DESC, seq) = 1),
        called AS (SELECT type, group_name, unnest(list_append(aliases, name)) AS alias FROM members),
        others AS (SELECT f.type, f.group_name, string_agg(DISTINCT alias, '~' ORDER BY alias) AS aliases
                   FROM firsts f JOIN called c ON c.type = f.type AND c.group_name = f.group_name AND c.alias <> f.name
                   GROUP BY 1, 2)
        SELECT id, name, f.type, description, CASE WHEN n = 1 THEN own ELSE coalesce(aliases, '') END AS aliases
        FROM firsts f JOIN longest USING (type, group_name) LEFT JOIN others USING (type, group_name)""",
    "raw_nodes",
)
def merge_similar_concepts(d: Data) -> DataFrame:
    """H26"""
    nodes = d.view("raw_nodes").withColumn("name", F.concat_ws(" ", "name", "chapter"))
    merged = similar.merge_similar_concepts(nodes)
    return merged.select("id", "name", "type", "description", joined("aliases"))


@query(
    """WITH names AS (SELECT DISTINCT lower(name || ' ' || chapter) AS name, type FROM raw_nodes)
       SELECT a.type, a.name AS a, b.name AS b,
              round(1 - levenshtein(a.name, b.name) / length(a.name), 6) AS similarity
       FROM names a JOIN names b ON a.type = b.type
        AND (length(a.name) > length(b.name) OR length(a.name) = length(b.name) AND a.name > b.name)
       WHERE levenshtein(a.name, b.name) <= floor(0.1 * length(a.name) + 1e-9)""",
    "raw_nodes",
)
def similar_names(d: Data) -> DataFrame:
    """The pairs alone, at another threshold"""
    names = d.view("raw_nodes").select("type", F.lower(F.concat_ws(" ", "name", "chapter")).alias("name"))
    found = similar.similar_pairs(names, 0.9, ["type"])
    return found.withColumn("similarity", F.round("similarity", 6))


@query(
    f"""WITH RECURSIVE claims AS (
            SELECT DISTINCT regexp_replace(name || ' ' || substr(description, -2), ' +', ' ', 'g') AS concept,
                   regexp_replace(lower(chapter || ' ' || substr(description, -2)), ' +', ' ', 'g') AS alias
            FROM raw_nodes
        ), kept AS (SELECT alias FROM claims GROUP BY 1 HAVING count(*) <= 5),
        named AS (SELECT concept, alias FROM claims JOIN kept USING (alias) WHERE concept <> alias),
        known AS (SELECT DISTINCT 0 AS kind, concept AS name FROM claims UNION SELECT 0, alias FROM named),
        {_groups("SELECT 0 AS kind, concept AS a, alias AS b FROM named UNION ALL SELECT 0, alias, concept FROM named")}
        SELECT substr(md5(group_name), 1, 16) AS group_id, name, count(*) OVER (PARTITION BY group_name) AS size FROM grouped""",
    "raw_nodes",
)
def detect_synonyms(d: Data) -> DataFrame:
    """A part of a size, called by its brand and size as well"""
    size = F.substr("description", F.lit(-2))
    names = d.view("raw_nodes").select(
        F.concat("name", F.lit(" "), size).alias("name"), F.array(F.concat("chapter", F.lit(" "), size)).alias("aliases")
    )
    return similar.detect_synonyms(names)
