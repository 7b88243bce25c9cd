"""Graph clean-up, ids, merging, quality, store mutations and graph reads over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import clean, components, graph_queries, identity, merge, ordering, quality, store
from .registry import Data, d_collapse, d_concept_id, d_node_id, d_rid, joined, query, rounded

BOOK = "book:parts"
UNDIRECTED = """und AS (SELECT scope, source_id AS a, target_id AS b FROM known UNION SELECT scope, target_id, source_id FROM known)"""
KNOWN = """known AS (SELECT e.scope, e.source_id, e.target_id FROM raw_edges e
    JOIN raw_nodes s ON s.scope = e.scope AND s.id = e.source_id JOIN raw_nodes t ON t.scope = e.scope AND t.id = e.target_id)"""
REACH = f"""{KNOWN}, {UNDIRECTED},
    reach AS (SELECT scope, id, id AS label FROM raw_nodes
              UNION SELECT r.scope, u.b, r.label FROM reach r JOIN und u ON u.scope = r.scope AND u.a = r.id),
    comp AS (SELECT scope, id, min(label) AS component FROM reach GROUP BY ALL)"""
STRUCTURE = f"""{REACH},
    sizes AS (SELECT scope, component, count(*) AS size FROM comp GROUP BY ALL),
    structure AS (
        SELECT n.scope, m / n.nodes AS connectivity_score, c AS components, m AS max_component_size, n.nodes AS total_nodes,
               e.edges AS total_edges, least(1.0, e.edges / n.nodes) AS relation_richness
        FROM (SELECT scope, count(*) AS nodes FROM raw_nodes GROUP BY 1) n
        JOIN (SELECT scope, count(*) AS edges FROM raw_edges GROUP BY 1) e USING (scope)
        JOIN (SELECT scope, count(*) AS c, max(size) AS m FROM sizes GROUP BY 1) s USING (scope))"""
HITS = """hits AS (SELECT DISTINCT k.scope, k.keyword FROM keywords k JOIN raw_nodes n ON n.scope = k.scope
    AND (contains(lower(n.name), lower(k.keyword)) OR contains(lower(n.description), lower(k.keyword))
         OR contains(lower(array_to_string(n.aliases, chr(1))), lower(k.keyword))))"""
COVERAGE = """subs AS (SELECT n.scope, n.covered AS covered_subchapters, o.total AS total_subchapters, n.covered / o.total AS
        subchapter_coverage FROM (SELECT scope, count(DISTINCT subchapter) AS covered FROM raw_nodes GROUP BY 1) n
        JOIN (SELECT scope, count(DISTINCT coalesce(subchapter, chapter)) AS total FROM outline GROUP BY 1) o USING (scope)),
    words AS (SELECT k.scope, count(h.keyword) AS covered_keywords, count(*) AS total_keywords,
                     count(h.keyword) / count(*) AS keyword_coverage
              FROM keywords k LEFT JOIN hits h ON h.scope = k.scope AND h.keyword = k.keyword GROUP BY 1)"""


def now() -> Column:
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def micros(name: str) -> Column:
    return F.unix_micros(name).alias(name.replace("_at", "_us"))


# ------------------------------------------------------- clean-up and filters


@query(
    f"""SELECT seq, {d_collapse("name")} AS name, {d_collapse("description")} AS description, array_to_string(list_sort(aliases), '~')
               AS aliases FROM raw_nodes""",
    "raw_nodes",
)
def normalize_graph(d: Data) -> DataFrame:
    """F1"""
    spaced = d.view("raw_nodes").withColumns(
        {
            "name": F.concat(F.lit(" "), F.replace("name", F.lit(" "), F.lit("\t "))),
            "description": F.concat("description", F.lit(" \n")),
        }
    )
    return clean.normalize_nodes(spaced).select("seq", "name", "description", joined("aliases"))


@query(
    f"""SELECT seq, id, type, name, canonical_key, score, source FROM (
            SELECT seq, id, type, name, NULL AS canonical_key, score, NULL AS source FROM raw_nodes WHERE length(type) > 5
            UNION ALL
            SELECT seq, {d_concept_id("name")}, 'concept', name, replace(name, ' ', '_'), score, 'llm_generated'
            FROM (SELECT *, lower(chapter) AS topic FROM raw_nodes WHERE length(type) <= 5) x) y""",
    "raw_nodes",
)
def normalize_raw_nodes(d: Data) -> DataFrame:
    """nodes; short types stand for rows without id"""
    done = F.length("type") > 5
    raw = d.view("raw_nodes").select(
        "seq",
        F.when(done, F.col("id")).alias("id"),
        "type",
        "name",
        "description",
        F.lit(None).cast("string").alias("canonical_key"),
        "aliases",
        F.lower("chapter").alias("topic"),
        "chapter",
        "subchapter",
        "score",
        F.lit(None).cast("string").alias("source"),
        F.lit(None).cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("updated_at"),
    )
    return clean.normalize_raw_nodes(raw, now()).select("seq", "id", "type", "name", "canonical_key", "score", "source")


@query(
    f"""SELECT seq, upper(evidence_type) || ':' || {d_concept_id("source_id")} || '->' || {d_concept_id("target_id")} AS id,
               upper(evidence_type) AS type, 0.8::DOUBLE AS confidence,
               '从文本中抽取的关系: ' || source_id || ' -> ' || target_id AS evidence
        FROM (SELECT *, 'T' AS topic, src_section AS chapter, 'x' AS subchapter,
                     CASE WHEN type = 'REQUIRES' THEN 'mentions' ELSE lower(type) END AS evidence_type FROM raw_edges) x""",
    "raw_edges",
)
def normalize_raw_edges(d: Data) -> DataFrame:
    """relations known by names only"""
    nothing = F.lit(None).cast("string")
    raw = d.view("raw_edges").select(
        "seq",
        nothing.alias("id"),
        F.when(F.col("type") != "REQUIRES", F.lower("type")).alias("type"),
        nothing.alias("source_id"),
        nothing.alias("target_id"),
        F.col("source_id").alias("source_name"),
        F.col("target_id").alias("target_name"),
        F.lit(None).cast("double").alias("weight"),
        F.lit(None).cast("double").alias("confidence"),
        nothing.alias("evidence"),
        F.lit("T").alias("topic"),
        F.col("src_section").alias("chapter"),
        F.lit("x").alias("subchapter"),
        "src_section",
        F.lit(None).cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("updated_at"),
    )
    return clean.normalize_raw_edges(raw, now()).select("seq", "id", "type", "confidence", "evidence")


@query("SELECT seq, type, confidence FROM raw_edges WHERE confidence >= 0.55", "raw_edges")
def filter_storage(d: Data) -> DataFrame:
    """F3"""
    return clean.filter_storage(d.view("raw_edges")).select("seq", "type", "confidence")


@query(
    "SELECT seq, evidence FROM raw_edges WHERE confidence >= 0.60 AND len(string_split(evidence, ';')) >= 2", "raw_edges"
)
def filter_display(d: Data) -> DataFrame:
    """F4"""
    return clean.filter_display(d.view("raw_edges")).select("seq", "evidence")


@query(
    """SELECT e.seq, e.source_id, e.target_id FROM raw_edges e
       WHERE EXISTS (SELECT 1 FROM raw_nodes n WHERE n.id = e.source_id AND n.scope = e.scope)
         AND EXISTS (SELECT 1 FROM raw_nodes n WHERE n.id = e.target_id AND n.scope = e.scope)""",
    "raw_nodes raw_edges",
)
def drop_dangling(d: Data) -> DataFrame:
    """relations whose ends are both in their own scope"""
    kept = clean.drop_dangling(d.view("raw_edges"), d.view("raw_nodes"), ["scope"])
    return kept.select("seq", "source_id", "target_id")


@query("SELECT seq, id, name FROM raw_nodes WHERE scope = 'section:S3'", "raw_nodes")
def scope_filter(d: Data) -> DataFrame:
    """F7"""
    return clean.scope_filter(d.view("raw_nodes"), "section:S3").select("seq", "id", "name")


@query(
    """SELECT 'node' AS kind, id, name AS label, type, NULL AS source, NULL AS target FROM raw_nodes
       UNION ALL
       SELECT 'edge', source_id || '-' || target_id, type, type, source_id, target_id FROM raw_edges""",
    "raw_nodes raw_edges",
)
def graph_view(d: Data) -> DataFrame:
    """F8"""
    edges = d.view("raw_edges").withColumn("rid", F.lit(""))
    nodes, links = clean.graph_view(d.view("raw_nodes"), edges)
    return nodes.select(F.lit("node").alias("kind"), "*").unionByName(
        links.select(F.lit("edge").alias("kind"), "*"), allowMissingColumns=True
    )


# ------------------------------------------------------------------------ ids


def _identified(d: Data) -> tuple[DataFrame, DataFrame]:
    nodes = d.view("raw_nodes").withColumn("section", F.col("subchapter")).withColumn("scope", F.lit("book_parts"))
    edges = (
        d.view("raw_edges")
        .withColumn("section", F.col("src_section"))
        .withColumn("scope", F.lit("book_parts"))
        .withColumn("description", F.col("evidence"))
    )
    return identity.assign_idempotent_ids(nodes, edges, ["section"])


IDENTIFIED = f"""named AS (SELECT seq, subchapter AS section, id AS raw_id, name, type, description, aliases,
        {d_node_id("name", "type", "'book_parts'")} AS id FROM raw_nodes),
    mapped AS (SELECT e.*, s.id AS sid, t.id AS tid FROM raw_edges e
        JOIN named s ON s.section = e.src_section AND s.raw_id = e.source_id
        JOIN named t ON t.section = e.src_section AND t.raw_id = e.target_id),
    linked AS (SELECT *, substr(sha256(sid || '|' || tid || '|' || type || '|book_parts|' || evidence), 1, 16) AS new_rid FROM mapped
        QUALIFY row_number() OVER (PARTITION BY src_section, sid, tid, type ORDER BY seq) = 1)"""


@query(f"WITH {IDENTIFIED} SELECT seq, section, id, name, type FROM named", "raw_nodes")
def idempotent_nodes(d: Data) -> DataFrame:
    """G1: nodes"""
    return _identified(d)[0].select("seq", "section", "id", "name", "type")


@query(
    f"WITH {IDENTIFIED} SELECT seq, src_section AS section, sid AS source_id, tid AS target_id, type, new_rid AS rid FROM linked",
    "raw_nodes raw_edges",
)
def idempotent_edges(d: Data) -> DataFrame:
    """G1: relations"""
    return _identified(d)[1].select("seq", "section", "source_id", "target_id", "type", "rid")


# ---------------------------------------------------------------------- merge


def _sections(d: Data) -> DataFrame:
    return d.view("raw_nodes").select("chapter")


MERGED = """groups AS (SELECT name, type, count(*) AS n, arg_min(id, seq) AS id, min(seq) AS seq FROM raw_nodes GROUP BY 1, 2),
    texts AS (SELECT name, type, description FROM raw_nodes
              QUALIFY row_number() OVER (PARTITION BY name, type ORDER BY length(description) DESC, seq) = 1),
    names AS (SELECT name, type, string_agg(DISTINCT a, '~' ORDER BY a) AS aliases
              FROM (SELECT name, type, unnest(aliases) AS a FROM raw_nodes) x GROUP BY 1, 2),
    single AS (SELECT seq, array_to_string(aliases, '~') AS own FROM raw_nodes),
    merged AS (SELECT g.seq, g.id, g.name, g.type, t.description, CASE WHEN g.n = 1 THEN s.own ELSE a.aliases END AS aliases
               FROM groups g JOIN texts t USING (name, type) JOIN names a USING (name, type) JOIN single s ON s.seq = g.seq)"""


@query(f"WITH {MERGED} SELECT *, 'book:parts' AS scope FROM merged", "raw_nodes")
def merge_nodes(d: Data) -> DataFrame:
    """H1"""
    merged = merge.merge_nodes(d.view("raw_nodes"), BOOK)
    return merged.select("seq", "id", "name", "type", "description", joined("aliases"), "scope")


BOOK_EDGES = """book_edges AS (SELECT e.* FROM raw_edges e JOIN merged s ON s.id = e.source_id JOIN merged t ON t.id = e.target_id
    QUALIFY row_number() OVER (PARTITION BY source_id, target_id, e.type ORDER BY e.seq) = 1)"""


@query(
    f"""WITH {MERGED}, {BOOK_EDGES} SELECT seq, source_id, target_id, type, weight, src_section, 'book:parts' AS scope
        FROM book_edges""",
    "raw_nodes raw_edges",
)
def merge_edges(d: Data) -> DataFrame:
    """H2"""
    merged = merge.merge_edges(d.view("raw_edges"), merge.merge_nodes(d.view("raw_nodes"), BOOK), BOOK)
    return merged.select("seq", "source_id", "target_id", "type", "weight", "src_section", "scope")


@query(
    """WITH kept AS (SELECT id, arg_min(id, seq) OVER (PARTITION BY name, type) AS merged_id FROM raw_nodes),
        r AS (SELECT e.seq, e.type, s.merged_id AS source_id, t.merged_id AS target_id FROM raw_edges e
              JOIN kept s ON s.id = e.source_id JOIN kept t ON t.id = e.target_id)
        SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY source_id, target_id, type ORDER BY seq) = 1""",
    "raw_nodes raw_edges",
)
def merge_edges_remapped(d: Data) -> DataFrame:
    """H3 with edges following their merged nodes"""
    book = merge.merge_book(d.view("raw_nodes"), d.view("raw_edges"), _sections(d), BOOK, "parts", remap_edges=True)
    return book.edges.select("seq", "type", "source_id", "target_id")


@query(
    """SELECT 'book:parts' AS book_id, string_agg(DISTINCT p_brand, '~' ORDER BY p_brand) AS chapters_covered,
              'Book: parts (ID: book:parts)' || chr(10) || 'Chapters: ' || string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand)
              || chr(10) || 'Total Chapters: ' || count(DISTINCT p_brand) AS hierarchy FROM part"""
)
def book_hierarchy(d: Data) -> DataFrame:
    """H3, H5"""
    book = merge.merge_book(d.view("raw_nodes"), d.view("raw_edges"), _sections(d), BOOK, "parts")
    return book.hierarchy.select("book_id", joined("chapters_covered"), "hierarchy")


@query(
    """WITH aged AS (SELECT *, CASE WHEN type IN ('LARGE', 'PROMO') AND score >= 0.5 THEN 1 ELSE 0 END AS age FROM raw_nodes),
        old AS (SELECT * FROM aged WHERE age = 0),
        old_kept AS (SELECT * FROM old QUALIFY row_number() OVER (PARTITION BY name, type ORDER BY seq) = 1),
        fresh AS (SELECT age, seq, id, name, type FROM old_kept UNION ALL SELECT age, seq, id, name, type FROM aged WHERE age = 1),
        grown AS (SELECT * FROM fresh QUALIFY row_number() OVER (PARTITION BY name, type ORDER BY age, seq) = 1),
        links AS (SELECT *, CASE WHEN confidence >= 0.6 THEN 0 ELSE 1 END AS age FROM raw_edges),
        old_links AS (SELECT * FROM links WHERE age = 0 AND source_id IN (SELECT id FROM old_kept) AND target_id IN (SELECT id FROM old_kept)
                      QUALIFY row_number() OVER (PARTITION BY source_id, target_id, type ORDER BY seq) = 1),
        new_links AS (SELECT * FROM old_links UNION ALL SELECT * FROM links WHERE age = 1),
        grown_links AS (SELECT * FROM new_links WHERE source_id IN (SELECT id FROM grown) AND target_id IN (SELECT id FROM grown)
                        QUALIFY row_number() OVER (PARTITION BY source_id, target_id, type ORDER BY age, seq) = 1)
        SELECT 'node' AS kind, seq, id AS what, type FROM grown
        UNION ALL SELECT 'edge', seq, source_id || target_id, type FROM grown_links""",
    "raw_nodes raw_edges",
)
def merge_incremental(d: Data) -> DataFrame:
    """H4: a merged book receives the rest of the sections"""
    nodes, edges = d.view("raw_nodes"), d.view("raw_edges")
    late, weak = F.col("type").isin("LARGE", "PROMO") & (F.col("score") >= 0.5), F.col("confidence") < 0.6
    book = merge.merge_book(nodes.where(~late), edges.where(~weak), _sections(d), BOOK, "parts")
    grown = merge.merge_incremental(
        book.nodes, book.edges, nodes.where(late), edges.where(weak), _sections(d), BOOK, "parts"
    )
    return grown.nodes.select(F.lit("node").alias("kind"), "seq", F.col("id").alias("what"), "type").unionByName(
        grown.edges.select(F.lit("edge").alias("kind"), "seq", F.concat("source_id", "target_id").alias("what"), "type")
    )


@query(
    f"""WITH {MERGED}, {BOOK_EDGES},
        c AS (SELECT (SELECT count(*) FROM raw_nodes) AS original_nodes, (SELECT count(*) FROM raw_edges) AS original_edges,
                     (SELECT count(*) FROM merged) AS merged_nodes, (SELECT count(*) FROM book_edges) AS merged_edges,
                     (SELECT count(DISTINCT chapter) FROM raw_nodes) AS chapters_covered)
        SELECT original_nodes AS original_sections, *, round_even((original_nodes - merged_nodes) / original_nodes, 3)
               AS node_dedup_ratio, round_even((original_edges - merged_edges) / original_edges, 3) AS edge_dedup_ratio FROM c""",
    "raw_nodes raw_edges",
)
def merge_stats(d: Data) -> DataFrame:
    """H6"""
    nodes, edges = d.view("raw_nodes"), d.view("raw_edges")
    book = merge.merge_book(nodes, edges, _sections(d), BOOK, "parts")
    return merge.merge_stats(nodes, edges, _sections(d), book)


def _display_nodes(d: Data) -> DataFrame:
    """Four of six types stand for concepts."""
    concept = ~F.col("type").isin("PROMO", "LARGE")
    return d.view("raw_nodes").select(
        "seq",
        "id",
        "name",
        F.when(concept, "concept").otherwise(F.col("type")).alias("type"),
        F.when(F.col("type") == "SMALL", F.col("chapter")).alias("canonical_key"),
        "description",
        "aliases",
        "score",
        F.when(F.col("score") > 0.6, F.timestamp_millis(F.col("seq") * 1000)).alias("updated_at"),
    )


DISPLAY_NODES = """shown AS (SELECT seq, id, name, CASE WHEN type IN ('PROMO', 'LARGE') THEN type ELSE 'concept' END AS type,
        CASE WHEN type = 'SMALL' THEN chapter END AS canonical_key, description, aliases, score,
        CASE WHEN score > 0.6 THEN seq * 1000000 END AS updated_us FROM raw_nodes),
    keyed AS (SELECT *, CASE WHEN type = 'concept' THEN coalesce(canonical_key, name) ELSE id END AS k FROM shown),
    spread AS (SELECT k, type = 'concept' AS c, string_agg(DISTINCT a, '~' ORDER BY a) AS alias_union
               FROM (SELECT k, type, unnest(aliases) AS a FROM keyed) x GROUP BY 1, 2),
    display AS (SELECT x.c, x.k, arg_min(x.id, x.seq) AS id, count(*) AS n, max(score) AS score,
                       arg_max(updated_us, seq) FILTER (updated_us IS NOT NULL) AS updated_us,
                       arg_min(description, -length(description) * 1000000 + seq) AS description,
                       arg_min(array_to_string(aliases, '~'), seq) AS own_aliases
                FROM (SELECT *, type = 'concept' AS c FROM keyed) x GROUP BY 1, 2)"""


@query(
    f"""WITH {DISPLAY_NODES} SELECT id, CASE WHEN c AND n > 1 THEN alias_union ELSE own_aliases END AS aliases, description,
        score, updated_us FROM display JOIN spread USING (c, k)""",
    "raw_nodes",
)
def merge_nodes_display(d: Data) -> DataFrame:
    """H7"""
    merged = merge.merge_nodes_display(_display_nodes(d))
    return merged.select("id", joined("aliases"), "description", "score", micros("updated_at"))


def _display_edges(d: Data) -> DataFrame:
    return d.view("raw_edges").withColumn("updated_at", F.col("created_at"))


DISPLAY_EDGES = """e AS (SELECT *, source_id || '->' || target_id || ':' || type ||
        CASE WHEN length(evidence) > 20 THEN ':' || substr(md5(evidence), 1, 8) ELSE '' END AS k FROM raw_edges),
    shown AS (SELECT k, min(seq) AS seq, list_reduce(list(weight ORDER BY seq), lambda a, b: (a + b) / 2) AS weight,
        max(confidence) AS confidence,
        list_reduce(list(evidence ORDER BY seq), lambda a, b: CASE WHEN contains(a, b) THEN a ELSE a || '; ' || b END) AS evidence,
        epoch_us(arg_max(created_at, seq)) AS updated_us FROM e GROUP BY 1)"""


@query(
    f"WITH {DISPLAY_EDGES} SELECT seq, round(weight, 6) AS weight, round(confidence, 6) AS confidence, evidence, updated_us FROM shown",
    "raw_edges",
)
def merge_edges_display(d: Data) -> DataFrame:
    """H8"""
    merged = merge.merge_edges_display(_display_edges(d))
    return merged.select("seq", rounded("weight"), rounded("confidence"), "evidence", micros("updated_at"))


@query(
    """SELECT k AS edge_key, evidence AS text, count(*) AS rows, min(seq) AS seen FROM (
         SELECT *, source_id || '->' || target_id || ':' || type ||
                CASE WHEN length(evidence) > 20 THEN ':' || substr(md5(evidence), 1, 8) ELSE '' END AS k FROM raw_edges) x GROUP BY 1, 2""",
    "raw_edges",
)
def display_evidence(d: Data) -> DataFrame:
    """H8: evidence as rows"""
    return merge.display_evidence(_display_edges(d))


@query(
    """SELECT count(*) AS pairs, round(sum(weight), 4) AS weights, sum(parts) AS texts FROM (
         SELECT list_reduce(list(weight ORDER BY seq), lambda a, b: (a + b) / 2) AS weight,
                len(string_split(list_reduce(list(evidence ORDER BY seq),
                    lambda a, b: CASE WHEN contains(a, b) THEN a ELSE a || '; ' || b END), '; ')) AS parts
         FROM (SELECT seq, weight, CASE WHEN length(evidence) > 20 THEN type ELSE evidence END AS evidence, src_section, type
               FROM raw_edges) x GROUP BY src_section, type) y""",
    "raw_edges",
)
def merge_edges_display_hot(d: Data) -> DataFrame:
    """H8 with few, very large groups: all relations of a section and type are one"""
    short = F.when(F.length("evidence") > 20, F.col("type")).otherwise(F.col("evidence"))
    edges = _display_edges(d).withColumns(
        {"source_id": F.col("src_section"), "target_id": F.lit("all"), "evidence": short}
    )
    merged = merge.merge_edges_display(edges)
    return merged.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.round(F.sum("weight"), 4).alias("weights"),
        F.sum(F.size(F.split("evidence", "; "))).alias("texts"),
    )


@query(
    f"""WITH {DISPLAY_NODES}, {DISPLAY_EDGES.replace("shown AS", "links AS")}
        SELECT (SELECT count(*) FROM display) AS total_nodes, (SELECT count(*) FROM links) AS total_edges,
               (SELECT string_agg(DISTINCT chapter, '~' ORDER BY chapter) FROM raw_nodes) AS chapters_covered,
               '合并后的知识图谱' AS hierarchy""",
    "raw_nodes raw_edges",
)
def merge_graphs_display(d: Data) -> DataFrame:
    """H9"""
    shown = merge.merge_graphs_display(_display_nodes(d), _display_edges(d), _sections(d))
    return shown.summary.select("total_nodes", "total_edges", joined("chapters_covered"), "hierarchy")


@query(
    f"""WITH {DISPLAY_NODES}, {DISPLAY_EDGES.replace("shown AS", "links AS")}
        SELECT 'node' AS kind, id AS item, score AS value, updated_us FROM display
        UNION ALL SELECT 'edge', seq::VARCHAR, round(confidence, 6), updated_us FROM links""",
    "raw_nodes raw_edges",
)
def merged_graph_rows(d: Data) -> DataFrame:
    """H9: the merged nodes and edges themselves"""
    shown = merge.merge_graphs_display(_display_nodes(d), _display_edges(d), _sections(d))
    nodes = shown.nodes.select(
        F.lit("node").alias("kind"), F.col("id").alias("item"), F.col("score").alias("value"), micros("updated_at")
    )
    edges = shown.edges.select(
        F.lit("edge").alias("kind"),
        F.col("seq").cast("string").alias("item"),
        rounded("confidence", "value"),
        micros("updated_at"),
    )
    return nodes.unionByName(edges)


# -------------------------------------------------------------------- quality


@query(f"WITH RECURSIVE {REACH} SELECT scope, id, component FROM comp", "raw_nodes raw_edges")
def connected_components(d: Data) -> DataFrame:
    """H10a per scope"""
    return components.connected_components(d.view("raw_nodes"), d.view("raw_edges"))


@query(
    """WITH RECURSIVE und AS (SELECT source_id AS a, target_id AS b FROM raw_edges
                              UNION SELECT target_id, source_id FROM raw_edges),
        cc(id, component) USING KEY (id) AS (
            SELECT id, id FROM raw_nodes
            UNION SELECT u.b, min(c.component) FROM cc c JOIN und u ON u.a = c.id JOIN recurring.cc r ON r.id = u.b
                  WHERE c.component < r.component GROUP BY u.b)
        SELECT id, component FROM cc""",
    "raw_nodes raw_edges",
)
def connected_components_global(d: Data) -> DataFrame:
    """H10a over the whole graph"""
    return components.connected_components(d.view("raw_nodes"), d.view("raw_edges"), by=())


@query(
    """SELECT conv_id, turn, 't' || conv_id || '-' || (SELECT min(turn) FROM conversations) AS component FROM conversations"""
)
def connected_components_chains(d: Data) -> DataFrame:
    """H10a on long thin components: the turns of a conversation in a row"""
    turns = d.table("conversations").select(
        "conv_id",
        "turn",
        F.concat(F.lit("t"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
    )
    following = F.concat(F.lit("t"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") + 1).cast("string"))
    links = turns.select(F.col("id").alias("source_id"), following.alias("target_id"))
    return turns.join(components.connected_components(turns, links, by=()), "id").select("conv_id", "turn", "component")


@query(
    f"""WITH RECURSIVE {STRUCTURE} SELECT scope, round(connectivity_score, 6) AS connectivity_score, components,
        max_component_size, total_nodes, total_edges FROM structure""",
    "raw_nodes raw_edges",
)
def graph_structure(d: Data) -> DataFrame:
    """H10"""
    s = quality.graph_structure(d.view("raw_nodes"), d.view("raw_edges"))
    return s.withColumn("connectivity_score", rounded("connectivity_score"))


@query("SELECT scope, type, count(*) AS relations FROM raw_edges GROUP BY 1, 2", "raw_edges")
def relation_types(d: Data) -> DataFrame:
    """H11"""
    return quality.relation_types(d.view("raw_edges"))


@query(
    """SELECT scope, n.c AS total_nodes, e.c AS total_edges, round(least(1.0, e.c / n.c), 6) AS relation_richness
       FROM (SELECT scope, count(*) AS c FROM raw_nodes GROUP BY 1) n
       JOIN (SELECT scope, count(*) AS c FROM incoming_edges GROUP BY 1) e USING (scope)
       UNION ALL
       SELECT scope, count(*), 0, 0.0 FROM raw_nodes WHERE scope NOT IN (SELECT scope FROM incoming_edges) GROUP BY 1""",
    "raw_nodes incoming_edges",
)
def relation_richness(d: Data) -> DataFrame:
    """H12"""
    r = quality.relation_richness(d.view("raw_nodes"), d.view("incoming_edges"))
    return r.withColumn("relation_richness", rounded("relation_richness"))


@query(
    f"WITH {HITS}, {COVERAGE} SELECT scope, covered_subchapters, total_subchapters, round(subchapter_coverage, 6) AS subchapter_coverage FROM subs",
    "raw_nodes keywords outline",
)
def subchapter_coverage(d: Data) -> DataFrame:
    """H13"""
    c = quality.subchapter_coverage(d.view("raw_nodes"), d.view("outline"))
    return c.withColumn("subchapter_coverage", rounded("subchapter_coverage"))


@query(f"WITH {HITS} SELECT scope, keyword FROM hits", "raw_nodes keywords")
def keyword_hits(d: Data) -> DataFrame:
    """G12"""
    return quality.keyword_hits(d.view("raw_nodes"), d.view("keywords"))


@query(
    f"WITH {HITS}, {COVERAGE} SELECT scope, covered_keywords, total_keywords, round(keyword_coverage, 6) AS keyword_coverage FROM words",
    "raw_nodes keywords outline",
)
def keyword_coverage(d: Data) -> DataFrame:
    """H14"""
    c = quality.keyword_coverage(d.view("raw_nodes"), d.view("keywords"))
    return c.withColumn("keyword_coverage", rounded("keyword_coverage"))


@query(
    f"""WITH RECURSIVE {STRUCTURE}, {HITS}, {COVERAGE},
        scored AS (SELECT *, 0.4 * subchapter_coverage + 0.3 * keyword_coverage + 0.2 * connectivity_score +
                          0.1 * relation_richness AS coverage_score FROM structure JOIN subs USING (scope) JOIN words USING (scope))
        SELECT scope, components, total_nodes, total_edges, round(connectivity_score, 6) AS connectivity_score,
               round(coverage_score, 6) AS coverage_score,
               round(0.3 * connectivity_score + 0.3 * relation_richness + 0.4 * coverage_score, 6) AS quality_score,
               '知识图谱评估结果:' || chr(10) || '- 节点数量: ' || total_nodes || chr(10) || '- 关系数量: ' || total_edges ||
               printf(chr(10) || '- 连通性得分: %.2f' || chr(10) || '- 关系丰富度: %.2f' || chr(10) || '- 知识覆盖度: %.2f' ||
                      chr(10) || '- 总体质量分数: %.2f', connectivity_score, relation_richness, coverage_score,
                      0.3 * connectivity_score + 0.3 * relation_richness + 0.4 * coverage_score) AS kg_summary
        FROM scored""",
    "raw_nodes raw_edges keywords outline",
)
def evaluate_graph(d: Data) -> DataFrame:
    """H15, H16"""
    e = quality.evaluate_graph(d.view("raw_nodes"), d.view("raw_edges"), d.view("outline"), d.view("keywords"))
    return e.select(
        "scope",
        "components",
        "total_nodes",
        "total_edges",
        rounded("connectivity_score"),
        rounded("coverage_score"),
        rounded("quality_score"),
        "kg_summary",
    )


@query(
    "SELECT (SELECT count(*) FROM raw_nodes) AS total_nodes, (SELECT count(*) FROM raw_edges) AS total_edges",
    "raw_nodes raw_edges",
)
def graph_totals(d: Data) -> DataFrame:
    """H17"""
    return quality.graph_totals(d.view("raw_nodes"), d.view("raw_edges"))


@query(
    f"""WITH {IDENTIFIED}, strong AS (SELECT * FROM linked WHERE confidence >= 0.55),
        ids AS (SELECT DISTINCT arg_min(id, (section, seq)) OVER (PARTITION BY name, type) AS id FROM named),
        book_edges AS (SELECT e.* FROM strong e WHERE sid IN (SELECT id FROM ids) AND tid IN (SELECT id FROM ids)
                       QUALIFY row_number() OVER (PARTITION BY sid, tid, type ORDER BY seq) = 1)
        SELECT 'node' AS kind, type, count(DISTINCT name) AS n FROM named GROUP BY 2
        UNION ALL SELECT 'edge', type, count(*) FROM book_edges GROUP BY 2""",
    "raw_nodes raw_edges",
)
def book_type_histogram(d: Data) -> DataFrame:
    """F1, G1, F3, H1, H2 in one plan: types of the merged book graph"""
    nodes = clean.normalize_nodes(d.view("raw_nodes")).withColumns(
        {"section": F.col("subchapter"), "scope": F.lit("book_parts")}
    )
    edges = clean.normalize_edges(d.view("raw_edges").withColumn("description", F.col("evidence"))).withColumns(
        {"section": F.col("src_section"), "scope": F.lit("book_parts")}
    )
    nodes, edges = identity.assign_idempotent_ids(nodes, edges, ["section"])
    book = merge.merge_book(nodes, clean.filter_storage(edges), _sections(d), BOOK, "parts")
    rows = book.nodes.select(F.lit("node").alias("kind"), "type").unionByName(
        book.edges.select(F.lit("edge").alias("kind"), "type")
    )
    return rows.groupBy("kind", "type").agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------- graph reads


def _rid_edges(d: Data) -> DataFrame:
    return d.view("raw_edges").withColumn("rid", F.concat(F.lit("r"), F.col("seq").cast("string")))


@query(
    """SELECT 'edge' AS kind, seq, source_id || target_id AS what FROM raw_edges WHERE src_section = 'S7'
       UNION ALL
       SELECT 'node', seq, id FROM raw_nodes WHERE id IN (SELECT source_id FROM raw_edges WHERE src_section = 'S7' UNION
                                                     SELECT target_id FROM raw_edges WHERE src_section = 'S7')""",
    "raw_nodes raw_edges",
)
def section_graph(d: Data) -> DataFrame:
    """G2"""
    return _listed(graph_queries.section_graph(d.view("raw_edges"), d.view("raw_nodes"), "S7"))


def _listed(g: graph_queries.Graph) -> DataFrame:
    return g.edges.select(F.lit("edge").alias("kind"), "seq", F.concat("source_id", "target_id").alias("what")).unionByName(
        g.nodes.select(F.lit("node").alias("kind"), "seq", F.col("id").alias("what"))
    )


def _book_edges(d: Data) -> DataFrame:
    """Two books: strong and weak relations."""
    scope = F.when(F.col("confidence") >= 0.9, "book:strong").otherwise("book:weak")
    return d.view("raw_edges").withColumn("scope", scope)


@query(
    """SELECT 'edge' AS kind, seq, source_id || target_id AS what FROM raw_edges WHERE confidence >= 0.9
       UNION ALL
       SELECT 'node', seq, id FROM raw_nodes WHERE id IN (SELECT source_id FROM raw_edges WHERE confidence >= 0.9 UNION
                                                     SELECT target_id FROM raw_edges WHERE confidence >= 0.9)""",
    "raw_nodes raw_edges",
)
def book_graph(d: Data) -> DataFrame:
    """G3"""
    return _listed(graph_queries.book_graph(_book_edges(d), d.view("raw_nodes"), "strong"))


@query("SELECT 'strong' AS book_id")
def book_of_section(d: Data) -> DataFrame:
    """G4"""
    return graph_queries.book_of_section(_book_edges(d), "S7")


@query(
    "SELECT (SELECT count(*) FROM raw_nodes WHERE id IN (SELECT source_id FROM raw_edges WHERE confidence >= 0.9 UNION "
    "SELECT target_id FROM raw_edges WHERE confidence >= 0.9)) AS total_nodes, "
    "(SELECT count(*) FROM raw_edges WHERE confidence >= 0.9) AS total_edges",
    "raw_nodes raw_edges",
)
def section_view(d: Data) -> DataFrame:
    """G5"""
    return graph_queries.graph_stats(graph_queries.section_view(_book_edges(d), d.view("raw_nodes"), "S7"))


@query(
    """SELECT n.id, n.name, coalesce(m.c, 0) AS evidence_count, coalesce(m.ids, '') AS chunk_ids FROM raw_nodes n LEFT JOIN
         (SELECT node_id, count(*) AS c, array_to_string(list(chunk_id ORDER BY chunk_id)[1:10], '~') AS ids
          FROM mentions GROUP BY 1) m ON m.node_id = n.id""",
    "raw_nodes mentions",
)
def node_details(d: Data) -> DataFrame:
    """G6, M2 for all nodes"""
    details = graph_queries.node_details(d.view("raw_nodes"), d.view("mentions"))
    return details.select("id", "name", "evidence_count", joined("chunk_ids"))


@query(
    """SELECT n.id, count(*) AS evidence_count, array_to_string(list(chunk_id ORDER BY chunk_id)[1:10], '~') AS chunk_ids
       FROM raw_nodes n JOIN mentions m ON m.node_id = n.id WHERE n.id = 'p7' GROUP BY 1""",
    "raw_nodes mentions",
)
def node_detail(d: Data) -> DataFrame:
    """G6 for one node"""
    found = graph_queries.node_detail(d.view("raw_nodes"), d.view("mentions"), "p7", "section:S7")
    return found.select("id", "evidence_count", joined("chunk_ids"))


@query(
    """SELECT e.seq, e.type, e.confidence, e.weight, s.name AS source_name, s.type AS source_type, t.name AS target_name,
              t.type AS target_type FROM raw_edges e JOIN raw_nodes s ON s.scope = e.scope AND s.id = e.source_id
       JOIN raw_nodes t ON t.scope = e.scope AND t.id = e.target_id""",
    "raw_nodes raw_edges",
)
def edge_details(d: Data) -> DataFrame:
    """G7 for all relations"""
    edges = _rid_edges(d).withColumn("description", F.col("evidence"))
    details = graph_queries.edge_details(edges, d.view("raw_nodes"))
    return details.select(
        F.substr("rid", F.lit(2)).cast("long").alias("seq"),
        "type",
        "confidence",
        "weight",
        F.col("source.name").alias("source_name"),
        F.col("source.type").alias("source_type"),
        F.col("target.name").alias("target_name"),
        F.col("target.type").alias("target_type"),
    )


TRAILS = """scoped AS (SELECT 'r' || seq AS rid, source_id, target_id FROM raw_edges WHERE scope = 'section:S1'),
    arcs AS (SELECT rid, source_id AS a, target_id AS b FROM scoped UNION SELECT rid, target_id, source_id FROM scoped),
    l1 AS (SELECT [rid] AS rids, ['p1', b] AS ids FROM arcs WHERE a = 'p1'),
    l2 AS (SELECT list_append(rids, rid) AS rids, list_append(ids, b) AS ids FROM l1 JOIN arcs ON a = ids[2]
           WHERE NOT list_contains(rids, rid)),
    l3 AS (SELECT list_append(rids, rid) AS rids, list_append(ids, b) AS ids FROM l2 JOIN arcs ON a = ids[3]
           WHERE NOT list_contains(rids, rid)),
    trails AS (SELECT 1 AS len, * FROM l1 UNION ALL SELECT 2, * FROM l2 UNION ALL SELECT 3, * FROM l3),
    top AS (SELECT * FROM trails ORDER BY len, rids, ids LIMIT 60)"""


@query(
    f"""WITH {TRAILS}
        SELECT 'node' AS kind, n.id AS what, n.id = 'p1' AS is_center FROM raw_nodes n WHERE n.scope = 'section:S1'
               AND n.id IN (SELECT ids[-1] FROM top UNION SELECT 'p1')
        UNION ALL SELECT 'edge', rid, NULL FROM (SELECT DISTINCT unnest(rids) AS rid FROM top) x""",
    "raw_nodes raw_edges",
)
def k_hop(d: Data) -> DataFrame:
    """The first 60 trails of up to 3 relations around one node in one scope"""
    g = graph_queries.k_hop(d.view("raw_nodes"), _rid_edges(d), "p1", 3, 60, "section:S1")
    return g.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("what"), "is_center").unionByName(
        g.edges.select(F.lit("edge").alias("kind"), F.col("rid").alias("what")), allowMissingColumns=True
    )


@query(
    f"""WITH {TRAILS} SELECT len AS length, count(*) AS trails, count(DISTINCT ids[-1]) AS ends FROM trails WHERE len <= 2
        GROUP BY 1""",
    "raw_edges",
)
def all_trails(d: Data) -> DataFrame:
    """G8 without limit"""
    edges = clean.scope_filter(_rid_edges(d), "section:S1")
    center = clean.scope_filter(d.view("raw_nodes"), "section:S1").where("id = 'p1'").select(F.col("id").alias("center"))
    trails = graph_queries.all_trails(edges, center, 2)
    return trails.groupBy("length").agg(
        F.count(F.lit(1)).alias("trails"), F.count_distinct(F.element_at("node_ids", -1)).alias("ends")
    )


@query(
    """WITH arcs AS (SELECT 'r' || seq AS rid, source_id AS a, target_id AS b FROM raw_edges
                     UNION SELECT 'r' || seq, target_id, source_id FROM raw_edges),
        ents AS (SELECT id FROM raw_nodes WHERE id IN (SELECT node_id FROM mentions WHERE chunk_id = 'o11') ORDER BY id LIMIT 30),
        top AS (SELECT id AS center, rid, b FROM ents JOIN arcs ON a = id ORDER BY center, rid, b LIMIT 20)
        SELECT 'entity' AS kind, id AS center, NULL AS path FROM ents
        UNION ALL SELECT 'path', center, rid || '>' || center || '~' || b FROM top""",
    "raw_nodes raw_edges mentions",
)
def chunk_entities(d: Data) -> DataFrame:
    """A chunk whose entities have relations enough to fill the path limit with single relations"""
    found = graph_queries.chunk_entities("o11", d.view("mentions"), d.view("raw_nodes"), _rid_edges(d))
    path = F.concat(F.array_join("rids", "~"), F.lit(">"), F.array_join("node_ids", "~"))
    return found.entities.select(F.lit("entity").alias("kind"), F.col("id").alias("center")).unionByName(
        found.paths.select(F.lit("path").alias("kind"), "center", path.alias("path")), allowMissingColumns=True
    )


@query(
    """SELECT id, name, type FROM raw_nodes WHERE (contains(lower(name), 'ring') OR
              len(list_filter(aliases, lambda a: contains(lower(a), 'ring'))) > 0) AND type IN ('PROMO', 'SMALL')
       ORDER BY CASE WHEN lower(name) = 'ring' THEN 1 ELSE 2 END, CASE WHEN starts_with(lower(name), 'ring') THEN 1 ELSE 2 END,
                name, id LIMIT 20""",
    "raw_nodes",
)
def search_nodes(d: Data) -> DataFrame:
    """G10, M1"""
    found = graph_queries.search_nodes(d.view("raw_nodes"), "Ring", types=["PROMO", "SMALL"])
    return found.select("id", "name", "type")


@query("SELECT seq, id, name FROM raw_nodes WHERE contains(lower(name), 'red') ORDER BY seq LIMIT 20", "raw_nodes")
def search_nodes_simple(d: Data) -> DataFrame:
    """G11"""
    return graph_queries.search_nodes_simple(d.view("raw_nodes"), "RED").select("seq", "id", "name")


@query(
    """SELECT 'section:S5' AS book_id, (SELECT count(*) FROM raw_nodes WHERE scope = 'section:S5') AS total_nodes,
              (SELECT count(*) FROM raw_edges WHERE scope = 'section:S5') AS total_edges,
              (SELECT string_agg(DISTINCT type, '~' ORDER BY type) FROM raw_nodes WHERE scope = 'section:S5') AS node_types,
              (SELECT string_agg(DISTINCT type, '~' ORDER BY type) FROM raw_edges WHERE scope = 'section:S5') AS edge_types""",
    "raw_nodes raw_edges",
)
def book_stats(d: Data) -> DataFrame:
    """H18"""
    stats = graph_queries.book_stats(d.view("raw_nodes"), _rid_edges(d), "section:S5")
    return stats.select("book_id", "total_nodes", "total_edges", joined("node_types"), joined("edge_types"))


# ------------------------------------------------------------- store mutations


def _stored_nodes(d: Data) -> DataFrame:
    past = F.lit("2020-01-01 00:00:00").cast("timestamp")
    return d.view("raw_nodes").select(
        "scope", "id", "name", "description", past.alias("created_at"), past.alias("updated_at"), "seq"
    )


STORED_NODES = "stored AS (SELECT scope, id, name, description, TIMESTAMP '2020-01-01' AS created_at, seq FROM raw_nodes)"


@query(
    f"""WITH {STORED_NODES}, latest AS (SELECT * FROM incoming_nodes QUALIFY row_number() OVER (PARTITION BY scope, id
            ORDER BY seq DESC) = 1), firsts AS (SELECT scope, id, arg_min(created_at, seq) AS created_at FROM incoming_nodes GROUP BY 1, 2)
        SELECT scope, id, CASE WHEN l.id IS NULL THEN s.name ELSE l.name END AS name,
               CASE WHEN l.id IS NULL THEN s.description ELSE l.description END AS description,
               epoch_us(coalesce(s.created_at, f.created_at)) AS created_us,
               epoch_us(coalesce(l.updated_at, TIMESTAMP '2020-01-01')) AS updated_us
        FROM stored s FULL JOIN latest l USING (scope, id) LEFT JOIN firsts f USING (scope, id)""",
    "raw_nodes incoming_nodes",
)
def upsert_nodes(d: Data) -> DataFrame:
    """B1 with scopes kept apart"""
    merged = store.upsert_nodes(_stored_nodes(d), d.view("incoming_nodes"), store.NODE_KEY)
    return merged.select("scope", "id", "name", "description", micros("created_at"), micros("updated_at"))


def _stored_edges(d: Data) -> DataFrame:
    stamped = store.stamp_section_scope(d.view("raw_edges"))
    return ordering.last_wins(stamped, ["scope", "rid"]).withColumn("updated_at", F.col("created_at"))


def _incoming_edges(d: Data) -> DataFrame:
    return store.stamp_section_scope(d.view("incoming_edges")).withColumn("updated_at", F.col("created_at"))


STORED_EDGES = f"""stored AS (SELECT scope, {d_rid("type", "source_id", "target_id", "scope")} AS rid, type, source_id, target_id,
        confidence, weight, evidence, src_section, seq FROM raw_edges
        QUALIFY row_number() OVER (PARTITION BY scope, rid ORDER BY seq DESC) = 1),
    arrived AS (SELECT scope, {d_rid("type", "source_id", "target_id", "scope")} AS rid, type, source_id, target_id, confidence, weight,
        src_section, seq FROM incoming_edges)"""
LAST_ARRIVED = """latest AS (SELECT * FROM arrived WHERE source_id IN (SELECT id FROM raw_nodes) AND target_id IN (SELECT id FROM raw_nodes)
    QUALIFY row_number() OVER (PARTITION BY scope, rid ORDER BY seq DESC) = 1)"""


@query(
    f"""WITH {STORED_EDGES}, {LAST_ARRIVED}
        SELECT scope, rid, coalesce(l.type, s.type) AS type, CASE WHEN l.rid IS NULL THEN s.confidence ELSE l.confidence END AS confidence,
               CASE WHEN l.rid IS NULL THEN s.weight ELSE l.weight END AS weight FROM stored s FULL JOIN latest l USING (scope, rid)""",
    "raw_nodes raw_edges incoming_edges",
)
def upsert_edges(d: Data) -> DataFrame:
    """B2"""
    merged = store.upsert_edges(_stored_edges(d), _incoming_edges(d), d.view("raw_nodes"))
    return merged.select("scope", "rid", "type", "confidence", "weight")


@query(
    f"""WITH {STORED_NODES}, news AS (SELECT scope, id, arg_max(name, seq) FILTER (name IS NOT NULL) AS name,
            arg_max(description, seq) FILTER (description IS NOT NULL) AS description,
            arg_max(created_at, seq) AS created_at FROM incoming_nodes GROUP BY 1, 2)
        SELECT scope, id, coalesce(n.name, s.name) AS name, coalesce(n.description, s.description) AS description,
               epoch_us(coalesce(n.created_at, s.created_at)) AS created_us,
               epoch_us(CASE WHEN n.id IS NULL THEN TIMESTAMP '2020-01-01' ELSE TIMESTAMP '2024-01-01' END) AS updated_us
        FROM stored s FULL JOIN news n USING (scope, id)""",
    "raw_nodes incoming_nodes",
)
def overlay_properties(d: Data) -> DataFrame:
    """B3"""
    merged = store.overlay_properties(_stored_nodes(d), d.view("incoming_nodes"), store.NODE_KEY, now())
    return merged.select("scope", "id", "name", "description", micros("created_at"), micros("updated_at"))


@query(
    """WITH k AS (SELECT DISTINCT scope, id FROM incoming_nodes WHERE (scope, id) NOT IN (SELECT (scope, id) FROM raw_nodes))
       SELECT (SELECT count(*) FROM k) AS created, (SELECT count(*) FROM incoming_nodes) - (SELECT count(*) FROM k) AS updated""",
    "raw_nodes incoming_nodes",
)
def upsert_stats(d: Data) -> DataFrame:
    """B4"""
    return store.upsert_stats(_stored_nodes(d), d.view("incoming_nodes"), store.NODE_KEY)


@query(
    """WITH touched AS (SELECT source_id AS id FROM incoming_edges WHERE scope <> 'section:S3' UNION
                        SELECT target_id FROM incoming_edges WHERE scope <> 'section:S3'),
        e AS (SELECT count(*) AS c FROM incoming_edges WHERE scope = 'section:S3'),
        n AS (SELECT count(*) AS c FROM raw_nodes WHERE scope = 'section:S3' AND id NOT IN (SELECT id FROM touched))
        SELECT e.c AS edges_deleted, n.c AS nodes_deleted, e.c + n.c AS deleted, (SELECT count(*) FROM raw_nodes) - n.c AS nodes_left,
               (SELECT count(*) FROM incoming_edges) - e.c AS edges_left FROM e, n""",
    "raw_nodes incoming_edges",
)
def delete_scope(d: Data) -> DataFrame:
    """B5"""
    return _deletion(store.delete_scope(d.view("raw_nodes"), d.view("incoming_edges"), "section:S3"))


def _deletion(result: store.Deleted) -> DataFrame:
    left = quality.graph_totals(result.nodes, result.edges)
    return result.deleted.select(
        "*",
        left.select("total_nodes").scalar().alias("nodes_left"),
        left.select("total_edges").scalar().alias("edges_left"),
    )


@query(
    """WITH e AS (SELECT count(*) AS c FROM raw_edges WHERE scope = 'section:S3'), n AS (SELECT count(*) AS c FROM raw_nodes
        WHERE scope = 'section:S3')
        SELECT e.c AS edges_deleted, n.c AS nodes_deleted, e.c + n.c AS deleted, (SELECT count(*) FROM raw_nodes) - n.c AS nodes_left,
               (SELECT count(*) FROM raw_edges) - e.c AS edges_left FROM e, n""",
    "raw_nodes raw_edges",
)
def delete_scope_hard(d: Data) -> DataFrame:
    """B6"""
    return _deletion(store.delete_scope_hard(d.view("raw_nodes"), d.view("raw_edges"), "section:S3"))


@query(
    """SELECT 'scope' AS rule, count(*) FILTER (scope = 'section:S3') AS edges_deleted, count(*) FILTER (scope <> 'section:S3') AS edges_left
       FROM raw_edges UNION ALL
       SELECT 'src', count(*) FILTER (src_section = 'S4'), count(*) FILTER (src_section <> 'S4') FROM raw_edges""",
    "raw_edges",
)
def delete_edges(d: Data) -> DataFrame:
    """B7, B8"""
    edges = d.view("raw_edges")

    def row(rule: str, result: tuple[DataFrame, DataFrame]) -> DataFrame:
        left, deleted = result
        count = left.agg(F.count(F.lit(1)).alias("n")).scalar()
        return deleted.select(F.lit(rule).alias("rule"), "edges_deleted", count.alias("edges_left"))

    return row("scope", store.delete_edges_by_scope(edges, "section:S3")).unionByName(
        row("src", store.delete_edges_by_src(edges, "S4"))
    )


@query(
    f"""WITH {STORED_EDGES}, {LAST_ARRIVED}
        SELECT scope, rid, type, source_id, target_id FROM latest UNION ALL
        SELECT scope, rid, type, source_id, target_id FROM stored WHERE scope NOT IN (SELECT scope FROM arrived)""",
    "raw_nodes raw_edges incoming_edges",
)
def replace_section_graph(d: Data) -> DataFrame:
    """Relations after five sections were replaced"""
    return _replaced(d).edges.select("scope", "rid", "type", "source_id", "target_id")


def _replaced(d: Data) -> store.Replaced:
    arrived = d.view("incoming_edges").withColumn("updated_at", F.col("created_at"))
    nodes = d.view("raw_nodes").select(
        "scope", "id", F.upper("name").alias("name"), "description", now().alias("created_at"),
        now().alias("updated_at"), "seq", F.col("subchapter").alias("src_section"),
    )
    sections = arrived.select("src_section").distinct()
    return store.replace_section_graph(
        _stored_nodes(d), _stored_edges(d), nodes.join(sections, "src_section", "left_semi"), arrived, now()
    )


@query(
    f"""WITH {STORED_EDGES}, a AS (SELECT src_section, count(*) AS w FROM incoming_edges GROUP BY 1),
        o AS (SELECT src_section, count(*) AS c FROM stored GROUP BY 1), n AS (SELECT subchapter AS src_section, count(*) AS c
        FROM raw_nodes GROUP BY 1)
        SELECT src_section, true AS success, n.c AS nodes_written, a.w AS edges_written, o.c AS edges_deleted
        FROM a JOIN n USING (src_section) JOIN o USING (src_section)""",
    "raw_nodes raw_edges incoming_edges",
)
def replace_section_stats(d: Data) -> DataFrame:
    """Statistics per section"""
    return _replaced(d).stats


@query(
    f"""WITH {STORED_EDGES},
        p AS (SELECT {d_rid("type", "source_id", "target_id", "'book:parts'")} AS rid, type, source_id, target_id, confidence, weight, seq
              FROM stored WHERE src_section IN (SELECT src_section FROM incoming_edges)
              QUALIFY row_number() OVER (PARTITION BY rid ORDER BY seq DESC) = 1)
        SELECT rid, type, source_id, target_id, confidence, weight, 'book:parts' AS scope FROM p""",
    "raw_edges incoming_edges",
)
def promote_to_book(d: Data) -> DataFrame:
    """B10"""
    sections = d.view("incoming_edges").select(F.col("src_section").alias("section_id"))
    promoted = store.promote_to_book(_stored_edges(d), sections, BOOK)
    return promoted.select("rid", "type", "source_id", "target_id", "confidence", "weight", "scope")


@query("SELECT p_type AS type, p_name AS id, count(*) AS rows FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def check_unique(d: Data) -> DataFrame:
    """B11"""
    return store.check_unique(d.table("part").select(F.col("p_type").alias("type"), F.col("p_name").alias("id")))


# ------------------------------------------------------------------- ordering


@query(
    """SELECT 'first' AS rule, source_id, type, min(seq) AS seq FROM raw_edges GROUP BY 2, 3
       UNION ALL SELECT 'last', source_id, type, max(seq) FROM raw_edges GROUP BY 2, 3""",
    "raw_edges",
)
def first_and_last_wins(d: Data) -> DataFrame:
    """L1, N1"""
    edges, keys = d.view("raw_edges").select("source_id", "type", "seq"), ["source_id", "type"]
    first = ordering.first_wins(edges, keys).select(F.lit("first").alias("rule"), *keys, "seq")
    last = ordering.last_wins(edges, keys).select(F.lit("last").alias("rule"), *keys, "seq")
    return first.unionByName(last)


@query(
    "SELECT seq, ((row_number() OVER (ORDER BY ts, seq) - 1) % 12)::INT AS slot FROM call_events",
    "call_events",
)
def round_robin(d: Data) -> DataFrame:
    """L4"""
    return ordering.round_robin(d.view("call_events").select("seq", "ts"), 12, ["ts", "seq"]).select("seq", "slot")
