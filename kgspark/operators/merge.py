"""Merging section graphs: book merge (name and type) and display merge (canonical key, evidence-aware edges)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..session import cut_lineage
from .clean import drop_dangling
from .containment import containing
from .ordering import first_wins

# Fixed values of the display merge.
LONG_EVIDENCE = 20
SMALLEST_SHARE = 1074  # 2 to the minus 1074 is the least positive double
EVIDENCE_JOIN = "; "
FEW_TEXTS, FEW_CHARS = 50, 100_000  # texts of a key that are compared in one row, and their characters
DISPLAY_HIERARCHY = "合并后的知识图谱"

ARRIVAL = ("seq",)


def _order(columns: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in columns])


def _longest_first(description: str, order: Sequence[str]) -> Column:
    """Longest description; the earliest of equally long ones."""
    text = t.or_empty(description)
    return F.min_by(text, F.struct((-F.length(text)).alias("shortness"), *[F.col(c) for c in order]))


def alias_union(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sorted distinct aliases per key. Duplicates are removed before anything is gathered per key."""
    return (
        rows.select(*keys, F.explode("aliases").alias("_alias"))
        .where("_alias IS NOT NULL")
        .distinct()
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("_alias")).alias("_aliases"))
    )


# ---------------------------------------------------------------- book merge


def keyed_by_name(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("_name", t.normalize_name("name")).withColumn("_type", t.or_empty("type"))


def merge_groups(keyed: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per key ``_rows``, the first node as ``_base`` and the longest ``_description``; combined before the shuffle."""
    return keyed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min_by(F.struct(*columns), _order(order)).alias("_base"),
        _longest_first("description", order).alias("_description"),
    )


def merge_nodes(nodes: DataFrame, book_id: str, order: Sequence[str] = ARRIVAL) -> DataFrame:
    """One node per normalised name and type: the first node's fields, the longest description, all aliases.

    A node that merges with nothing keeps its aliases as they are.
    """
    keyed = keyed_by_name(nodes)
    keys = ["_name", "_type"]
    merged = merge_groups(keyed, keys, nodes.columns, order).join(alias_union(keyed, keys), keys, "left")
    alone = F.col("_rows") == 1
    replaced = {
        "description": F.when(alone, F.col("_base.description")).otherwise(F.col("_description")),
        "aliases": F.when(alone, F.col("_base.aliases")).otherwise(
            F.coalesce("_aliases", F.array().cast("array<string>"))
        ),
        "scope": F.lit(book_id),
    }
    return merged.select(*[replaced.get(c, F.col(f"_base.{c}")).alias(c) for c in _with(nodes.columns, "scope")])


def _with(columns: list[str], *extra: str) -> list[str]:
    return columns + [c for c in extra if c not in columns]


def merged_node_ids(nodes: DataFrame, order: Sequence[str] = ARRIVAL) -> DataFrame:
    """``id`` of every node and ``merged_id`` of the node it merges into."""
    keyed = keyed_by_name(nodes)
    kept = keyed.groupBy("_name", "_type").agg(F.min_by("id", _order(order)).alias("merged_id"))
    mapped = keyed.select("_name", "_type", "id", *order).join(kept, ["_name", "_type"])
    return first_wins(mapped, ["id"], order).select("id", "merged_id")


def merge_edges(
    edges: DataFrame, merged_nodes: DataFrame, book_id: str, order: Sequence[str] = ARRIVAL
) -> DataFrame:
    """Edges between merged nodes, the first per source, target and type; the source section stays on record."""
    kept = drop_dangling(edges, merged_nodes.select("id").distinct())
    return first_wins(kept, ["source_id", "target_id", "type"], order).withColumn("scope", F.lit(book_id))


@dataclass(frozen=True)
class Book:
    nodes: DataFrame
    edges: DataFrame
    hierarchy: DataFrame


def merge_book(
    nodes: DataFrame,
    edges: DataFrame,
    sections: DataFrame,
    book_id: str,
    topic: str,
    order: Sequence[str] = ARRIVAL,
    remap_edges: bool = False,
) -> Book:
    """Merge section graphs into a book graph.

    Edges of a node that was merged away are dropped; with ``remap_edges`` they follow it to the kept node.
    """
    merged = merge_nodes(nodes, book_id, order)
    if remap_edges:
        mapping = merged_node_ids(nodes, order)
        for end in ("source_id", "target_id"):
            edges = (
                edges.join(mapping.withColumnRenamed("id", end), end).drop(end).withColumnRenamed("merged_id", end)
            )
    return Book(
        merged, merge_edges(edges, merged, book_id, order), book_hierarchy(sections, book_id, topic)
    )


def merge_incremental(
    book_nodes: DataFrame,
    book_edges: DataFrame,
    new_nodes: DataFrame,
    new_edges: DataFrame,
    sections: DataFrame,
    book_id: str,
    topic: str,
) -> Book:
    """Merge new section graphs into a book; what the book already has comes first."""

    def aged(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)), allowMissingColumns=True)

    book = merge_book(
        aged(book_nodes, new_nodes), aged(book_edges, new_edges), sections, book_id, topic, order=("_age", "seq")
    )
    return Book(book.nodes.drop("_age"), book.edges.drop("_age"), book.hierarchy)


def book_hierarchy(sections: DataFrame, book_id: str, topic: str) -> DataFrame:
    """One row: the three-line description of the book with its sorted chapters; empty text without chapters."""
    chapters = sections.select("chapter").where("chapter IS NOT NULL").distinct()
    listed = chapters.agg(F.array_sort(F.collect_list("chapter")).alias("chapters_covered"))
    count = F.size("chapters_covered")
    text = F.concat_ws(
        "\n",
        F.lit(f"Book: {topic} (ID: {book_id})"),
        F.concat(F.lit("Chapters: "), F.array_join("chapters_covered", ", ")),
        F.concat(F.lit("Total Chapters: "), count.cast("string")),
    )
    return listed.select(
        F.lit(book_id).alias("book_id"),
        "chapters_covered",
        F.when(count == 0, F.lit("")).otherwise(text).alias("hierarchy"),
    )


def merge_stats(nodes: DataFrame, edges: DataFrame, sections: DataFrame, book: Book) -> DataFrame:
    """Counts before and after a merge and the share of rows removed, to three decimals."""

    def tag(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("part"))

    chapters = sections.select("chapter").where("chapter IS NOT NULL").distinct()
    parts = {
        "original_sections": sections,
        "original_nodes": nodes,
        "original_edges": edges,
        "merged_nodes": book.nodes,
        "merged_edges": book.edges,
        "chapters_covered": chapters,
    }
    rows = None
    for name, df in parts.items():
        rows = tag(df, name) if rows is None else rows.unionByName(tag(df, name))
    counts = rows.agg(*[F.count_if(F.col("part") == name).alias(name) for name in parts])

    def ratio(before: str, after: str) -> Column:
        share = (F.col(before) - F.col(after)) / F.nullif(F.col(before), F.lit(0)).cast("double")
        return t.exact_round(F.coalesce(share, F.lit(0.0)), 3)

    return counts.withColumn("node_dedup_ratio", ratio("original_nodes", "merged_nodes")).withColumn(
        "edge_dedup_ratio", ratio("original_edges", "merged_edges")
    )


# ------------------------------------------------------------- display merge


def _completed(df: DataFrame, **kinds: str) -> DataFrame:
    return df.withColumns({name: F.lit(None).cast(kind) for name, kind in kinds.items() if name not in df.columns})


def merge_nodes_display(nodes: DataFrame, order: Sequence[str] = ARRIVAL) -> DataFrame:
    """Concepts merge by canonical key (else name): alias union, longest description, best score, latest update.

    Other nodes are kept once per id (else name), the first row wins. Rows without a key are dropped. Stored columns that
    ``nodes`` lacks, as freshly built graphs do, are added as NULL.
    """
    nodes = _completed(nodes, canonical_key="string", score="double", updated_at="timestamp")
    concept = t.or_empty("type") == "concept"
    key = F.when(concept, F.coalesce("canonical_key", "name")).otherwise(F.coalesce("id", "name"))
    keyed = nodes.withColumn("_concept", concept).withColumn("_key", key).where("_key <> ''")
    keys = ["_concept", "_key"]
    groups = keyed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min_by(F.struct(*nodes.columns), _order(order)).alias("_base"),
        _longest_first("description", order).alias("_description"),
        F.max(F.coalesce("score", F.lit(0.0))).alias("_score"),
        F.max_by("updated_at", F.when(F.col("updated_at").isNotNull(), _order(order))).alias("_updated"),
    )
    merged = groups.join(alias_union(keyed.where("_concept"), keys), keys, "left")
    combine = F.col("_concept") & (F.col("_rows") > 1)
    values = {
        "description": F.col("_description"),
        "aliases": F.coalesce("_aliases", F.array().cast("array<string>")),
        "score": F.col("_score"),
        "updated_at": F.col("_updated"),
    }
    return merged.select(
        *[
            F.when(combine, values[c]).otherwise(F.col(f"_base.{c}")).alias(c) if c in values else F.col(f"_base.{c}")
            for c in nodes.columns
        ]
    )


def display_edge_key(source: str = "source_id", target: str = "target_id") -> Column:
    """Merge key of the display: long evidence keeps relations apart, short evidence does not."""
    plain = F.concat(F.col(source), F.lit("->"), F.col(target), F.lit(":"), F.col("type"))
    evidence = t.or_empty("evidence")
    hashed = F.concat(plain, F.lit(":"), F.substring(F.md5(evidence), 1, 8))
    return F.when(F.length(evidence) > LONG_EVIDENCE, hashed).otherwise(plain)


def merge_edges_display(edges: DataFrame) -> DataFrame:
    """Merge relations of equal display key; ``seq`` may be of any type that has an order.

    Weight is the running pairwise mean in arrival order, confidence the maximum, evidence the ordered join of texts
    not yet contained. All but the weight comes from aggregates over key and text, which are combined before the
    shuffle. In the mean, the row of rank r from the end has the share 2^-r: that is zero in double precision beyond
    rank ``SMALLEST_SHARE``, so nearer ranks alone decide it and a hot key sends only those of each input partition.
    Stored columns that ``edges`` lacks are added as NULL.
    """
    edges = _completed(edges, evidence="string", confidence="double", weight="double", updated_at="timestamp")
    usable = edges.where(
        (t.or_empty("source_id") != "") & (t.or_empty("target_id") != "") & (t.or_empty("type") != "")
    )
    keyed = usable.withColumn("_key", display_edge_key())
    updated_seq = F.when(F.col("updated_at").isNotNull(), F.col("seq"))
    texts = keyed.groupBy("_key", t.or_empty("evidence").alias("_text")).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min("seq").alias("_seen"),
        F.min_by(F.struct(*edges.columns), "seq").alias("_base"),
        F.max(F.coalesce("confidence", F.lit(0.0))).alias("_confidence"),
        F.max_by("updated_at", updated_seq).alias("_updated"),
        F.max(updated_seq).alias("_updated_seq"),
    )
    merged = texts.groupBy("_key").agg(
        F.sum("_rows").alias("_rows"),
        F.min_by("_base", "_seen").alias("_base"),
        F.max("_confidence").alias("_confidence"),
        F.max_by("_updated", "_updated_seq").alias("_updated"),
        F.array_sort(F.collect_list(F.struct("_seen", "_text"))).alias("_texts"),
    )
    from_end = F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("seq")))
    share = F.coalesce("weight", F.lit(1.0)) * F.pow(F.lit(2.0), -F.col("_from_end"))
    shares = (
        keyed.select("_key", "seq", "weight")
        .withColumn("_from_end", from_end)
        .where(F.col("_from_end") <= SMALLEST_SHARE)
        .groupBy("_key")
        .agg(F.sum(share).alias("_share"))
    )
    single = F.col("_rows") == 1
    first_weight = F.coalesce("_base.weight", F.lit(1.0))
    values = {
        "weight": F.when(single, F.col("_base.weight")).otherwise(
            first_weight * F.pow(F.lit(2.0), -F.col("_rows")) + F.col("_share")
        ),
        "confidence": F.when(single, F.col("_base.confidence")).otherwise(F.col("_confidence")),
        "evidence": F.when(single, F.col("_base.evidence")).otherwise(_joined("_texts")),
        "updated_at": F.col("_updated"),
    }
    return merged.join(shares, "_key").select(
        *[values.get(c, F.col(f"_base.{c}")).alias(c) for c in edges.columns]
    )


def _joined(texts: str) -> Column:
    """Evidence texts in order of their first sight, without those that the text so far contains."""

    def append(acc: Column, item: Column) -> Column:
        text = item["_text"]
        return (
            F.when((text == "") | F.contains(acc, text), acc)
            .when(acc == "", text)
            .otherwise(F.concat(acc, F.lit(EVIDENCE_JOIN), text))
        )

    return F.aggregate(texts, F.lit(""), append)


def display_evidence(edges: DataFrame) -> DataFrame:
    """The evidence texts of a display key as rows: ``edge_key, text, rows, seen`` (the first ``seq``).

    The list that ``merge_edges_display`` joins, for keys whose texts should not meet in one row.
    """
    return edges.groupBy(display_edge_key().alias("edge_key"), t.or_empty("evidence").alias("text")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("seq").alias("seen")
    )


def folded_evidence(edges: DataFrame) -> DataFrame:
    """``edge_key, text, seen``: the evidence texts of a display key that no earlier text of the key contains, as rows.

    What ``merge_edges_display`` joins, in order of ``seen``, without meeting in one row: a key of more than
    ``FEW_TEXTS`` texts is spread, its texts find those that they are part of on their rarest characters. The texts of
    all other keys are compared within their key. (The joined string also swallows a text that only its own separators
    make up.)
    """
    texts = cut_lineage(display_evidence(edges).where("text <> ''").select("edge_key", "text", "seen"))
    counts = texts.groupBy("edge_key").agg(F.count(F.lit(1)).alias("_texts"), F.sum(F.length("text")).alias("_chars"))
    large = (F.col("_texts") > FEW_TEXTS) | (F.col("_chars") > FEW_CHARS) & (F.col("_texts") > 1)
    crowded = cut_lineage(counts.where(large & F.col("edge_key").isNotNull()).select("edge_key"))
    keyless = texts.where("edge_key IS NULL")  # of no relation, so no text is an earlier one's
    few = texts.where("edge_key IS NOT NULL").join(crowded, "edge_key", "left_anti").groupBy("edge_key").agg(
        F.collect_list(F.struct("text", "seen")).alias("_all")
    )
    shown = F.filter(
        "_all",
        lambda own: ~F.exists(
            "_all",
            lambda other: F.coalesce(other["seen"] < own["seen"], F.lit(False))
            & (other["text"] != own["text"])
            & F.contains(other["text"], own["text"]),
        ),
    )
    kept = few.select("edge_key", F.explode(shown).alias("_shown")).select("edge_key", "_shown.text", "_shown.seen")
    kept = kept.unionByName(keyless)
    if crowded.isEmpty():
        return kept
    return kept.unionByName(_folded_apart(texts.join(crowded, "edge_key", "left_semi")))


def _folded_apart(texts: DataFrame) -> DataFrame:
    """``folded_evidence`` of ``edge_key, text, seen`` with the texts of a key in many tasks."""
    within = containing(texts, texts.select("edge_key", F.col("text").alias("name")), ["edge_key"]).where("text <> name")
    earlier = texts.select("edge_key", "text", F.col("seen").alias("text_seen"))
    named = texts.select("edge_key", F.col("text").alias("name"), F.col("seen").alias("name_seen"))
    lost = within.join(earlier, ["edge_key", "text"]).join(named, ["edge_key", "name"]).where("text_seen < name_seen")
    return texts.join(lost.select("edge_key", F.col("name").alias("text")).distinct(), ["edge_key", "text"], "left_anti")


@dataclass(frozen=True)
class DisplayGraph:
    nodes: DataFrame
    edges: DataFrame
    summary: DataFrame


def merge_graphs_display(nodes: DataFrame, edges: DataFrame, sections: DataFrame) -> DisplayGraph:
    """Display merge of many graphs with totals and the union of chapters."""
    merged_nodes = merge_nodes_display(nodes)
    merged_edges = merge_edges_display(edges)
    chapters = sections.select("chapter").where("chapter IS NOT NULL").distinct()
    rows = (
        merged_nodes.select(F.lit("node").alias("kind"), F.lit(None).cast("string").alias("chapter"))
        .unionByName(merged_edges.select(F.lit("edge").alias("kind"), F.lit(None).cast("string").alias("chapter")))
        .unionByName(chapters.select(F.lit("chapter").alias("kind"), "chapter"))
    )
    summary = rows.agg(
        F.count_if(F.col("kind") == "node").alias("total_nodes"),
        F.count_if(F.col("kind") == "edge").alias("total_edges"),
        F.array_sort(F.collect_list("chapter")).alias("chapters_covered"),
    ).withColumn("hierarchy", F.lit(DISPLAY_HIERARCHY))
    return DisplayGraph(merged_nodes, merged_edges, summary)
