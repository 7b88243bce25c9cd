"""Section outputs to a stored, measured book graph. All sections run in one plan; ``section_id`` is a column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import clean, extract, identity, quality
from ..operators.ordering import first_wins
from ..session import cut_lineage, cut_unsized, dealt


@dataclass(frozen=True)
class SectionGraphs:
    nodes: DataFrame
    edges: DataFrame
    sections: DataFrame
    rejects: DataFrame


def build_section_graphs(outputs: DataFrame, now: Column, theta_add: float = clean.THETA_ADD) -> SectionGraphs:
    """Extract, normalise, identify and threshold the graphs of all sections.

    ``outputs``: seq, topic, chapter, subchapter, language, raw (model markdown). Several outputs of one section are
    separate graphs of the same section. A malformed output yields no graph and is listed in ``rejects``. The outputs are
    read and judged once, in even shares.
    """
    keyed = outputs.withColumn("section_id", ids.section_id("topic", "chapter", "subchapter")).withColumn(
        "scope", ids.book_scope("topic", "language")
    )
    judged = cut_unsized(dealt(keyed).withColumn("_fault", extract.output_fault()))
    keyed, usable = judged.drop("_fault"), judged.where("_fault IS NULL").drop("_fault")
    rejects = extract.malformed_outputs(judged.where("_fault IS NOT NULL").drop("_fault"))
    raw_nodes = _positioned(extract.extract_nodes(usable)).withColumns(
        {"created_at": now, "updated_at": now}
    )
    raw_edges = _positioned(extract.extract_edges(usable)).withColumns(
        {"src_section": F.col("section_id"), "created_at": now}
    )
    nodes, edges = identity.assign_idempotent_ids(
        clean.normalize_nodes(raw_nodes), clean.normalize_edges(raw_edges), ["section_id", "seq_output"]
    )
    hierarchies = extract.extract_hierarchy(
        keyed.select("seq", "section_id", "scope", "topic", "chapter", "subchapter", "raw")
    )
    sections = first_wins(hierarchies, ["section_id"])
    return SectionGraphs(nodes, clean.filter_storage(edges, theta_add), sections, rejects)


def _positioned(rows: DataFrame) -> DataFrame:
    """Arrival order of a row: its output, then its line."""
    return rows.withColumn("seq_output", F.col("seq")).withColumn("seq", F.struct("seq", "pos")).drop("pos")


def section_insights(graphs: SectionGraphs, keywords: DataFrame) -> DataFrame:
    """Quality measures per section. ``keywords``: section_id, keyword.

    The measures read the graph many times, so it is built once and checkpointed.
    """
    nodes = cut_lineage(graphs.nodes.withColumn("scope", F.col("section_id")))
    edges = cut_lineage(graphs.edges.withColumn("scope", F.col("section_id")))
    outline = graphs.sections.select(F.col("section_id").alias("scope"), "chapter", "subchapter")
    words = cut_unsized(keywords.select(F.col("section_id").alias("scope"), "keyword"))
    measured = quality.evaluate_graph(nodes, edges, outline, words)
    return measured.withColumnRenamed("scope", "section_id")
