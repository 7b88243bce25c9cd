"""Section-level tables: selection, keywords, attempts, question coverage, bindings, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..session import cut_lineage
from .extract import PASS_THRESHOLD
from .ordering import distinct_in_order, first_wins

DEFAULT_LOCALE = "zh"
BINDING_KEYS = ["target_type", "target_id", "locale"]
MAX_REWRITES = 1


def select_passed(sections: DataFrame, validation: DataFrame, content: DataFrame) -> DataFrame:
    """Sections whose review passed and whose text is not empty, with the text."""
    passed = validation.where("is_passed").select("section_id").distinct()
    texts = content.where("content <> ''").select("section_id", "content")
    return sections.drop("content").join(passed, "section_id", "left_semi").join(texts, "section_id")


def missing_qa(validation: DataFrame, qa: DataFrame) -> DataFrame:
    """Passed sections without a question row."""
    return validation.where("is_passed").join(qa.select("section_id").distinct(), "section_id", "left_anti")


def combine_qa(qa_content: DataFrame, qa_metadata: DataFrame) -> DataFrame:
    """One row per section found on either side; the absent side is empty."""
    return qa_content.join(qa_metadata, "section_id", "full").select(
        "section_id",
        t.or_empty("qa_text").alias("qa_text"),
        F.coalesce("qa_count", F.lit(0)).alias("qa_count"),
    )


def first_bindings(bindings: DataFrame) -> DataFrame:
    """The binding that counts for a target and locale: the first by position."""
    return first_wins(bindings, BINDING_KEYS, ("position",)).drop("position")


def localized(requests: DataFrame) -> DataFrame:
    return requests.withColumn("locale", F.coalesce("locale", F.lit(DEFAULT_LOCALE)))


def resolve_bindings(requests: DataFrame, bindings: DataFrame) -> DataFrame:
    """The first binding per target and locale; ``resolved`` tells requests without one."""
    first = cut_lineage(first_bindings(bindings).withColumn("_found", F.lit(True)))  # so that a crowded target is split
    return (
        localized(requests).join(first, BINDING_KEYS, "left")
        .withColumn("resolved", F.coalesce("_found", F.lit(False)))
        .drop("_found")
    )


def resolve_attempts(
    attempts: DataFrame, max_rewrites: int = MAX_REWRITES, threshold: float = PASS_THRESHOLD
) -> DataFrame:
    """The first attempt (counted from 0) that passes, else the last one made within ``max_rewrites`` rewrites.

    Which attempt counts is found on the numbers alone; the texts join only once.
    """
    made = attempts.where(F.col("attempt") <= max_rewrites)
    passed = F.when(F.col("score") >= threshold, F.col("attempt"))
    chosen = made.groupBy("section_id").agg(F.coalesce(F.min(passed), F.max("attempt")).alias("attempt"))
    return made.join(chosen, ["section_id", "attempt"]).withColumn("is_passed", F.col("score") >= threshold)


def pass_rollup(validation: DataFrame) -> DataFrame:
    return validation.agg(
        F.count(F.lit(1)).alias("total_subchapters"),
        F.count_if(F.coalesce("is_passed", F.lit(False))).alias("passed_subchapters"),
    )


def store_rollup(stats: DataFrame) -> DataFrame:
    """Totals over the per-section write statistics."""

    def total(name: str):
        return F.coalesce(F.sum(name), F.lit(0))

    processed = F.count(F.lit(1))
    succeeded = F.count_if("success")
    return stats.agg(
        processed.alias("total_subchapters_processed"),
        succeeded.alias("successful_writes"),
        total("nodes_written").alias("total_nodes_written"),
        total("edges_written").alias("total_edges_written"),
        total("edges_deleted").alias("total_edges_deleted"),
        F.coalesce(succeeded / F.nullif(processed, F.lit(0)), F.lit(0.0)).alias("success_rate"),
    )


def keywords_by_section(sections: DataFrame) -> DataFrame:
    """Trimmed non-blank keywords of every section, one row each, with their position."""
    return (
        sections.select(
            "topic",
            "chapter_pos",
            "chapter",
            "subchapter_pos",
            "subchapter",
            F.posexplode("keywords").alias("keyword_pos", "keyword"),
        )
        .withColumn("keyword", t.strip("keyword"))
        .where("keyword <> ''")
    )


def keywords_by_chapter(sections: DataFrame) -> DataFrame:
    """Keywords of every chapter, one row each, ordered by the two positions.

    A chapter without keywords has its title as the only one. Rows rather than one array per chapter, so that a huge
    chapter stays spread over tasks.
    """
    own = keywords_by_section(sections).select(
        "topic", "chapter_pos", "chapter", "subchapter_pos", "keyword_pos", "keyword"
    )
    chapters = sections.select("topic", "chapter_pos", "chapter").distinct()
    bare = chapters.join(own.select("topic", "chapter_pos").distinct(), ["topic", "chapter_pos"], "left_anti")
    title = t.strip(t.or_empty("chapter"))
    fallback = bare.where(title != "").select(
        "topic",
        "chapter_pos",
        "chapter",
        F.lit(0).alias("subchapter_pos"),
        F.lit(0).alias("keyword_pos"),
        title.alias("keyword"),
    )
    return own.unionByName(fallback)


def global_keywords(keywords: DataFrame, order: list[str]) -> DataFrame:
    """Distinct keywords per topic by canonical form; the first spelling is kept, with its place in ``order``."""
    keyed = keywords.withColumn("canonical", t.canonical_keyword("keyword")).where("canonical <> ''")
    position = F.struct(*order)
    return keyed.groupBy("topic", "canonical").agg(
        F.min_by(t.strip("keyword"), position).alias("keyword"), F.min(position).alias("first_seen")
    )


def ordered_section_ids(sections: DataFrame) -> DataFrame:
    """Distinct section ids with the order of their first sight."""
    return distinct_in_order(sections, ["section_id"])


def run_metadata(runs: DataFrame) -> DataFrame:
    """Book metadata per run with the number of its sections."""
    return runs.select(
        "run_id",
        "status",
        "created_at",
        "updated_at",
        "workflow_id",
        "workflow_params",
        "processing_stats",
        "chapter_count",
        F.coalesce(F.size(F.coalesce("section_ids", F.array().cast("array<string>"))), F.lit(0)).alias(
            "section_count"
        ),
    )
