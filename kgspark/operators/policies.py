"""Rules on requests, sections and relations: filters, pages, conflicts, budgets, rubrics, keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .clean import drop_dangling

# Limits, codes and weights of the content rules.
CORE_NODES, CORE_WEIGHT = 20, 0.7
SECTION_TOKENS, BOOK_TOKENS, QA_PAIRS = 2000, 50000, 8
TOPIC_TOO_SHORT, TOPIC_TOO_LONG, INVALID_LANGUAGE, CHAPTER_COUNT_OUT_OF_RANGE, CONTENT_TOO_LONG = 4001, 4002, 4003, 4004, 4005
LANGUAGES = ("中文", "English", "Français", "Deutsch", "日本語")
TOPIC_CHARACTERS = r"^[\x{4e00}-\x{9fa5}a-zA-Z0-9\s\-_]+$"
RUBRIC = {  # dimension: (weight, least score)
    "content_completeness": (0.3, 7.0),
    "technical_accuracy": (0.4, 8.0),
    "logical_coherence": (0.2, 6.0),
    "language_expression": (0.1, 6.0),
}
REWRITE_BELOW, REVISE_BELOW = 5.0, 7.0
REWRITE, REVISE = "强制重写", "针对性修订"
SYNONYMS = {"机器学习": "ml", "深度学习": "dl", "人工智能": "ai"}


def filter_graph(
    nodes: DataFrame,
    edges: DataFrame,
    node_types: Sequence[str] | None = None,
    rel_types: Sequence[str] | None = None,
    min_weight: float | None = None,
    by: Sequence[str] = ("scope",),
) -> tuple[DataFrame, DataFrame]:
    """Nodes and relations of the given types and weight; relations need both their nodes within ``by``."""
    if node_types is not None:
        nodes = nodes.where(F.col("type").isin(*node_types))
    if rel_types is not None:
        edges = edges.where(F.col("type").isin(*rel_types))
    if min_weight is not None:
        edges = edges.where(F.col("weight") >= min_weight)
    return nodes, drop_dangling(edges, nodes, list(by))


def paginate(df: DataFrame, key: Sequence[str], limit: int, after: Sequence | None = None) -> DataFrame:
    """The next ``limit`` rows in the order of ``key`` behind the row with the values ``after``; keys are not null.

    A page starts from a key instead of an offset, so that no page has to pass over the ones before it.
    """
    if after is not None:
        names = F.struct(*[F.col(c) for c in key])
        df = df.where(names > F.struct(*[F.lit(v).alias(c) for c, v in zip(key, after, strict=True)]))
    return df.orderBy(*key).limit(limit)


def core_nodes(
    nodes: DataFrame, edges: DataFrame, limit: int | None = CORE_NODES, min_weight: float = CORE_WEIGHT
) -> DataFrame:
    """The nodes of a scope with most relations of at least ``min_weight``: ``scope, id, relations, rank``.

    Ties go to the smaller id; nodes without such relations are no core nodes. ``limit=None`` ranks them all.
    """
    strong = edges.where(F.col("weight") >= min_weight)
    ends = strong.select("scope", F.col("source_id").alias("id")).unionByName(
        strong.select("scope", F.col("target_id").alias("id"))
    )
    degrees = ends.groupBy("scope", "id").agg(F.count(F.lit(1)).alias("relations"))
    known = degrees.join(nodes.select("scope", "id"), ["scope", "id"], "left_semi")
    ranked = known.withColumn(
        "rank", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("relations"), "id"))
    )
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def resolve_conflicts(edges: DataFrame, key: Sequence[str] = ("source_id", "target_id", "type")) -> DataFrame:
    """One relation per key: the newest, then the surest, then a book's before a section's, then the first to arrive."""
    from_book = F.startswith(F.coalesce("scope", F.lit("")), F.lit("book:"))
    order = [F.desc_nulls_last("created_at"), F.desc_nulls_last("confidence"), F.desc(from_book), F.asc("seq")]
    ranked = edges.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def budget_check(
    sections: DataFrame, section_tokens: int = SECTION_TOKENS, book_tokens: int = BOOK_TOKENS, qa_pairs: int = QA_PAIRS
) -> DataFrame:
    """Overruns of every section and the volume of its book that it falls into; nothing is cut or dropped.

    ``sections``: book_id, chapter_pos, subchapter_pos, tokens, qa_count; null counts are 0. A new volume begins with the
    section before which the book has ``book_tokens`` more. Chapters are summed first, so that only their sums are
    ordered within a book, and sections only within a chapter.
    """
    tokens = F.coalesce("tokens", F.lit(0)).cast("long")
    chapters = sections.groupBy("book_id", "chapter_pos").agg(F.sum(tokens).alias("_chapter"))
    before = Window.partitionBy("book_id").orderBy("chapter_pos").rowsBetween(Window.unboundedPreceding, -1)
    starts = chapters.select(
        "book_id", "chapter_pos", F.coalesce(F.sum("_chapter").over(before), F.lit(0)).alias("_start")
    )
    inside = (
        Window.partitionBy("book_id", "chapter_pos").orderBy("subchapter_pos").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = sections.withColumn("_inside", F.coalesce(F.sum(tokens).over(inside), F.lit(0))).join(
        starts, ["book_id", "chapter_pos"]
    )
    return placed.withColumns(
        {
            "volume": F.floor((F.col("_start") + F.col("_inside")) / book_tokens) + 1,
            "section_over": F.greatest(tokens - section_tokens, F.lit(0)),
            "qa_over": F.greatest(F.coalesce("qa_count", F.lit(0)).cast("long") - qa_pairs, F.lit(0)),
        }
    ).drop("_start", "_inside")


def validate_topics(requests: DataFrame, max_content: int | None = None) -> DataFrame:
    """Error codes of run requests (topic, language, chapter_count, content_length), empty for a valid one.

    ``topic_allowed`` tells whether the topic has allowed characters only, for which there is no code. A null language is
    the default one; ``max_content`` is the caller's bound of the content.
    """
    length = F.length(t.or_empty("topic"))
    language = F.coalesce("language", F.lit(LANGUAGES[0]))
    codes = [
        F.when(length < 2, TOPIC_TOO_SHORT),
        F.when(length > 200, TOPIC_TOO_LONG),
        F.when(~language.isin(*LANGUAGES), INVALID_LANGUAGE),
        F.when(~F.coalesce(F.col("chapter_count").between(1, 20), F.lit(False)), CHAPTER_COUNT_OUT_OF_RANGE),
    ]
    if max_content is not None:
        codes.append(F.when(F.col("content_length") > max_content, CONTENT_TOO_LONG))
    return requests.withColumns(
        {
            "error_codes": F.array_compact(F.array(*codes)),
            "topic_allowed": F.rlike(t.or_empty("topic"), F.lit(TOPIC_CHARACTERS)),
        }
    )


def rubric_score(scores: DataFrame) -> DataFrame:
    """Weighted score, whether each dimension reaches its minimum, and what revision the score asks for.

    ``scores`` has a column for each dimension of ``RUBRIC``; a missing score counts as 0.
    """
    given = {name: F.coalesce(name, F.lit(0.0)) for name in RUBRIC}
    total, passed = F.lit(0.0), F.lit(True)
    for name, (weight, least) in RUBRIC.items():
        total = total + weight * given[name]
        passed = passed & (given[name] >= least)
    total = F.round(total, 6)
    revision = F.when(total < REWRITE_BELOW, REWRITE).when(total < REVISE_BELOW, REVISE)
    return scores.withColumns({"rubric_score": total, "rubric_passed": passed, "revision": revision})


def concept_key(concept: Column | str, synonyms: Mapping[str, str] | None = None) -> Column:
    """Short hash of a concept: lower case, letters, digits and underscores only, synonyms mapped."""
    plain = F.regexp_replace(F.lower(t.or_empty(concept)), r"[^\p{L}\p{N}_]", "")
    known = SYNONYMS if synonyms is None else synonyms
    if known:
        table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
        plain = F.coalesce(F.try_element_at(table, plain), plain)
    return F.substring(F.md5(plain), 1, 8)
