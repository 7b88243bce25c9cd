"""Model output to tables: graph markdown, outline JSON, research notes, review reports, question blocks, progress lines.

All parsing is row-wise (split, explode, regular expressions; a small function for nested lines), so no shuffle happens here.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as t

# Headings of the model outputs, defaults and limits.
NODES_HEADING = "### 节点"
EDGES_HEADING = "### 关系"
HIERARCHY_HEADING = "### 层次结构"
KEYWORDS_HEADING = "## 子章节关键词"
SUMMARY_HEADING = "## 子章节研究总结"
CONCEPTS_HEADING = "## 关键概念"
QUESTION_HEADING = "### Q"
FEEDBACK_HEADING = "### 改进建议："
EDGE_DESCRIPTION = "从文本中抽取的关系: %s -> %s"
DEFAULT_CONFIDENCE = 0.8
DEFAULT_WEIGHT = 1.0
DEFAULT_RELATION = "RELATED_TO"
DEFAULT_SCORE = 5.0
PASS_THRESHOLD = 7.0
MIN_SUBCHAPTER_OUTLINE = 30

# Patterns of the review reports.
NUMBER = r"(\d+(?:\.\d+)?)"
LABELLED_SCORE = f"(?i)(?:总体评分|总评分|评分){t.WS}*[:：]?{t.WS}*{NUMBER}{t.WS}*/{t.WS}*10"
ANY_SCORE = f"{NUMBER}{t.WS}*/{t.WS}*10"
VERDICT = f"是否通过{t.WS}*[:：]?{t.WS}*([是否])"
REWRITE = f"(?s)重写建议{t.WS}*[:：]?{t.WS}*(.+?)(?=\\n{t.WS}*##|\\n###|\\z)"
STRICT_SCORE = f"### 总体评分：{NUMBER}/10"
STRICT_VERDICT = "### 是否通过：(是|否)"

OUTLINE_JSON = (
    "chapters ARRAY<STRUCT<title: STRING, outline: STRING, "
    "subchapters: ARRAY<STRUCT<title: STRING, outline: STRING>>>>, _bad STRING"
)


@dataclass(frozen=True)
class Parsed:
    """Accepted rows and the rejected inputs with a ``reason``."""

    rows: DataFrame
    rejects: DataFrame


def _once(df: DataFrame, keep: list[str], **values: Column) -> DataFrame:
    """Add expensive values through a one-element generator, which keeps the optimizer from repeating them per use."""
    row = F.struct(*[value.alias(name) for name, value in values.items()])
    return df.select(*keep, F.explode(F.array(row)).alias("_row")).select(*keep, "_row.*")


def _bullets(outputs: DataFrame, heading: str, keep: list[str]) -> DataFrame:
    """One row per ``- …`` line of the block below ``heading``: ``pos`` and the text after the dash."""
    block = t.between_markers("raw", heading, "###")
    return (
        outputs.select(*keep, F.posexplode(F.split(block, "\n")).alias("pos", "line"))
        .withColumn("line", t.strip("line"))
        .where(F.startswith("line", F.lit("- ")))
        .withColumn("line", F.substr("line", F.lit(3)))
    )


def _context(outputs: DataFrame) -> list[str]:
    return [c for c in outputs.columns if c != "raw"]


def extract_nodes(outputs: DataFrame) -> DataFrame:
    """Concept nodes of the node block. Input: ``raw``, ``topic``, ``chapter``, ``subchapter``, ``seq`` and any keys."""
    keep = _context(outputs)
    return (
        _bullets(outputs, NODES_HEADING, keep)
        .where(F.contains("line", F.lit(":")))
        .withColumn("name", t.strip(t.before_first(F.col("line"), ":")))
        .withColumn("description", t.strip(t.after_first(F.col("line"), ":")))
        .withColumn("id", ids.concept_id("name", "topic", "chapter", "subchapter"))
        .withColumn("type", F.lit("concept"))
        .withColumn("aliases", F.array().cast("array<string>"))
        .drop("line")
    )


def _edge_lines(outputs: DataFrame, keep: list[str]) -> DataFrame:
    lines = _bullets(outputs, EDGES_HEADING, keep).where(
        F.contains("line", F.lit(":")) & F.contains("line", F.lit("->"))
    )
    return lines.withColumn("ends", t.before_first(F.col("line"), ":"))


def extract_edges(outputs: DataFrame) -> DataFrame:
    """Relations of the relation block, written ``source -> target: type``."""
    keep = _context(outputs)
    return (
        _edge_lines(outputs, keep)
        .where(F.contains("ends", F.lit("->")))
        .withColumn("source_name", t.strip(t.before_first(F.col("ends"), "->")))
        .withColumn("target_name", t.strip(t.after_first(F.col("ends"), "->")))
        .withColumn("type", F.upper(t.strip(t.after_first(F.col("line"), ":"))))
        .withColumn("source_id", ids.concept_id("source_name", "topic", "chapter", "subchapter"))
        .withColumn("target_id", ids.concept_id("target_name", "topic", "chapter", "subchapter"))
        .withColumn("description", F.format_string(EDGE_DESCRIPTION, "source_name", "target_name"))
        .withColumn("confidence", F.lit(DEFAULT_CONFIDENCE))
        .withColumn("weight", F.lit(DEFAULT_WEIGHT))
        .drop("line", "ends")
    )


def output_fault() -> Column:
    """Why an output (column ``raw``) yields no graph at all, or NULL.

    An output is useless when it is blank or when a relation line has its arrow only after the colon.
    """
    bad = F.exists(
        F.transform(F.split(t.between_markers("raw", EDGES_HEADING, "###"), "\n"), t.strip),
        lambda line: F.startswith(line, F.lit("- "))
        & F.contains(line, F.lit(":"))
        & F.contains(line, F.lit("->"))
        & ~F.contains(t.before_first(F.substr(line, F.lit(3)), ":"), F.lit("->")),
    )
    return F.when(t.is_blank("raw"), "empty_output").when(bad, "bad_relation_line")


def malformed_outputs(outputs: DataFrame) -> DataFrame:
    """The outputs that yield no graph, with the ``reason``."""
    return outputs.select(*_context(outputs), output_fault().alias("reason")).where("reason IS NOT NULL")


def extract_hierarchy(outputs: DataFrame) -> DataFrame:
    """The stripped text of the hierarchy block, empty when there is none."""
    block = t.strip(t.or_empty(t.after_marker("raw", HIERARCHY_HEADING)))
    return outputs.select(*_context(outputs), block.alias("hierarchy"))


def extract_levels(outputs: DataFrame) -> DataFrame:
    """One row for each line of the hierarchy block with text: ``line``, ``level``, ``title`` and the ``parent`` line.

    Lines count from 1. A line belongs to the nearest line above it that is indented less (a tab counts as four
    spaces); without one it is at level 1 and has no parent. A bullet is not part of the title.
    """
    keep = _context(outputs)
    block = t.or_empty(t.after_marker("raw", HIERARCHY_HEADING))

    @F.pandas_udf("array<struct<line: int, level: int, title: string, parent: int>>")
    def nested(blocks: pd.Series) -> pd.Series:
        def rows(block: str) -> list[dict]:
            out, above = [], []  # above: indent and line of the open levels
            for text in block.split("\n"):
                bare = text.strip()
                if not bare:
                    continue
                indent = len((lead := text[: len(text) - len(text.lstrip())]).replace("\t", "")) + 4 * lead.count("\t")
                while above and above[-1][0] >= indent:
                    above.pop()
                out.append(
                    {
                        "line": len(out) + 1,
                        "level": len(above) + 1,
                        "title": bare[1:].strip() if bare[0] in "-*+" else bare,
                        "parent": above[-1][1] if above else None,
                    }
                )
                above.append((indent, len(out)))
            return out

        return blocks.map(rows)

    return outputs.select(*keep, F.explode(nested(block)).alias("_row")).select(*keep, "_row.*")


def standardize_nodes(raw_nodes: DataFrame, now: Column) -> DataFrame:
    """String casts and defaults for raw nodes; ``scope`` falls back to ``topic``, a bad time stamp to ``now``."""
    created = _timestamp("created_at", now)
    return raw_nodes.select(
        t.or_empty(F.col("id").cast("string")).alias("id"),
        t.or_empty(F.col("name").cast("string")).alias("name"),
        F.coalesce(F.col("type").cast("string"), F.lit(ids.DEFAULT_NODE_TYPE)).alias("type"),
        t.or_empty(F.col("description").cast("string")).alias("description"),
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
        _scope().alias("scope"),
        created.alias("created_at"),
        created.alias("updated_at"),
        "seq",
    )


def standardize_edges(raw_edges: DataFrame, now: Column) -> DataFrame:
    """String casts and defaults for raw relations; the relation id stays empty until ids are assigned."""
    return raw_edges.select(
        F.lit("").alias("rid"),
        F.coalesce(F.col("type").cast("string"), F.lit(DEFAULT_RELATION)).alias("type"),
        t.or_empty(F.col("source_id").cast("string")).alias("source_id"),
        t.or_empty(F.col("target_id").cast("string")).alias("target_id"),
        t.or_empty(F.col("description").cast("string")).alias("description"),
        F.coalesce(F.col("confidence").cast("double"), F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
        F.coalesce(F.col("weight").cast("double"), F.lit(DEFAULT_WEIGHT)).alias("weight"),
        _scope().alias("scope"),
        t.or_empty("src_section").alias("src_section"),
        _timestamp("created_at", now).alias("created_at"),
        "seq",
    )


def _scope() -> Column:
    return F.when(t.or_empty("scope") != "", F.col("scope")).otherwise(t.or_empty("topic"))


def _timestamp(name: str, now: Column) -> Column:
    given = t.or_empty(F.col(name).cast("string"))
    return F.when(given != "", F.coalesce(F.try_to_timestamp(given), now))


def extract_outline(outputs: DataFrame) -> Parsed:
    """Book outlines from fenced or bare JSON. One fault rejects the whole outline.

    ``rows`` has one row per subchapter with its positions; ``rejects`` has ``reason`` and the faulty ``title``.
    """
    keep = _context(outputs)
    text = t.strip(t.or_empty("raw"))
    fenced_json = F.regexp_extract(text, f"(?is)```json{t.WS}*(\\{{.*?\\}}){t.WS}*```", 1)
    fenced = F.regexp_extract(text, f"(?s)```{t.WS}*(\\{{.*?\\}}){t.WS}*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    candidate = F.coalesce(F.nullif(fenced_json, F.lit("")), F.nullif(fenced, F.lit("")), F.nullif(braces, F.lit("")))
    found = _once(outputs, keep, _json=candidate)
    document = F.from_json("_json", OUTLINE_JSON, {"columnNameOfCorruptRecord": "_bad"})
    parsed = _once(found, [*keep, "_json"], _doc=document)
    chapters = F.transform(
        F.col("_doc.chapters"),
        lambda c: F.struct(
            t.strip(t.or_empty(c["title"])).alias("title"),
            t.strip(t.or_empty(c["outline"])).alias("outline"),
            F.transform(
                F.coalesce(c["subchapters"], F.array().cast("array<struct<title:string,outline:string>>")),
                lambda s: F.struct(
                    t.strip(t.or_empty(s["title"])).alias("title"), t.strip(t.or_empty(s["outline"])).alias("outline")
                ),
            ).alias("subchapters"),
        ),
    )
    trimmed = _once(parsed, [*keep, "_json", "_doc"], _chapters=chapters)
    checked = _once(trimmed, [*keep, "_chapters"], _fault=_outline_fault())
    rows = (
        checked.where("_fault IS NULL")
        .select(*keep, F.posexplode("_chapters").alias("chapter_pos", "_ch"))
        .select(
            *keep,
            "chapter_pos",
            F.col("_ch.title").alias("chapter"),
            F.col("_ch.outline").alias("chapter_outline"),
            F.posexplode("_ch.subchapters").alias("subchapter_pos", "_sub"),
        )
        .select(
            *keep,
            "chapter_pos",
            "chapter",
            "chapter_outline",
            "subchapter_pos",
            F.col("_sub.title").alias("subchapter"),
            F.col("_sub.outline").alias("outline"),
        )
    )
    rejects = checked.where("_fault IS NOT NULL").select(*keep, "_fault.reason", "_fault.title")
    return Parsed(rows, rejects)


def _outline_fault() -> Column:
    """First fault of an outline in reading order, or NULL."""

    def fault(reason: str, title: Column | None = None) -> Column:
        return F.struct(F.lit(reason).alias("reason"), (F.lit("") if title is None else title).alias("title"))

    def of_subchapter(s: Column) -> Column:
        return F.when(s["title"] == "", fault("subchapter_without_title")).when(
            F.length(s["outline"]) < MIN_SUBCHAPTER_OUTLINE, fault("subchapter_outline_too_short", s["title"])
        )

    def of_chapter(c: Column) -> Column:
        subs = c["subchapters"]
        return (
            F.when(c["title"] == "", fault("chapter_without_title"))
            .when(c["outline"] == "", fault("chapter_without_outline", c["title"]))
            .when(F.size(subs) == 0, fault("chapter_without_subchapters", c["title"]))
            .otherwise(F.get(F.filter(F.transform(subs, of_subchapter), lambda f: f.isNotNull()), F.lit(0)))
        )

    first = F.get(F.filter(F.transform("_chapters", of_chapter), lambda f: f.isNotNull()), F.lit(0))
    return (
        F.when(F.col("_json").isNull(), fault("no_json"))
        .when(F.col("_doc._bad").isNotNull(), fault("bad_json"))
        .when(F.coalesce(F.size("_doc.chapters"), F.lit(0)) <= 0, fault("no_chapters"))
        .otherwise(first)
    )


def outline_to_sections(chapters: DataFrame) -> DataFrame:
    """Flatten ``chapters`` (array of title, outline, subchapters); a chapter without subchapters is its own section."""
    keep = [c for c in chapters.columns if c != "chapters"]
    exploded = chapters.select(*keep, F.posexplode("chapters").alias("chapter_pos", "_ch"))
    title = t.strip(t.or_empty("_ch.title"))
    subs = exploded.select(
        *keep,
        "chapter_pos",
        title.alias("chapter"),
        t.or_empty("_ch.outline").alias("chapter_outline"),
        F.posexplode_outer("_ch.subchapters").alias("subchapter_pos", "_sub"),
    )
    alone = F.col("subchapter_pos").isNull()
    return subs.select(
        *keep,
        "chapter_pos",
        "chapter",
        "chapter_outline",
        F.coalesce("subchapter_pos", F.lit(0)).alias("subchapter_pos"),
        F.when(alone, F.col("chapter")).otherwise(t.strip(t.or_empty("_sub.title"))).alias("subchapter"),
        F.when(alone, F.col("chapter_outline")).otherwise(t.or_empty("_sub.outline")).alias("outline"),
    )


def extract_research(outputs: DataFrame) -> DataFrame:
    """Keywords, summary and key concepts of research notes."""

    def first_line_list(heading: str) -> Column:
        line = t.before_first(t.strip(t.between_markers("raw", heading, "##")), "\n")
        items = F.filter(F.transform(F.split(line, ","), t.strip), lambda k: k != "")
        return F.coalesce(items, F.array().cast("array<string>"))

    return outputs.select(
        *_context(outputs),
        first_line_list(KEYWORDS_HEADING).alias("keywords"),
        t.strip(t.or_empty(t.between_markers("raw", SUMMARY_HEADING, "##"))).alias("summary"),
        first_line_list(CONCEPTS_HEADING).alias("key_concepts"),
    )


def extract_validation(reports: DataFrame, threshold: float = PASS_THRESHOLD) -> DataFrame:
    """Score, verdict and rewrite text of review reports; ``is_passed`` is the score rule, which is final."""
    text = t.or_empty("report")
    number = F.coalesce(
        F.nullif(F.regexp_extract(text, LABELLED_SCORE, 1), F.lit("")),
        F.nullif(F.regexp_extract(text, ANY_SCORE, 1), F.lit("")),
    )
    score = F.coalesce(number.cast("double"), F.lit(DEFAULT_SCORE))
    verdict = F.regexp_extract(text, VERDICT, 1)
    blank = t.is_blank("report")
    return (
        reports.withColumn("score", F.when(blank, F.lit(DEFAULT_SCORE)).otherwise(score))
        .withColumn(
            "verdict_passed",
            F.when(blank, False).when(verdict != "", verdict == "是").otherwise(F.col("score") >= threshold),
        )
        .withColumn("is_passed", F.col("score") >= threshold)
        .withColumn("rewrite_suggestions", t.strip(F.regexp_extract(text, REWRITE, 1)))
    )


def extract_validation_strict(reports: DataFrame) -> DataFrame:
    """The exact-heading reading of a report: score 0 and not passed unless stated."""
    text = t.or_empty("report")
    number = F.nullif(F.regexp_extract(text, STRICT_SCORE, 1), F.lit(""))
    feedback = t.before_first(t.after_marker(text, FEEDBACK_HEADING), "###")
    return (
        reports.withColumn("score", F.coalesce(number.cast("double"), F.lit(0.0)))
        .withColumn("is_passed", F.regexp_extract(text, STRICT_VERDICT, 1) == "是")
        .withColumn("feedback", t.strip(t.or_empty(feedback)))
    )


def qa_count(text: Column | str) -> Column:
    """Number of question headings."""
    return F.size(F.split(t.or_empty(text), QUESTION_HEADING)) - 1


def extract_qa(outputs: DataFrame) -> DataFrame:
    """One row per question: number, question, answer, level, kind, keywords."""
    block = F.concat(F.lit("Q"), F.col("_block"))

    def field(label: str) -> Column:
        return t.strip(F.regexp_extract(block, f"(?s)\\*\\*{label}[:：]\\*\\*(.*?)(?=\\n\\*\\*|\\z)", 1))

    pieces = F.split(t.or_empty("raw"), QUESTION_HEADING)
    return (
        outputs.select(*_context(outputs), F.posexplode(pieces).alias("pos", "_block"))
        .where("pos > 0")
        .withColumn("question", t.strip(F.regexp_extract(block, r"^Q\d*[:：]?([^\n]*)", 1)))
        .withColumn("answer", field("A"))
        .withColumn("level", field("难度"))
        .withColumn("kind", field("类型"))
        .withColumn("keywords", field("关键词"))
        .drop("_block")
    )


def extract_progress(events: DataFrame) -> DataFrame:
    """Progress lines ``[progress] <event> | {json}``: event name, stage and payload; other lines are dropped."""
    pattern = r"(?s)^\[progress\] (\S+) \| (\{.*\})$"
    return (
        events.where(F.startswith("message", F.lit("[progress] ")))
        .withColumn("event", F.regexp_extract("message", pattern, 1))
        .where("event <> ''")
        .withColumn("payload", F.regexp_extract("message", pattern, 2))
        .withColumn("stage", F.get_json_object("payload", "$.stage"))
    )
