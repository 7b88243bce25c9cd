"""Documents assembled from tables: books, quizzes, prompt batches.

A document is an ordered table of blocks (``doc_id, chapter_pos, subchapter_pos, kind, text``), whatever its size. ``assemble``
gives every block the text it has in the document, so that writing the blocks in order writes the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import status
from ..functions import text as t
from .hot_keys import join_crowded
from .sections import BINDING_KEYS, first_bindings, localized, resolve_bindings

# Texts of the assembled documents.
CHAPTER_TITLE = "章节"
SECTION_TITLE = "小节"
GUIDE = "_导学：%s_"
MISSING_BODY = "> [内容缺失]"
QA_HEADING = "\n### 问答"
APPENDIX_HEADING = "# 附录：知识图谱概览"
APPENDIX_NODES = "- 图节点数：%d"
APPENDIX_EDGES = "- 图边数量：%d"
REWRITE_NOTE = "重写建议：%s\n\n请根据以上重写建议进行改进。"
NO_KEYWORDS = "无"
QUIZ_TITLE = "# %s - 问答题目"
QUIZ_TOPIC = "问答题目"
UNKNOWN_TYPE = "未知"

# Request defaults.
TEMPERATURE, MAX_TOKENS, TOP_P, FREQUENCY_PENALTY, PRESENCE_PENALTY, TIMEOUT = 0.7, 1500, 0.9, 0.0, 0.0, 300

PARAGRAPH = "\n\n"
NO_BINDING, NO_TEMPLATE = "no binding", "no template"

CHAPTER, SECTION, APPENDIX = 0, 1, 2


def _given(c: str) -> Column:
    return F.nullif(t.or_empty(c), F.lit(""))


def book_blocks(
    chapters: DataFrame, sections: DataFrame, content: DataFrame, qa: DataFrame, insights: DataFrame | None = None
) -> DataFrame:
    """Blocks of every book.

    ``chapters``: doc_id, chapter_pos, chapter, outline. ``sections``: doc_id, chapter_pos, subchapter_pos, section_id,
    subchapter, outline. ``content``: section_id, content. ``qa``: section_id, qa_text. ``insights``: doc_id,
    kg_summary, total_nodes, total_edges.
    """
    heads = chapters.select(
        "doc_id",
        "chapter_pos",
        F.lit(-1).alias("subchapter_pos"),
        F.lit(CHAPTER).alias("kind"),
        F.concat_ws(
            PARAGRAPH,
            F.concat(F.lit("# "), F.coalesce(_given("chapter"), F.lit(CHAPTER_TITLE))),
            F.concat(F.lit("> "), _given("outline")),
        ).alias("text"),
    )
    placed = sections.select("doc_id", "chapter_pos", "subchapter_pos", "section_id", "subchapter", "outline")
    joined = placed.join(content.select("section_id", "content"), "section_id", "left").join(
        qa.select("section_id", "qa_text"), "section_id", "left"
    )
    guide = F.nullif(t.strip(t.or_empty("outline")), F.lit(""))
    body = F.nullif(t.strip(t.or_empty("content")), F.lit(""))
    questions = F.nullif(t.strip(t.or_empty("qa_text")), F.lit(""))
    bodies = joined.select(
        "doc_id",
        "chapter_pos",
        "subchapter_pos",
        F.lit(SECTION).alias("kind"),
        F.concat_ws(
            PARAGRAPH,
            F.concat(F.lit("## "), F.coalesce(_given("subchapter"), F.lit(SECTION_TITLE))),
            F.when(guide.isNotNull(), F.format_string(GUIDE, guide)),
            F.coalesce(body, F.lit(MISSING_BODY)),
            F.when(questions.isNotNull(), F.lit(QA_HEADING)),
            questions,
        ).alias("text"),
    )
    blocks = heads.unionByName(bodies)
    if insights is None:
        return blocks
    known = F.col("total_nodes").isNotNull() & F.col("total_edges").isNotNull()
    appendix = insights.where(_given("kg_summary").isNotNull() | known).select(
        "doc_id",
        F.lit(2**31 - 1).alias("chapter_pos"),
        F.lit(0).alias("subchapter_pos"),
        F.lit(APPENDIX).alias("kind"),
        F.concat_ws(
            PARAGRAPH,
            F.lit(APPENDIX_HEADING),
            _given("kg_summary"),
            F.when(known, F.format_string(APPENDIX_NODES, "total_nodes")),
            F.when(known, F.format_string(APPENDIX_EDGES, "total_edges")),
        ).alias("text"),
    )
    return blocks.unionByName(appendix)


def assemble(blocks: DataFrame, separator: str = PARAGRAPH) -> DataFrame:
    """One row per block: its ``content`` ends with the separator unless it is the last block of its document.

    Concatenating ``content`` in the order of ``chapter_pos, subchapter_pos, kind``, which tell the blocks of a document
    apart, gives the document. The last position is a partial-aggregated maximum, so no document is ever gathered.
    """
    position = F.struct("chapter_pos", "subchapter_pos", "kind")
    last = blocks.groupBy("doc_id").agg(F.max(position).alias("_last"))
    is_last = position == F.col("_last")
    return blocks.join(last, "doc_id").select(
        "doc_id",
        "chapter_pos",
        "subchapter_pos",
        "kind",
        F.when(is_last, F.col("text")).otherwise(F.concat("text", F.lit(separator))).alias("content"),
        is_last.alias("is_last"),
    )


def assemble_book(blocks: DataFrame) -> DataFrame:
    """Blocks of whole books without white space at their end; a book starts with a heading, so its front needs no strip."""
    placed = assemble(blocks, PARAGRAPH)
    return placed.withColumn("content", F.when(F.col("is_last"), t.rstrip("content")).otherwise(F.col("content")))


def quiz_blocks(quizzes: DataFrame, questions: DataFrame) -> DataFrame:
    """Blocks of quiz documents; ``pos`` is the number of a question within its quiz.

    ``quizzes``: doc_id, topic, difficulty, language. ``questions``: doc_id, pos, type, question, options,
    correct_answer, explanation, sample_answer, keywords, answer.
    """
    counts = questions.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_questions"))
    head = F.array_join(
        F.array(
            F.format_string(QUIZ_TITLE, F.coalesce("topic", F.lit(QUIZ_TOPIC))),
            F.lit(""),
            F.concat(F.lit("**总计题目数量**: "), F.coalesce("_questions", F.lit(0)).cast("string")),
            F.concat(F.lit("**难度级别**: "), F.coalesce("difficulty", F.lit("medium"))),
            F.concat(F.lit("**生成语言**: "), F.coalesce("language", F.lit("zh"))),
            F.lit(""),
            F.lit("---"),
            F.lit(""),
        ),
        "\n",
    )
    heads = quizzes.join(counts, "doc_id", "left").select(
        "doc_id",
        F.lit(-1).cast("long").alias("chapter_pos"),
        F.lit(0).alias("subchapter_pos"),
        F.lit(CHAPTER).alias("kind"),
        head.alias("text"),
    )

    def line(label: str, name: str) -> Column:
        return F.concat(F.lit(f"**{label}**: "), _given(name))

    options = F.transform(
        F.coalesce("options", F.array().cast("array<string>")),
        lambda o, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), o),
    )
    choice = F.concat(
        options,
        F.array(F.concat(F.lit("**正确答案**: "), t.or_empty("correct_answer")), line("解释", "explanation")),
    )
    words = F.coalesce("keywords", F.array().cast("array<string>"))
    short = F.array(
        line("参考答案", "sample_answer"),
        F.when(F.size(words) > 0, F.concat(F.lit("**关键词**: "), F.array_join(words, ", "))),
    )
    answer = (
        F.when(F.col("type") == "multiple_choice", choice)
        .when(F.col("type") == "short_answer", short)
        .otherwise(F.array(line("答案", "answer")))
    )
    lines = F.concat(
        F.array(
            F.format_string("## 题目 %d", F.col("pos").cast("long")),
            F.lit(""),
            F.concat(F.lit("**类型**: "), F.coalesce("type", F.lit(UNKNOWN_TYPE))),
            F.concat(F.lit("**题目**: "), t.or_empty("question")),
        ),
        F.array_compact(answer),
        F.array(F.lit(""), F.lit("---"), F.lit("")),
    )
    bodies = questions.select(
        "doc_id",
        F.col("pos").cast("long").alias("chapter_pos"),
        F.lit(0).alias("subchapter_pos"),
        F.lit(SECTION).alias("kind"),
        F.array_join(lines, "\n").alias("text"),
    )
    return heads.unionByName(bodies)


def format_quiz(quizzes: DataFrame, questions: DataFrame) -> DataFrame:
    return assemble(quiz_blocks(quizzes, questions), "\n")


def rewrite_instructions(suggestions: Column | str) -> Column:
    """Instruction text for a rewrite; empty without suggestions."""
    given = F.nullif(t.or_empty(suggestions), F.lit(""))
    return F.when(given.isNotNull(), F.format_string(REWRITE_NOTE, given)).otherwise(F.lit(""))


def keywords_text(keywords: Column | str) -> Column:
    """Keywords as they enter a prompt."""
    words = F.coalesce(t.col(keywords), F.array().cast("array<string>"))
    return F.when(F.size(words) == 0, F.lit(NO_KEYWORDS)).otherwise(F.array_join(words, ", "))


PLACEHOLDER = r"\{\{\s*(\w+)\s*\}\}"


def _escaped(value: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        value = F.replace(value, F.lit(raw), F.lit(entity))
    return value


def fill_placeholders(template: Column, values: Column, escape: bool = True) -> Column:
    """Replace every ``{{ name }}`` by its value in one pass (values are not scanned again); unknown names are empty."""
    source = F.regexp_replace(template, "\\n\\z", "")
    literals = F.split(source, PLACEHOLDER)
    names = F.regexp_extract_all(source, F.lit(PLACEHOLDER), F.lit(1))

    def value(name: Column) -> Column:
        found = t.or_empty(F.try_element_at(values, name))
        return _escaped(found) if escape else found

    pieces = F.zip_with(
        literals, names, lambda text, name: F.concat(text, F.when(name.isNull(), F.lit("")).otherwise(value(name)))
    )
    return F.array_join(pieces, "")


def prompt_batch(
    requests: DataFrame,
    bindings: DataFrame,
    templates: DataFrame,
    default_provider: str,
    default_model: str,
    escape: bool = True,
) -> DataFrame:
    """One filled model request per row of ``requests`` that has a binding.

    ``requests``: request_id, target_type, target_id, locale, values (map). ``bindings``: target_type, target_id,
    locale, prompt_file, model_ref, params (map), position. ``templates``: prompt_file, pos, role, content, meta (map).
    Binding parameters overlay the template's; missing ones take the request defaults. Requests without a binding or
    without a template are listed by ``prompt_rejects``.
    """
    prompts = templates.groupBy("prompt_file").agg(
        F.array_sort(F.collect_list(F.struct("pos", "role", "content"))).alias("_messages"),
        F.max_by("meta", "pos").alias("_meta"),
    )
    # bindings meet their templates before the requests, whose texts then travel once and are split by a crowded target
    bound = first_bindings(bindings).join(prompts, "prompt_file")
    resolved = join_crowded(localized(requests), bound, BINDING_KEYS)
    empty = F.create_map().cast("map<string,string>")
    params = F.coalesce("params", empty)
    overlaid = F.map_concat(
        F.map_filter(F.coalesce("_meta", empty), lambda k, _: ~F.array_contains(F.map_keys(params), k)), params
    )
    model = status.split_model_ref("model_ref", default_provider, default_model)
    messages = F.transform(
        "_messages",
        lambda m: F.struct(
            m["role"].alias("role"), fill_placeholders(m["content"], F.col("values"), escape).alias("content")
        ),
    )

    def setting(name: str, default: float, kind: str) -> Column:
        return F.coalesce(F.try_element_at("_all", F.lit(name)).cast(kind), F.lit(default).cast(kind)).alias(name)

    return (
        resolved.withColumn("_all", overlaid)
        .withColumn("_model", model)
        .select(
            "request_id",
            "target_id",
            "locale",
            "prompt_file",
            "_model.provider",
            "_model.model",
            messages.alias("messages"),
            setting("temperature", TEMPERATURE, "double"),
            setting("max_tokens", MAX_TOKENS, "int"),
            setting("top_p", TOP_P, "double"),
            setting("frequency_penalty", FREQUENCY_PENALTY, "double"),
            setting("presence_penalty", PRESENCE_PENALTY, "double"),
            F.lit(TIMEOUT).alias("timeout"),
        )
    )


def prompt_rejects(requests: DataFrame, bindings: DataFrame, templates: DataFrame) -> DataFrame:
    """The requests that ``prompt_batch`` cannot fill, with the reason: no binding, or a binding without its template."""
    known = templates.select("prompt_file").distinct().withColumn("_template", F.lit(True))
    found = resolve_bindings(requests, bindings).join(known, "prompt_file", "left")
    reason = F.when(~F.col("resolved"), NO_BINDING).when(F.col("_template").isNull(), NO_TEMPLATE)
    return found.withColumn("reason", reason).where("reason IS NOT NULL").select(
        "request_id", "target_type", "target_id", "locale", "prompt_file", "reason"
    )
