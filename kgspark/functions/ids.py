"""Deterministic ids. All are hashes or slugs of the inputs, so a re-run or a retried task gives the same id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, collapse, or_empty, slug, url_slug

# Fixed values of the id formats.
NODE_ID_MAX = 64
NODE_ID_KEEP = 50
DEFAULT_NODE_TYPE = "Concept"
DEFAULT_LANGUAGE = "zh"


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def section_id(topic: Column | str, chapter: Column | str, subchapter: Column | str) -> Column:
    return F.substring(_digest(or_empty(topic), or_empty(chapter), or_empty(subchapter)), 1, 12)


def content_hash(text: Column | str) -> Column:
    """Hash that ignores whitespace differences."""
    return F.substring(F.md5(collapse(text)), 1, 12)


def content_hash_full(text: Column | str) -> Column:
    return F.when(or_empty(text) == "", F.lit("")).otherwise(F.md5(col(text)))


def concept_id(name: Column | str, topic: Column | str, chapter: Column | str, subchapter: Column | str) -> Column:
    suffix = F.substring(_digest(or_empty(topic), or_empty(chapter), or_empty(subchapter)), 1, 6)
    return F.concat(F.lit("concept:"), slug(name), F.lit(":"), suffix)


def chapter_id(chapter: Column | str, doc: Column | str) -> Column:
    suffix = F.substring(_digest(or_empty(doc), or_empty(chapter)), 1, 6)
    return F.concat(F.lit("chapter:"), slug(chapter), F.lit(":"), suffix)


def subchapter_id(subchapter: Column | str, doc: Column | str, chapter: Column | str) -> Column:
    suffix = F.substring(_digest(or_empty(doc), or_empty(chapter), or_empty(subchapter)), 1, 6)
    return F.concat(F.lit("subchapter:"), slug(subchapter), F.lit(":"), suffix)


def book_id(topic: Column | str, run: Column | str) -> Column:
    short = F.substring(or_empty(run), 1, 8)
    base = F.concat(F.lit("book:"), slug(topic))
    return F.when(short == "", base).otherwise(F.concat(base, F.lit(":"), short))


def book_scope(topic: Column | str, language: Column | str) -> Column:
    """Language-qualified book scope. NULL for an empty topic, which has no repeatable id."""
    lang = or_empty(language)
    base = F.concat(F.lit("book_"), url_slug(topic))
    named = F.when((lang == "") | (lang == DEFAULT_LANGUAGE), base).otherwise(F.concat(base, F.lit("_"), lang))
    return F.when(or_empty(topic) != "", named)


def section_scope(section: Column | str) -> Column:
    return F.concat(F.lit("section:"), col(section))


def relation_rid(type_: Column | str, source: Column | str, target: Column | str, scope: Column | str) -> Column:
    return F.substring(_digest(or_empty(type_), or_empty(source), or_empty(target), or_empty(scope)), 1, 16)


def relation_rid_sha(
    source: Column | str, target: Column | str, type_: Column | str, scope: Column | str, description: Column | str
) -> Column:
    """Relation id that also covers the description, when there is one."""
    head = F.concat_ws("|", or_empty(source), or_empty(target), or_empty(type_), or_empty(scope))
    desc = or_empty(description)
    return F.substring(F.sha2(F.when(desc == "", head).otherwise(F.concat_ws("|", head, desc)), 256), 1, 16)


def node_id(name: Column | str, type_: Column | str, scope: Column | str) -> Column:
    """Slug of name, type and scope; cut and hashed when long. NULL for an empty name."""
    kind, where = or_empty(type_), or_empty(scope)
    full = F.concat_ws(
        "_",
        url_slug(name),
        F.when((kind != "") & (kind != DEFAULT_NODE_TYPE), F.lower(kind)),
        F.when(where != "", F.substring(url_slug(where), 1, 8)),
    )
    short = F.concat(F.substring(full, 1, NODE_ID_KEEP), F.lit("_"), F.substring(F.md5(full), 1, 8))
    return F.when(or_empty(name) != "", F.when(F.length(full) > NODE_ID_MAX, short).otherwise(full))


def legacy_edge_id(type_: Column | str, source: Column | str, target: Column | str) -> Column:
    return F.concat(or_empty(type_), F.lit(":"), or_empty(source), F.lit("->"), or_empty(target))
