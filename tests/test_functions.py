"""Column functions on hand-worked values and against Python's own string rules."""

from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kgspark.functions import ids, status
from kgspark.functions import text as t


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


CASES = [
    (lambda: t.slug(F.lit("机器学习 C++　éa_b")), "机器学习_c_éa_b"),
    (lambda: t.url_slug(F.lit("  Deep-Learning: the_Basics! ")), "deep_learning_the_basics"),
    (lambda: t.url_slug(F.lit(None).cast("string")), ""),
    (lambda: t.evidence_count(F.lit("a;b;")), 3),
    (lambda: t.evidence_count(F.lit("")), 1),
    (lambda: t.sanitize_rel_type(F.lit("part-of")), "PART_OF"),
    (lambda: t.sanitize_rel_type(F.lit("9x")), "REL_9X"),
    (lambda: t.sanitize_rel_type(F.lit("包含")), "RELATED"),
    (lambda: t.canonical_keyword(F.lit(" Deep-Learning/机器（学习） ")), "deep learning 机器 学习"),
    (lambda: t.normalize_name(F.lit("　 a \t\n b\x1c")), "a b"),
    (lambda: t.normalize_aliases(F.array(F.lit("b  c"), F.lit(" "), F.lit("x"), F.lit("b c")), F.lit("x")), ["b c"]),
    (lambda: t.dedupe_aliases(F.array(F.lit("b  c"), F.lit(" x "), F.lit("b c")), F.lit("x")), ["b  c", "b c"]),
    (lambda: t.normalize_aliases(F.lit(None).cast("array<string>"), F.lit("x")), []),
    (lambda: t.truncate_text(F.lit("a😀bc"), 3), "a😀b"),
    (lambda: t.exact_round(F.lit(1 / 16), 3), 0.062),
    (lambda: t.two_decimals(F.lit(0.945)), "0.94"),
    (lambda: t.two_decimals(F.lit(0.125)), "0.12"),
    (lambda: ids.section_id(F.lit("t"), F.lit(None).cast("string"), F.lit("s")), hashlib.md5(b"t||s").hexdigest()[:12]),
    (lambda: ids.content_hash_full(F.lit("")), ""),
    (lambda: ids.book_id(F.lit("A b"), F.lit("0123456789")), "book:a_b:01234567"),
    (lambda: ids.book_id(F.lit("A b"), F.lit(None).cast("string")), "book:a_b"),
    (lambda: ids.book_scope(F.lit("A b"), F.lit("zh")), "book_a_b"),
    (lambda: ids.book_scope(F.lit("A b"), F.lit("en")), "book_a_b_en"),
    (lambda: ids.book_scope(F.lit(""), F.lit("en")), None),
    (lambda: ids.node_id(F.lit("Gradient Descent"), F.lit("Concept"), F.lit("")), "gradient_descent"),
    (lambda: ids.node_id(F.lit("Gradient"), F.lit("Method"), F.lit("book_python")), "gradient_method_book_pyt"),
    (lambda: ids.node_id(F.lit(""), F.lit("Method"), F.lit("b")), None),
    (
        lambda: ids.node_id(F.lit("x" * 80), F.lit("Concept"), F.lit("")),
        "x" * 50 + "_" + hashlib.md5(("x" * 80).encode()).hexdigest()[:8],
    ),
    (
        lambda: ids.relation_rid_sha(F.lit("a"), F.lit("b"), F.lit("T"), F.lit("s"), F.lit("")),
        hashlib.sha256(b"a|b|T|s").hexdigest()[:16],
    ),
    (
        lambda: ids.relation_rid_sha(F.lit("a"), F.lit("b"), F.lit("T"), F.lit("s"), F.lit("d")),
        hashlib.sha256(b"a|b|T|s|d").hexdigest()[:16],
    ),
    (lambda: ids.relation_rid(F.lit("T"), F.lit("a"), F.lit("b"), F.lit("s")), hashlib.md5(b"T|a|b|s").hexdigest()[:16]),
    (lambda: ids.legacy_edge_id(F.lit("T"), F.lit("a"), F.lit("b")), "T:a->b"),
    (lambda: status.log_level(F.lit("[info] x [error]")), "info"),
    (lambda: status.log_level(F.lit("x [error]")), "error"),
    (lambda: status.http_error_class(F.lit(429)), "rate_limit"),
    (lambda: status.http_error_class(F.lit(302)), "http"),
    (lambda: status.mask_key(F.lit("12345678")), "****"),
    (lambda: status.mask_key(F.lit("123456789")), "1234...6789"),
]


@pytest.mark.parametrize("number", range(len(CASES)))
def test_hand_worked(spark, number):
    column, expected = CASES[number]
    assert value(spark, column()) == expected


def test_model_ref(spark):
    assert tuple(value(spark, status.split_model_ref(F.lit("p:m:x"), "dp", "dm"))) == ("p", "m:x")
    assert tuple(value(spark, status.split_model_ref(F.lit("plain"), "dp", "dm"))) == ("dp", "dm")


TEXTS = st.lists(st.text(st.sampled_from("aZ9_-/;é机 \t\n\x1c\x85  　.!"), max_size=20), min_size=1, max_size=60)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TEXTS)
def test_whitespace_and_slug_rules(spark, texts):
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    rows = df.select(
        "x",
        t.strip("x").alias("strip"),
        t.collapse("x").alias("collapse"),
        t.slug("x").alias("slug"),
        t.url_slug("x").alias("url"),
    ).collect()
    for r in rows:
        assert r["strip"] == r["x"].strip()
        assert r["collapse"] == " ".join(r["x"].split())
        assert r["slug"] == re.sub(r"\W+", "_", r["x"]).strip("_").lower()
        assert r["url"] == re.sub(r"[\s_-]+", "_", re.sub(r"[^\w\s-]", "", r["x"].lower())).strip("_")


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.floats(0, 1), st.integers(0, 2000).map(lambda i: i / 2000)), min_size=1, max_size=200))
def test_rounding_equals_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", t.two_decimals("x").alias("two"), t.exact_round("x", 3).alias("three")).collect():
        assert r["two"] == f"{r['x']:.2f}"
        assert r["three"] == round(r["x"], 3)
