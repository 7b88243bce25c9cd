"""The pipeline, stage by stage, against its operators' own results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_ngram_join import brute_force

import corpus_pipeline
from kgspark.llm import ngram_join, quality, toxicity
from kgspark.llm.queries import CATEGORIES, rated_categories
from kgspark.llm.support import table

SF = "/root/testdata/sf0.001"


def test_run(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    kept = {r.doc_id for r in quality.classify(docs, quality.fit(docs, labels)).collect() if r.kept}
    docs = docs.where(docs.doc_id.isin(*kept))
    chain = toxicity.fit(docs, rated_categories(labels), CATEGORIES)
    clean = {r.doc_id for r in toxicity.classify(docs, chain).collect() if not r.rejected}
    texts = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in clean]
    expected = {i for i, (group, _) in brute_force(texts).items() if i == group}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == expected


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


A = " ".join(f"alpha{i}" for i in range(60))
B = " ".join(f"beta{i}" for i in range(60))
C = " ".join(f"gamma{i}" for i in range(60))


def test_near_copies_go_by_row(spark, documents):
    rows = [
        (0, A), (1, A), (1, B), (2, C), (2, C), (None, C), (5, A + " more"), (None, None), (None, ""), (7, None), (7, " . "),
        (3, "two words"), (4, "two words"), (None, "words alone"), (None, "words alone"), (9, "x " * 60_000), (8, "x " * 50_000),
    ]
    kept = ngram_join.one_of_each(documents(rows))
    assert kept.columns == documents(rows).columns and {r["rank"] for r in kept.collect()} == {"clash"}
    found = [(r.doc_id, None if r.text is None else r.text[:20]) for r in kept.collect()]
    expected = [(0, A), (1, B), (2, C), (None, None), (None, ""), (7, None), (7, " . "), (3, "two words"), (None, "words alone"), (8, "x " * 50_000)]
    assert sorted(map(repr, found)) == sorted(repr((i, t if t is None else t[:20])) for i, t in expected)
    assert ngram_join.one_of_each(documents([])).collect() == []


def test_least_id_of_each_group_stays(spark, documents):
    texts = [f"{A} {'tail ' * (i % 3)}" if i % 3 else f"{B} {i}" for i in range(90)]
    rows = [(89 - i, t) for i, t in enumerate(texts)]
    groups = brute_force(rows)
    kept = {r.doc_id for r in ngram_join.one_of_each(documents(rows)).collect()}
    assert kept == {i for i, (group, _) in groups.items() if i == group}


@pytest.mark.parametrize("place", range(4))
def test_stages_bear_odd_rows(spark, place):
    docs = table(spark, SF, "documents")
    odd = [(None, None, None, None, None), (None, "", "en", "s", 0), (3, "again and again", "en", "s", 15), (3, "again and again", "en", "s", 15)]
    mixed = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    _, stage = corpus_pipeline.STAGES[place]
    before = mixed.count()
    found = stage(spark, mixed, SF)
    assert 0 < found.where("doc_id IS NOT NULL").count()
    if place < 3:
        assert found.columns == docs.columns and found.count() <= before
    empty = stage(spark, docs.limit(0), SF)
    assert empty.count() == 0 and found.columns == empty.columns
    if place == 3:  # a document without text is its end token alone
        assert found.where(F.col("doc_id").isNull()).select("length").distinct().collect() == [(1,)]
