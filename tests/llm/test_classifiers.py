"""Classifiers: held-out accuracy, ordered thresholds, odd inputs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.llm import features, quality, toxicity
from kgspark.llm.queries import CATEGORIES, rated_categories
from kgspark.llm.support import table

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def halves(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    even = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    return docs, labels.where(even), labels.where(~even)


def test_quality_on_held_out_rows(halves):
    docs, train, test = halves
    scored = quality.classify(docs.join(test, "doc_id", "left_semi"), quality.fit(docs, train)).join(test, "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in scored.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.01 * n[1, True]
    assert n.get((0, True), 0) <= 0.1 * n[0, False]


def test_toxicity_on_held_out_rows(halves):
    docs, train, test = halves
    chain = toxicity.fit(docs, rated_categories(train), CATEGORIES)
    scored = toxicity.classify(docs.join(test, "doc_id", "left_semi"), chain).join(test, "doc_id")
    n = {(r.toxic, r.rejected): r["count"] for r in scored.groupBy("toxic", "rejected").count().collect()}
    assert n.get((0, True), 0) <= 0.01 * n[0, False]
    assert n.get((1, False), 0) <= 0.2 * (n[1, True] + n.get((1, False), 0))  # trained on 2,000 rows


def _sample(texts, labels):
    pairs = [features.text_features(t) for t in texts]
    return features.Sample(np.arange(len(texts)), np.array(labels).reshape(len(texts), -1), *(list(c) for c in zip(*pairs)))


def test_ordinal_grades_share_one_direction():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 4, 400)
    texts = [" ".join(["ok"] + [f"good{i}" for i in range(3) if g > i] + [f"n{rng.integers(1000)}"]) for g in grades]
    model = quality.fit_sample(_sample(texts, grades))
    assert model.grades == (0, 1, 2, 3) and list(model.thresholds) == sorted(model.thresholds)
    scorer = features.TextScorer([model.weights])
    expected = model.expected(model.tails(np.array([scorer(t)[0] for t in texts])))
    assert np.mean(np.rint(expected) == grades) > 0.95


def test_chain_feeds_earlier_probabilities():
    rng = np.random.default_rng(2)
    first = rng.integers(0, 2, 400)
    second = np.where(rng.random(400) < 0.95, first, 1 - first)
    texts = [("bad " if f else "fine ") + f"n{rng.integers(1000)}" for f in first]
    chain = toxicity.fit_sample(_sample(texts, np.stack([first, second], 1)), ["a", "b"])
    assert len(chain.links[1].earlier) == 1
    scorer = features.TextScorer([link.weights for link in chain.links])
    p = chain.probabilities(np.array([scorer(t) for t in texts]))
    assert np.mean((p[:, 1] > 0.5) == (first == 1)) > 0.95


def test_odd_rows(spark, documents):
    rows = [(1, None), (2, ""), (3, "word " * 50_000), (3, "again"), (None, "null id")]
    docs = documents(rows)
    none = spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT")
    model = quality.fit(docs, none)
    got = quality.classify(docs, model).collect()
    assert len(got) == 5 and all(r.kept and r.expected_grade is None for r in got)
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, None, None), (99, 0, 1)], none.schema)
    assert {r.expected_grade for r in quality.classify(docs, quality.fit(docs, one)).collect()} == {1.0}
    chain = toxicity.fit(docs, rated_categories(none), CATEGORIES)
    assert not any(r.rejected for r in toxicity.classify(docs, chain).collect())
    assert toxicity.keep(docs, chain).columns == docs.columns and quality.keep(docs, model).count() == 5
    assert quality.classify(documents([]), model).count() == 0


def _noisy(seed, grades, rows=600):
    rng = np.random.default_rng(seed)
    words = [f"word{i}" for i in range(12)]
    pull = rng.normal(size=len(words))
    texts, labels = [], []
    for _ in range(rows):
        chosen = rng.random(len(words)) < 0.4
        noise = rng.logistic(scale=1.0)
        labels.append(int(np.clip(np.floor(chosen @ pull + noise + grades / 2), 0, grades - 1)))
        texts.append(" ".join(w for w, c in zip(words, chosen) if c) or "none")
    return texts, np.array(labels)


def _text_scores(texts, weights):
    scorer = features.TextScorer([weights])
    return np.array([scorer(t)[0] for t in texts])


def test_ordinal_fit_is_a_minimum():
    """No small step away from the fitted thresholds and weights makes the ratings more likely."""
    texts, grades = _noisy(1, 3)
    model = quality.fit_sample(_sample(texts, grades))
    slots = sorted(model.weights)
    assert len(model.grades) == 3 and slots

    def loss(weights, thresholds):
        score = _text_scores(texts, dict(zip(slots, weights)))
        bounds = np.concatenate([[-np.inf], thresholds, [np.inf]])
        level = np.searchsorted(model.grades, grades)
        p = features.sigmoid(bounds[level + 1] - score) - features.sigmoid(bounds[level] - score)
        return -np.mean(np.log(np.maximum(p, 1e-12)))

    weights, thresholds = np.array([model.weights[s] for s in slots]), np.array(model.thresholds)
    best = loss(weights, thresholds)
    rng = np.random.default_rng(2)
    for size in (0.02, 0.1, 0.3):
        for _ in range(20):
            step, shift = rng.normal(size=len(weights)) * size, rng.normal(size=len(thresholds)) * size
            assert loss(weights + step, thresholds + shift) > best - 1e-3


def test_chain_fit_is_a_minimum():
    texts, labels = _noisy(3, 2)
    chain = toxicity.fit_sample(_sample(texts, labels), ["a"])
    link = chain.links[0]
    slots = sorted(link.weights)

    def loss(weights, bias):
        p = features.sigmoid(bias + _text_scores(texts, dict(zip(slots, weights))))
        return -np.mean(np.log(np.where(labels > 0, p, 1 - p)))

    weights = np.array([link.weights[s] for s in slots])
    best = loss(weights, link.bias)
    rng = np.random.default_rng(4)
    for size in (0.02, 0.1, 0.3):
        for _ in range(20):
            assert loss(weights + rng.normal(size=len(weights)) * size, link.bias + rng.normal() * size) > best - 1e-3


def test_one_pass_scores_all_models():
    rng = np.random.default_rng(6)
    models = [{int(s): float(w) for s, w in zip(rng.integers(0, features.SLOTS, 5000), rng.normal(size=5000))} for _ in range(3)]
    scorer = features.TextScorer(models)
    for text in ("", None, "One two, two!! THREE $$$$ " + "!" * 50, "a b c " * 400):
        runs = (text or "").split()
        slots = [f for r in set(runs) for f in features.run_features(r)] + features.whole_features(runs, len(set(runs)))
        assert scorer(text) == [pytest.approx(sum(m.get(s, 0.0) for s in slots)) for m in models]
