"""Quality by ordinal regression: one weight vector, ordered thresholds (operator 5).

P(grade <= k) = sigmoid(threshold_k - weights . text). The weights are shared by all grades; thresholds are kept in
order by adding up exponentials. A text's expected grade and the probability of its tail of good grades decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import FIT_ROWS, Sample, TextScorer, dense, descend, labelled_sample, sigmoid, telling_slots
from .support import keep_rows, map_columns

CUT = 0.3
DECAY = 1e-4
SCORES = "expected_grade DOUBLE, tail_probability DOUBLE, kept BOOLEAN"


@dataclass(frozen=True)
class OrdinalModel:
    """``grades`` in order, one threshold fewer, and weights by feature slot."""

    grades: tuple[int, ...]
    thresholds: tuple[float, ...]
    weights: dict[int, float]

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > grades[k]) for each k but the last, by row."""
        return sigmoid(np.asarray(score)[:, None] - np.array(self.thresholds)[None, :])

    def expected(self, tails: np.ndarray) -> np.ndarray:
        steps = np.diff(np.array(self.grades, dtype=float))
        return self.grades[0] + tails @ steps


def fit_sample(sample: Sample) -> OrdinalModel:
    """The model of a sample. Fewer than two grades give no thresholds, and then nothing is rejected."""
    grade = sample.labels[:, 0] if len(sample) else np.empty(0, dtype=np.int64)
    grades = tuple(int(g) for g in np.unique(grade))
    if len(grades) < 2:
        return OrdinalModel(grades, (), {})
    rows = np.arange(len(sample))
    level = np.searchsorted(grades, grade)
    slots = np.unique(np.concatenate([telling_slots(sample, level > k, rows) for k in range(len(grades) - 1)]))
    x = dense(sample, slots, rows)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    x = (x - mean) / scale
    n, d, k = len(rows), len(slots), len(grades) - 1
    share = np.array([np.mean(level <= i) for i in range(k)])
    first = np.log(share / (1 - share))
    start = np.concatenate([np.zeros(d), first[:1], np.log(np.maximum(np.diff(first), 1e-3))])

    def thresholds(theta: np.ndarray) -> np.ndarray:
        return np.concatenate([theta[d : d + 1], theta[d] + np.cumsum(np.exp(theta[d + 1 :]))])

    def gradient(theta: np.ndarray) -> np.ndarray:
        bounds = np.concatenate([[-np.inf], thresholds(theta), [np.inf]])
        score = x @ theta[:d]
        upper, lower = sigmoid(bounds[level + 1] - score), sigmoid(bounds[level] - score)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p  # slopes of log p in the two bounds
        out = np.empty_like(theta)
        out[:d] = x.T @ (du - dl) / n + DECAY * theta[:d]
        by_bound = -np.array([np.sum(du[level == i]) - np.sum(dl[level == i + 1]) for i in range(k)]) / n
        out[d] = by_bound.sum()
        tail = np.cumsum(by_bound[::-1])[::-1]
        out[d + 1 :] = tail[1:] * np.exp(theta[d + 1 :])
        return out

    theta = descend(gradient, start)
    weights = theta[:d] / scale
    shift = float(weights @ mean)
    return OrdinalModel(
        grades,
        tuple(float(t) + shift for t in thresholds(theta)),
        {int(s): float(w) for s, w in zip(slots, weights)},
    )


def fit(docs: DataFrame, labels: DataFrame, grade: str = "quality", rows: int = FIT_ROWS) -> OrdinalModel:
    """Fits on at most ``rows`` ratings of ``labels(doc_id, grade)``; see ``features.labelled_sample``."""
    return fit_sample(labelled_sample(docs, labels, [grade], rows))


def _scorer(model: OrdinalModel, least: int | None, cut: float):
    scorer = TextScorer([model.weights])
    at = len(model.thresholds) - 1 if least is None else int(np.searchsorted(model.grades, least)) - 1

    def work(texts: list[str | None]) -> list[list]:
        scores = np.array([scorer(t)[0] for t in texts], dtype=float)
        if model.thresholds:
            tails = model.tails(scores)
            expected = model.expected(tails).tolist()
            tail = tails[:, min(at, tails.shape[1] - 1)] if at >= 0 else np.ones(len(texts))
        else:
            expected = [float(model.grades[0]) if model.grades else None] * len(texts)
            tail = np.ones(len(texts))
        return [expected, tail.tolist(), (tail >= cut).tolist()]

    return work


def classify(docs: DataFrame, model: OrdinalModel, least: int | None = None, cut: float = CUT) -> DataFrame:
    """``doc_id, expected_grade, tail_probability, kept`` of every row of ``docs``; one narrow stage, no shuffle.

    The tail holds the grades from ``least`` on (the best grade alone by default); ``kept`` says that its probability
    reaches ``cut``. A null text counts as empty, and an empty text is judged by the thresholds alone. Repeated rows
    give repeated rows; other columns play no part. Without two grades in the ratings every document is kept, with the
    one grade as expectation, or none.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_columns(texts, ["text"], lambda: _scorer(model, least, cut), SCORES, ["doc_id"])


def keep(docs: DataFrame, model: OrdinalModel, least: int | None = None, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns; one narrow stage."""

    def make():
        score = _scorer(model, least, cut)
        return lambda texts: score(texts)[2]

    return keep_rows(docs, ["text"], make)
