"""Toxicity by a chain of linear classifiers (operator 8).

Categories are predicted one after another. Each model sees the text and the probabilities of the categories before
it; while it is fitted those are out-of-fold predictions, so that it learns how far they can be trusted on new texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import FIT_ROWS, Sample, TextScorer, dense, descend, labelled_sample, sigmoid, telling_slots
from .support import keep_rows, map_columns

CUT = 0.3
DECAY = 1e-4
FOLDS = 4


@dataclass(frozen=True)
class Link:
    """One linear model: bias, weights by feature slot, weights of the earlier probabilities."""

    bias: float
    weights: dict[int, float]
    earlier: tuple[float, ...]


@dataclass(frozen=True)
class Chain:
    categories: tuple[str, ...]
    links: tuple[Link, ...]

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """By row and category, from the text score of each link."""
        out = np.zeros((len(scores), len(self.links)))
        for j, link in enumerate(self.links):
            out[:, j] = sigmoid(link.bias + scores[:, j] + out[:, :j] @ np.array(link.earlier[:j], dtype=float))
        return out


def _fit_link(sample: Sample, rows: np.ndarray, target: np.ndarray, earlier: np.ndarray) -> Link:
    positive = target[rows]
    if not len(rows) or positive.all() or not positive.any():
        rate = (positive.sum() + 0.5) / (len(rows) + 1) if len(rows) else 1e-6
        return Link(float(np.log(rate / (1 - rate))), {}, (0.0,) * earlier.shape[1])
    slots = telling_slots(sample, target, rows)
    x = np.hstack([dense(sample, slots, rows), earlier[rows]])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    x = (x - mean) / scale
    y, n = positive.astype(float), len(rows)

    def gradient(theta: np.ndarray) -> np.ndarray:
        error = (sigmoid(x @ theta[1:] + theta[0]) - y) / n
        return np.concatenate([[error.sum()], x.T @ error + DECAY * theta[1:]])

    rate = y.mean()
    theta = descend(gradient, np.concatenate([[np.log(rate / (1 - rate))], np.zeros(x.shape[1])]))
    weights = theta[1:] / scale
    d = len(slots)
    return Link(
        float(theta[0] - weights @ mean),
        {int(s): float(w) for s, w in zip(slots, weights[:d])},
        tuple(float(w) for w in weights[d:]),
    )


def _predict(link: Link, sample: Sample, rows: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    slots = np.array(sorted(link.weights), dtype=np.int64)
    weights = np.array([link.weights[int(s)] for s in slots])
    return sigmoid(link.bias + dense(sample, slots, rows) @ weights + earlier[rows] @ np.array(link.earlier, dtype=float))


def fit_sample(sample: Sample, categories: Sequence[str], folds: int = FOLDS) -> Chain:
    """The chain of a sample whose label columns are ``categories`` in order (1: belongs). Folds go by ``doc_id``.

    A category without both answers among the rows of a fit gets its base rate alone.
    """
    rows = np.arange(len(sample))
    fold = sample.keys % folds if len(sample) else np.empty(0, dtype=np.int64)
    earlier = np.zeros((len(sample), 0))
    links = []
    for j in range(len(categories)):
        target = sample.labels[:, j] > 0 if len(sample) else np.empty(0, dtype=bool)
        links.append(_fit_link(sample, rows, target, earlier))
        if j + 1 < len(categories):
            held_out = np.zeros(len(sample))
            for f in range(folds):
                inside, outside = rows[fold != f], rows[fold == f]
                if len(outside):
                    held_out[outside] = _predict(_fit_link(sample, inside, target, earlier), sample, outside, earlier)
            earlier = np.hstack([earlier, held_out[:, None]])
    return Chain(tuple(categories), tuple(links))


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str], rows: int = FIT_ROWS) -> Chain:
    """Fits on at most ``rows`` rows of ``labels(doc_id, *categories)``; see ``features.labelled_sample``."""
    return fit_sample(labelled_sample(docs, labels, categories, rows), categories)


def _scorer(chain: Chain):
    scorer = TextScorer([link.weights for link in chain.links])

    def work(texts: list[str | None]) -> list[list[float]]:
        scores = np.array([scorer(t) for t in texts], dtype=float).reshape(len(texts), len(chain.links))
        return chain.probabilities(scores).T.tolist()

    return work


def classify(docs: DataFrame, chain: Chain, cut: float = CUT) -> DataFrame:
    """``doc_id``, ``p_<category>`` for each category, and ``rejected``: the last category's probability reaches ``cut``.

    One row per row of ``docs``, one narrow stage, no shuffle. A null text counts as empty; repeated rows give repeated
    rows; other columns play no part. Without labels of both kinds a category has its base rate, or almost 0.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    added = ", ".join(f"`p_{c}` DOUBLE" for c in chain.categories)
    scored = map_columns(texts, ["text"], lambda: _scorer(chain), added, ["doc_id"])
    return scored.withColumn("rejected", F.col(f"p_{chain.categories[-1]}") >= cut)


def keep(docs: DataFrame, chain: Chain, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that ``classify`` does not reject, with all their columns; one narrow stage."""

    def make():
        score = _scorer(chain)
        return lambda texts: [p < cut for p in score(texts)[-1]]

    return keep_rows(docs, ["text"], make)
