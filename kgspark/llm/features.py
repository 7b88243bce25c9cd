"""Hashed features of texts and the bounded, labelled sample that models are fitted on.

A text is the set of its runs between white space. Each run gives the hashes of its letters and digits as one word, of
their four-letter grams with word ends, of its other characters, and of being in capitals. A linear score of a text is
then the sum of one number per distinct run and model, which a worker remembers for all models together; the whole text
counts, and nothing is cut.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import map_columns

SLOTS = 1 << 18
CACHED = 150_000
FIT_ROWS = 4000  # the most labelled rows a model is fitted on
MOST_FEATURES = 1024
LEAST_Z = 5.0  # a feature must tell the classes apart by so many standard errors


class _Grams(dict):
    """Slots of four-letter grams, remembered within a bound."""

    def __missing__(self, gram: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        self[gram] = slot = zlib.crc32(f"g{gram}".encode()) % SLOTS
        return slot


_GRAMS = _Grams()


def run_features(run: str) -> set[int]:
    low = run.lower()
    core = low if low.isalnum() else "".join(filter(str.isalnum, low))
    slots: set[int] = set()
    if core:
        marked = f"^{core}$"
        slots.add(zlib.crc32(f"w{core}".encode()) % SLOTS)
        slots.update(map(_GRAMS.__getitem__, [marked[i : i + 4] for i in range(max(1, len(marked) - 3))]))
        if len(core) > 1 and run.isupper():
            slots.add(zlib.crc32(b"capitals") % SLOTS)
    if len(core) < len(low):
        slots.add(zlib.crc32(("p" + "".join(c for c in low if not c.isalnum())).encode()) % SLOTS)
    return slots


def whole_features(runs: list[str], distinct: int) -> list[int]:
    """How repetitive a text of these runs is: share of distinct runs by length, share of runs that repeat the last."""
    if not runs:
        return [zlib.crc32(b"empty") % SLOTS]
    length = len(runs).bit_length()
    again = sum(map(str.__eq__, runs, runs[1:]))
    names = [f"distinct {10 * distinct // len(runs)} of {length}", f"distinct {20 * distinct // len(runs)}"]
    names.append(f"again {20 * again // len(runs)}")
    return [zlib.crc32(n.encode()) % SLOTS for n in names]


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and in how many distinct runs of the text each occurs."""
    counts: Counter[int] = Counter()
    runs = (text or "").split()
    distinct = set(runs)
    for run in distinct:
        counts.update(run_features(run))
    counts.update(whole_features(runs, len(distinct)))
    slots = np.array(sorted(counts), dtype="<i4")
    return slots, np.array([counts[s] for s in slots.tolist()], dtype="<f4")


def _sampled():
    def work(texts: list[str | None]) -> list[list[bytes]]:
        pairs = [text_features(t) for t in texts]
        return [[s.tobytes() for s, _ in pairs], [c.tobytes() for _, c in pairs]]

    return work


@dataclass
class Sample:
    """Labelled rows: keys, one column of labels for each name, sparse features by row."""

    keys: np.ndarray
    labels: np.ndarray
    slots: list[np.ndarray]
    counts: list[np.ndarray]

    def __len__(self) -> int:
        return len(self.keys)


def labelled_sample(docs: DataFrame, labels: DataFrame, names: Sequence[str], rows: int = FIT_ROWS) -> Sample:
    """Features and labels of at most ``rows`` labelled rows, those of the least hash of ``doc_id``.

    Labels that are null or belong to no document are left out; a document rated twice counts twice. At most ``rows``
    ids are broadcast and as many feature rows come to the driver, however large the tables are.
    """
    own = [f"label_{i}" for i in range(len(names))]
    rated = labels.select(
        F.col("doc_id").cast("long").alias("rated_id"), *(F.col(n).cast("int").alias(o) for n, o in zip(names, own))
    ).dropna()
    chosen = rated.orderBy(F.xxhash64("rated_id"), "rated_id", *own).limit(rows)
    rated_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("rated_id")
    )
    found = map_columns(rated_docs, ["text"], _sampled, "slots BINARY, counts BINARY", ["doc_id", *own]).collect()
    found.sort(key=lambda r: tuple(r[: 1 + len(own)]))
    return Sample(
        np.array([r["doc_id"] for r in found], dtype=np.int64),
        np.array([[r[o] for o in own] for r in found], dtype=np.int64).reshape(len(found), len(own)),
        [np.frombuffer(r["slots"], dtype="<i4") for r in found],
        [np.frombuffer(r["counts"], dtype="<f4") for r in found],
    )


def telling_slots(sample: Sample, positive: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The slots whose presence tells ``positive`` rows from the others best."""
    seen = np.zeros((2, SLOTS))
    for i in rows:
        seen[int(positive[i]), sample.slots[i]] += 1
    n = np.array([np.sum(~positive[rows]), np.sum(positive[rows])], dtype=float)
    if not n.all():
        return np.empty(0, dtype=np.int64)
    share = (seen + 0.5) / (n[:, None] + 1)
    pooled = (seen.sum(0) + 1) / (n.sum() + 2)
    z = np.abs(share[1] - share[0]) / np.sqrt(pooled * (1 - pooled) * (1 / n).sum())
    z[seen.sum(0) < 3] = 0
    best = np.argsort(-z, kind="stable")[:MOST_FEATURES]
    return np.sort(best[z[best] >= LEAST_Z])


def dense(sample: Sample, slots: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), len(slots)))
    for at, i in enumerate(rows):
        place = np.searchsorted(slots, sample.slots[i])
        hit = place < len(slots)
        hit[hit] = slots[place[hit]] == sample.slots[i][hit]
        out[at, place[hit]] = sample.counts[i][hit]
    return out


class TextScorer:
    """Sums of slot weights over the distinct runs of a text, for several weight vectors at once."""

    def __init__(self, weights: Sequence[dict[int, float]]) -> None:
        slots = sorted(set().union(*weights))
        self.weights = {s: tuple(w.get(s, 0.0) for w in weights) for s in slots}
        self.known = _Scores(self.weights, len(weights))

    def __call__(self, text: str | None) -> list[float]:
        runs = (text or "").split()
        distinct = set(runs)
        scores = list(map(self.known.__getitem__, distinct))
        scores.append(self.known.sums(whole_features(runs, len(distinct))))
        return [math.fsum(column) for column in zip(*scores)]


class _Scores(dict):
    """The scores of a run, one for each weight vector; its features are worked out once for all of them."""

    def __init__(self, weights: dict[int, tuple[float, ...]], models: int) -> None:
        super().__init__()
        self.weights = weights
        self.none = (0.0,) * models

    def sums(self, slots: Iterable[int]) -> tuple[float, ...]:
        found = [self.weights[s] for s in slots if s in self.weights]
        return tuple(math.fsum(column) for column in zip(*found)) if found else self.none

    def __missing__(self, run: str) -> tuple[float, ...]:
        if len(self) >= CACHED:
            self.clear()
        self[run] = scores = self.sums(run_features(run))
        return scores


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, dtype=float)))


def descend(gradient, start: np.ndarray, steps: int = 800, rate: float = 0.05) -> np.ndarray:
    """Minimises by Adam; the same input gives the same output."""
    x, m, v = start.astype(float).copy(), np.zeros(len(start)), np.zeros(len(start))
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x
