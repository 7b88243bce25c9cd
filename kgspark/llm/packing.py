"""Best-fit packing of token sequences with exact-complement hashing (operator 6).

Pieces of equal length are interchangeable, so the plan is made on the histogram of lengths, which has at most
``capacity`` rows however large the corpus is:

1. From the longest length down, the gap that a piece leaves is looked up among single lengths, sums of pairs and sums
   of triples that are still available; a combination that fills the gap exactly is consumed as often as its scarcest
   part allows.
2. What finds no exact complement is placed best-fit, longest first, into the smallest gap that takes it.

A plan row says which range of the ranks of a length goes to which sequences. Ranks are counted in small hashed groups
of a length, so a length that a third of all pieces share is never sorted in one task. The same rows always give the
same sequences, whatever executors are lost.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import bpe
from .support import cut_lineage, map_columns

CAPACITY = 2048
END_ID = 0
MARKS = ".,;:!?"
GROUP_ROWS = 256  # pieces of one length that are ranked together, on average

PIECES = "piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT"
PLACES = "sequence_id BIGINT, offset BIGINT"


class _LibraryWords(bpe.Encoder):
    """Merges words that are not remembered by the tokenizers library, whose ids the pieces are to have."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.tokenize = Tokenizer.from_file(path).model.tokenize
        split = self.pretoken.findall
        self.simple = self.text.lower and all(split(f"abc{mark}") == ["abc", mark] for mark in MARKS) and split("abc") == ["abc"]

    def _run(self, run: str) -> bytes:
        """Plain letters, with one mark behind them at most, need no pattern: most runs are such."""
        if self.simple and len(run) <= bpe.RUN and run.isascii():
            if run.isalpha():
                return self.words[run.lower()]
            if run[:-1].isalpha() and run[-1] in MARKS:
                return self.words[run[:-1].lower()] + self.words[run[-1]]
        return super()._run(run)

    def _word(self, word: str) -> bytes:
        ids = [token.id for token in self.tokenize(word if word.isascii() and word.isalpha() else self.symbols(word))]
        return struct.pack(f"<{len(ids)}I", *ids)


@functools.lru_cache(maxsize=4)
def _encoder(path: str) -> _LibraryWords:
    """One encoder per file and worker."""
    return _LibraryWords(path)


def _cut(path: str, capacity: int, end_id: int):
    encoder = _encoder(path)
    end = np.array([end_id], dtype="<u4")

    def work(texts: list[str | None]) -> tuple[list[list], list[int]]:
        rows, owners = [], []
        for at, text in enumerate(texts):
            held, size, piece, start = [], 0, 0, 0
            for ids in _chain(encoder.encode(text or ""), end):
                held.append(ids)
                size += len(ids)
                while size > capacity:  # a full piece is only closed once more follows
                    ids = np.concatenate(held)
                    rows.append((piece, start, capacity, zlib.crc32(ids[:capacity].tobytes())))
                    held, size, piece, start = [ids[capacity:]], size - capacity, piece + 1, start + capacity
            rows.append((piece, start, size, zlib.crc32(np.concatenate(held).tobytes())))
            owners += [at] * (piece + 1)
        return [list(c) for c in zip(*rows)] or [[], [], [], []], owners

    return work


def _chain(parts: Iterator[np.ndarray], last: np.ndarray) -> Iterator[np.ndarray]:
    yield from parts
    yield last


def cut_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: its ids and ``end_id``, cut at multiples of ``capacity``. Null text: ``end_id``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_columns(texts, ["text"], lambda: _cut(path, capacity, end_id), PIECES, ["doc_id"])


@dataclass
class Plan:
    """Where the ranks of each length go: rows ``first rank, last rank, pieces a sequence, first sequence, offset``."""

    rows: dict[int, list[tuple[int, int, int, int, int]]] = field(default_factory=lambda: defaultdict(list))
    sequences: int = 0


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Packs ``counts[length]`` pieces of each length into sequences of at most ``capacity``."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        left[length] = n
    bins: list[list] = []  # [{length: pieces a sequence}, sequences, gap]
    for length in range(capacity, 0, -1):
        while left[length]:
            parts = _complement(left, length, capacity - length)
            if parts is None:
                break
            need: dict[int, int] = defaultdict(int)
            for part in (length, *parts):
                need[part] += 1
            times = min(int(left[p]) // k for p, k in need.items())
            for p, k in need.items():
                left[p] -= times * k
            bins.append([dict(need), times, 0])
    _best_fit(left, bins, capacity)
    return _numbered(bins)


def _complement(left: np.ndarray, length: int, gap: int) -> tuple[int, ...] | None:
    """Available lengths that fill ``gap`` exactly beside one piece of ``length``: one, two or three, largest first."""
    if gap == 0:
        return ()
    free = left.copy()
    free[length] -= 1
    if free[gap] > 0:
        return (gap,)
    if (pair := _pair(free, gap)) is not None:
        return pair
    for first in np.flatnonzero(free[1:gap])[::-1] + 1:
        first = int(first)
        if 3 * first < gap:  # the largest part of a triple has at least a third
            break
        free[first] -= 1
        pair = _pair(free, gap - first)
        free[first] += 1
        if pair is not None:
            return (first, *pair)
    return None


def _pair(free: np.ndarray, gap: int) -> tuple[int, int] | None:
    if gap < 2:
        return None
    low = np.arange(1, gap // 2 + 1)
    both = (free[low] > 0) & (free[gap - low] > 0)
    if gap % 2 == 0:
        both[-1] = free[gap // 2] > 1
    at = np.flatnonzero(both)
    return None if not len(at) else (gap - int(low[at[0]]), int(low[at[0]]))


def _best_fit(left: np.ndarray, bins: list[list], capacity: int) -> None:
    by_gap: dict[int, list[list]] = defaultdict(list)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            gap = min((g for g, group in by_gap.items() if g >= length and group), default=None)
            if gap is None:
                each = min(capacity // length, n)
                row = [{length: each}, n // each, capacity - each * length]
                n -= row[1] * each
                by_gap[row[2]].append(row)
                bins.append(row)
                continue
            row = by_gap[gap].pop()
            each = min(gap // length, n)
            times = min(row[1], n // each)
            if times < row[1]:
                rest = [dict(row[0]), row[1] - times, gap]
                bins.append(rest)
                by_gap[gap].append(rest)
            row[0][length] = row[0].get(length, 0) + each
            row[1], row[2] = times, gap - each * length
            n -= times * each
            by_gap[row[2]].append(row)
        left[length] = 0


def _numbered(bins: list[list]) -> Plan:
    plan, used = Plan(), defaultdict(int)
    for pattern, times, _ in bins:
        offset = 0
        for length, each in pattern.items():
            plan.rows[length].append((used[length], used[length] + times * each, each, plan.sequences, offset))
            used[length] += times * each
            offset += each * length
        plan.sequences += times
    return plan


def _place(rows: dict[int, np.ndarray]):
    def work(lengths: list[int], ranks: list[int]) -> list[np.ndarray]:
        length, rank = np.array(lengths, dtype=np.int64), np.array(ranks, dtype=np.int64)
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for size in np.unique(length):
            at = np.flatnonzero(length == size)
            plan = rows[int(size)]
            row = plan[np.searchsorted(plan[:, 0], rank[at], side="right") - 1]
            within = rank[at] - row[:, 0]
            sequence[at] = row[:, 3] + within // row[:, 2]
            offset[at] = row[:, 4] + within % row[:, 2] * size
        return [sequence, offset]

    return work


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``doc_id, piece, start, length, ids_crc32``.

    ``pieces`` should be stored or checkpointed, as it is read three times. Equal rows (a document listed twice) are
    packed as often as they occur; between equal rows the choice of place is free. An empty table gives an empty one.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_packing(counts, capacity)
    groups = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, -(-n // GROUP_ROWS)))) if counts else None
    if groups is None:
        groups = F.create_map(F.lit(1).cast("long"), F.lit(1))
    hashed = F.xxhash64("doc_id", "piece", "ids_crc32")
    salted = pieces.withColumn("salt", F.pmod(hashed, F.element_at(groups, F.col("length"))).cast("long"))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("position", F.row_number().over(inside))
        .join(starts, ["length", "salt"])
        .select(*pieces.columns, (F.col("base") + F.col("position") - 1).alias("rank"))
    )
    rows = {k: np.array(v, dtype=np.int64) for k, v in plan.rows.items()}
    return map_columns(ranked, ["length", "rank"], lambda: _place(rows), PLACES, pieces.columns)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all ``docs`` with their sequences; see ``cut_documents`` and ``pack_pieces``.

    One row per piece; a null or empty text is one piece that holds ``end_id`` alone. Other columns play no part.
    """
    return pack_pieces(cut_lineage(cut_documents(docs, path, capacity, end_id)), capacity)
