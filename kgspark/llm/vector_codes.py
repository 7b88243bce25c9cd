"""Codes of vectors from codebooks of at most 64 entries a part (operator 13).

The nearest entry of a part is found by slice and intersect: each coordinate of a codebook is sorted once and carries
the masks of its first entries, one bit an entry. An initial radius, the distance to an entry that is certain to exist,
selects a range in every sorted coordinate; two prefix masks give the entries of a range, the ranges' masks are ANDed, and
only the entries left in the mask are measured. The nearest entry is never farther than the radius, so it is always left.

Vectors are read once for each round. A task sends one row per entry in use, so what reaches the driver is bounded by
parts times entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import cut_lineage, join_split, map_columns, ship_package
from .vectors import finite, matrix

SCALE = 256
PARTS = 16
ENTRIES = 64  # one bit each of a 64-bit mask
ROUNDS = 2
SLICE = 4096


class SlicedBook:
    """One part's codebook with its sorted coordinates and prefix masks."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = np.asarray(entries, dtype=np.int64)
        if not 1 <= len(self.entries) <= ENTRIES:
            raise ValueError(f"a codebook has 1 to {ENTRIES} entries")
        self.order = np.argsort(self.entries, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(self.entries, self.order.T, axis=0).T
        bits = np.left_shift(np.uint64(1), self.order.astype(np.uint64))
        self.masks = np.zeros((len(bits), len(self.entries) + 1), dtype=np.uint64)
        np.bitwise_or.accumulate(bits, axis=1, out=self.masks[:, 1:])

    def _radius(self, rows: np.ndarray) -> np.ndarray:
        """Whole distance, rounded up, to the best of the entries that are nearest in one coordinate."""
        best = None
        for d in range(rows.shape[1]):
            after = np.searchsorted(self.sorted[d], rows[:, d])
            for place in (after - 1, after):
                guess = self.order[d][np.clip(place, 0, len(self.entries) - 1)]
                squared = ((rows - self.entries[guess]) ** 2).sum(1)
                best = squared if best is None else np.minimum(best, squared)
        if best is None:  # a part without coordinates
            return np.zeros(len(rows), dtype=np.int64)
        return np.ceil(np.sqrt(best.astype(np.float64))).astype(np.int64) + 1

    def candidates(self, rows: np.ndarray) -> np.ndarray:
        """Masks of the entries inside the initial box of each row."""
        radius = self._radius(rows)
        found = np.full(len(rows), self.masks[0, -1] if len(self.masks) else np.uint64(1), dtype=np.uint64)
        for d in range(rows.shape[1]):
            low = np.searchsorted(self.sorted[d], rows[:, d] - radius, side="left")
            high = np.searchsorted(self.sorted[d], rows[:, d] + radius, side="right")
            found &= self.masks[d][high] ^ self.masks[d][low]
        return found

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row, ties to the lower index."""
        masks = self.candidates(rows)
        index = np.zeros(len(rows), dtype=np.int64)
        error = np.full(len(rows), np.iinfo(np.int64).max, dtype=np.int64)
        for entry in range(len(self.entries)):
            at = np.flatnonzero(masks >> np.uint64(entry) & np.uint64(1))
            squared = ((rows[at] - self.entries[entry]) ** 2).sum(1)
            closer = squared < error[at]
            index[at[closer]], error[at[closer]] = entry, squared[closer]
        return index, error


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, entry, position]``; ``width`` coordinates a part."""

    entries: np.ndarray

    @property
    def width(self) -> int:
        return self.entries.shape[2]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def cut(self, vectors: list) -> np.ndarray:
        """Vectors as ``[row, part, position]``; missing coordinates are 0."""
        rows = matrix(vectors, np.int64)
        out = np.zeros((len(rows), len(self.entries) * self.width), dtype=np.int64)
        out[:, : rows.shape[1]] = rows
        return out.reshape(len(rows), len(self.entries), self.width)


def whole_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, values``: ``floor(scale * component)`` of every row whose vector is clean.

    Rows whose vector is null or holds null or non-finite components are left out; every other row counts, also one
    listed twice or without an id. Components must stay below 2**28 in size, so that squared distances fit a long.
    """
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    clean = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", doubles.alias("values")).where(
        finite(F.col("values"))
    )
    return clean.withColumn("values", F.transform("values", lambda x: F.floor(x * scale).cast("long")))


def _sums(books: Codebooks):
    """A task's sums and counts by part and entry, as one batch of rows; each task sends at most one row per entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sliced = [SlicedBook(b) for b in books.entries]
        parts, entries, width = books.entries.shape
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = books.cut(batch.column("values").slice(at, SLICE).to_pylist())
                for p, book in enumerate(sliced):
                    index, _ = book.nearest(rows[:, p])
                    counts[p] += np.bincount(index, minlength=entries)
                    for d in range(width):  # exact: a slice's sums stay far below 2**53
                        sums[p, :, d] += np.bincount(index, rows[:, p, d], entries).astype(np.int64)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part, pa.int32()),
                pa.array(entry, pa.int32()),
                pa.array(counts[part, entry], pa.int64()),
                pa.array(sums[part, entry].tolist(), pa.list_(pa.int64())),
            ],
            names=["part", "entry", "n", "sums"],
        )

    return run


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of ``vectors(vec_id, values)``; None for an empty table.

    A part's codebook starts as that part of the ``entries`` smallest ids (all rows, if fewer; ids listed twice in the
    order of their values, rows without an id last). Each round assigns every vector and replaces an entry by the floored
    mean of its parts; an unused entry stays. Vectors are as wide as the longest, rounded up to a multiple of ``parts``;
    shorter ones count as filled with zeros.
    """
    ship_package(vectors.sparkSession)
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "values").limit(entries).select("values").collect()
    if not first:
        return None
    longest = vectors.agg(F.max(F.size("values"))).first()[0]
    books = Codebooks(np.zeros((parts, 1, -(-longest // parts)), dtype=np.int64))
    books = Codebooks(books.cut([r["values"] for r in first]).transpose(1, 0, 2).copy())
    for _ in range(rounds):
        sent = vectors.select("values").mapInArrow(_sums(books), "part INT, entry INT, n BIGINT, sums ARRAY<BIGINT>")
        total = sent.groupBy("part", "entry").agg(
            F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"sum_{i}") for i in range(books.width))
        )
        moved = books.entries.copy()
        for row in total.collect():  # at most parts * entries rows
            moved[row["part"], row["entry"]] = [row[f"sum_{i}"] // row["n"] for i in range(books.width)]
        books = Codebooks(moved)
    return books


def _encoded(books: Codebooks):
    def make():
        sliced = [SlicedBook(b) for b in books.entries]

        def work(vectors: list) -> list[list]:
            rows = books.cut(vectors)
            found = [book.nearest(rows[:, p]) for p, book in enumerate(sliced)]
            codes = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
            return [[c.tobytes().hex() for c in codes], np.sum([error for _, error in found], axis=0).tolist()]

        return work

    return make


def encode(vectors: DataFrame, books: Codebooks, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``vectors`` with ``code`` (two hex digits a part) and ``error``; one narrow stage."""
    return map_columns(vectors, ["values"], _encoded(books), "code STRING, error BIGINT", keep)


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``, the sum of ``error`` over equal labels, nulls together.

    Sums are taken before anything is shuffled; a label that most rows share is split over tasks, see ``join_split``.
    """
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    return join_split(coded, sums, "label")


def compress(embeddings: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every clean row; see ``whole_vectors`` and ``train``.

    Other columns play no part. An empty table gives an empty result.
    """
    vectors = cut_lineage(whole_vectors(embeddings))
    books = train(vectors)
    if books is None:
        books = Codebooks(np.zeros((PARTS, 1, 1), dtype=np.int64))
    coded = cut_lineage(encode(vectors, books, ["vec_id", "label"]))
    return with_label_error(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")
    )


def check_sql() -> str:
    """The same by measuring every part against every entry. Vectors of one width, a multiple of the parts."""

    def assigned(book: str) -> str:
        return f"""
            SELECT r.rid, r.part, min(64 * list_sum(list_transform(list_zip(r.sub, c.sub),
                       lambda z: (z[1] - z[2]) * (z[1] - z[2]))) + c.entry) AS best
            FROM subs r JOIN {book} c ON c.part = r.part GROUP BY r.rid, r.part"""

    def moved(book: str, assignment: str) -> str:
        return f"""
            SELECT c.part, c.entry, coalesce(m.sub, c.sub) AS sub
            FROM {book} c LEFT JOIN (
                SELECT part, entry, list(CAST(floor(total / n) AS BIGINT) ORDER BY position) AS sub
                FROM (SELECT a.part, a.best % 64 AS entry, position, sum(r.sub[position]) AS total, count(*) AS n
                      FROM {assignment} a JOIN subs r ON r.rid = a.rid AND r.part = a.part,
                           (SELECT unnest(range(1, (SELECT any_value(width) FROM subs) + 1)) AS position) p
                      GROUP BY ALL)
                GROUP BY part, entry) m ON m.part = c.part AND m.entry = c.entry"""

    return f"""
        WITH kept AS (
            SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), subs AS MATERIALIZED (
            SELECT rid, part, len(v) // 16 AS width, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS sub
            FROM kept, (SELECT unnest(range(16)) AS part) p
        ), book0 AS (SELECT part, rid - 1 AS entry, sub FROM subs WHERE rid <= 64),
        near0 AS MATERIALIZED ({assigned("book0")}),
        book1 AS MATERIALIZED ({moved("book0", "near0")}),
        near1 AS MATERIALIZED ({assigned("book1")}),
        book2 AS MATERIALIZED ({moved("book1", "near1")}),
        near2 AS MATERIALIZED ({assigned("book2")}),
        coded AS (
            SELECT k.vec_id, k.label, string_agg(printf('%02x', CAST(best % 64 AS INTEGER)), '' ORDER BY part) AS code,
                   CAST(sum(best // 64) AS BIGINT) AS error
            FROM kept k JOIN near2 USING (rid) GROUP BY k.rid, k.vec_id, k.label
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(sub, ','), ',' ORDER BY part, entry)) FROM book2) AS codebooks_sha256
        FROM coded
    """
