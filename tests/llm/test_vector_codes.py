"""Vector codes against plain measuring of every entry."""

from __future__ import annotations

import hashlib
from collections import Counter
from math import floor, isfinite

import numpy as np
import pytest

from kgspark.llm import vector_codes

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, code STRING, part INT, error BIGINT"


def nearest(row, book):
    return min((sum((x - y) ** 2 for x, y in zip(row, entry)), i) for i, entry in enumerate(book))


def brute(rows):
    kept = [(i, [floor(256 * float(x)) for x in e], lab) for i, e, lab in rows if e is not None and all(x is not None and isfinite(x) for x in e)]
    if not kept:
        return []
    width = -(-max(len(e) for _, e, _ in kept) // 16)
    cut = [[(e + [0] * (16 * width - len(e)))[p * width : (p + 1) * width] for p in range(16)] for _, e, _ in kept]
    first = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, kept[j][0] or 0, kept[j][1]))[:64]
    books = [[cut[j][p] for j in first] for p in range(16)]
    for _ in range(2):
        for p, book in enumerate(books):
            owners = [nearest(row[p], book)[1] for row in cut]
            for entry in range(len(book)):
                own = [row[p] for row, o in zip(cut, owners) if o == entry]
                if own:
                    book[entry] = [sum(c) // len(own) for c in zip(*own)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[nearest(part, book) for part, book in zip(row, books)] for row in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, _, label), error in zip(kept, errors):
        by_label[label] += error
    return [
        (i, "".join(f"{e:02x}" for _, e in f), error, by_label[label], digest)
        for (i, _, label), f, error in zip(kept, found, errors)
    ]


def run(spark, rows):
    df = spark.createDataFrame([(i, e, lab, "clash", 3, 4) for i, e, lab in rows], SCHEMA)
    return [tuple(r) for r in vector_codes.compress(df).collect()]


def ordered(rows):
    return sorted(rows, key=repr)


def test_compress_equals_brute_force(spark):
    random = np.random.default_rng(5)
    rows = [(int(i), random.normal(0, 0.2, 32).astype("float32").tolist(), int(i) % 4) for i in random.permutation(200)]
    rows += [(300 + i, rows[0][1], None) for i in range(60)]  # copies, and labels that are null
    rows += [(7, rows[3][1], 1), (rows[5][0], rows[5][1], 2), (None, rows[9][1], 2), (None, [0.5] * 32, None)]
    rows += [(900, None, 1), (901, [None] * 32, 1), (902, [float("nan")] * 32, 1), (903, [float("inf")] * 32, 0)]
    rows += [(-5, [0.25] * 32, 9), (-6, [-0.001] * 20, 9), (904, [], 9)]
    assert ordered(run(spark, rows)) == ordered(brute(rows))


def test_few_rows_and_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 2)]) == []
    rows = [(1, [0.1] * 16, 2), (2, [0.1] * 16, 2), (3, [-3.0] * 16, None)]
    assert ordered(run(spark, rows)) == ordered(brute(rows))
    assert ordered(run(spark, [(1, [], 2)])) == ordered(brute([(1, [], 2)]))


@pytest.mark.parametrize("width", [1, 2, 4, 7])
@pytest.mark.parametrize("entries", [1, 3, 64])
def test_sliced_masks_hold_the_nearest_entry(width, entries):
    random = np.random.default_rng(width * 100 + entries)
    book = vector_codes.SlicedBook(random.integers(-20, 20, (entries, width)))
    rows = np.concatenate([random.integers(-20, 20, (400, width)), random.integers(-60, 60, (200, width))])
    rows[:entries] = book.entries  # zero distances
    every = ((rows[:, None, :] - book.entries[None]) ** 2).sum(2)
    masks = book.candidates(rows)
    index, error = book.nearest(rows)
    assert np.array_equal(error, every.min(1))
    assert np.array_equal(index, every.argmin(1))
    held = (masks[:, None] >> np.arange(entries, dtype=np.uint64)[None]) & np.uint64(1)
    assert np.all(held[every == every.min(1)[:, None]] == 1)
    if entries == 64 and width == 4:
        assert held[:400].sum(1).mean() < entries / 4  # few entries are measured


def test_too_many_entries_for_a_mask():
    with pytest.raises(ValueError):
        vector_codes.SlicedBook(np.zeros((65, 2), dtype=np.int64))
