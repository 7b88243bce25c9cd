"""The n-gram join against all pairs."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np

from kgspark.llm import ngram_join
from kgspark.llm.support import table

WORDS = [f"w{i}" for i in range(400)]


def brute_force(rows):
    sets = {i: set(ngram_join.shingles(t).tolist()) for i, t in rows}
    links, parent = dict.fromkeys(sets, 0), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= 0.8 * len(x | y):
                links[a] += 1
                links[b] += 1
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: (root(i), links[i]) for i in ids}


def _near(rng, base, changes):
    words = list(base)
    for _ in range(changes):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def test_banding_reaches_its_recall():
    b = ngram_join.choose_banding()
    assert 1 - (1 - 0.8**b.rows) ** b.bands >= 0.9999 and b.bands * b.rows <= 128


def test_groups_equal_all_pairs(documents, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 8)  # groups of many blocks
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        base = [rng.choice(WORDS) for _ in range(rng.randint(30, 120))]
        texts += [_near(rng, base, rng.randint(0, 3)) for _ in range(rng.randint(1, 12))]
    hot = [rng.choice(WORDS) for _ in range(150)]
    texts += [_near(rng, hot, rng.randint(0, 4)) for _ in range(60)] + [" ".join(hot)] * 40
    texts += ["one two", "one two", "One, two!", "", "   ", "...", "solo", " ".join(WORDS) * 3]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.jaccard_groups(documents(rows + [(900, None)])).collect()}
    assert got.pop(900) == (900, 0)
    assert got == brute_force(rows)


def test_repeated_rows_null_ids_and_empty_table(documents):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None)]
    got = sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in ngram_join.jaccard_groups(documents(rows)).collect())
    assert got == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 3, 0)]
    assert ngram_join.jaccard_groups(documents([])).count() == 0


def test_shared_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    expected = brute_force([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.jaccard_groups(docs).collect()}
    assert got == expected


def test_band_hashes_of_a_long_set_take_bounded_memory_and_stay_as_they_were():
    banding = ngram_join.choose_banding()
    grams = np.unique(np.random.default_rng(7).integers(0, 1 << 63, 300_001, dtype=np.uint64))
    a, b = ngram_join._multipliers(banding.bands * banding.rows)
    expected = np.zeros(banding.bands, dtype=np.uint64)
    least = []
    for x, y in zip(a, b):
        mixed = grams * x + y
        mixed ^= mixed >> np.uint64(32)
        least.append((mixed * np.uint64(0xD6E8FEB86659FD93)).min())
    for row in np.array(least).reshape(banding.bands, banding.rows).T:
        expected = (expected ^ row) * np.uint64(0x9E3779B97F4A7C15)
        expected ^= expected >> np.uint64(31)
    tracemalloc.start()
    found = ngram_join.band_hashes(grams, banding)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.tolist() == expected.tolist()
    assert peak < 1 << 20  # two copies of the set are 4.8 MB
