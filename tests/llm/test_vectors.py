"""Both vector searches against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from kgspark.llm import exact_topk, multiprobe
from kgspark.llm.support import table

SCHEMA = "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT, values STRING, class STRING"


def product(a, b):
    """Added up in order; ``sum`` would compensate."""
    total = 0.0
    for x, y in zip(a, b):
        total += float(x) * float(y)
    return total


def _clean(rows, zero):
    kept = {}
    for i, e, *_ in rows:
        if i is None or e is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        if zero and not any(e):
            continue
        kept[i] = min(kept.get(i, e), e)
    return kept


def _exact(kept, every, k):
    out = []
    for q in sorted(i for i in kept if i % every == 0):
        scores = []
        for i, e in kept.items():
            if i != q:
                scores.append((-sum(int(np.floor(1024 * a)) * int(np.floor(1024 * b)) for a, b in zip(kept[q], e)), i))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.fixture(scope="module")
def odd_rows():
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.01, 1, 30])).tolist()) for i in range(420)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # ties
    rows += [(700, None), (701, []), (702, [0.0] * 6), (703, [float("nan")] * 6), (704, [1.0, None]), (800, [float("inf"), 1.0])]
    rows += [(None, [1.0] * 6), rows[0], (900, [2.0, 1.0])]
    return [(*r, 1, "clash", "clash") for r in rows]


def test_exact_products_on_odd_rows(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, SCHEMA)
    got = [tuple(r) for r in exact_topk.top_products(exact_topk.scaled(df)).collect()]
    assert sorted(got) == _exact(_clean(odd_rows, False), 100, 10)
    assert exact_topk.top_products(exact_topk.scaled(df.limit(0))).count() == 0
    few = [tuple(r) for r in exact_topk.top_products(exact_topk.scaled(df.where("vec_id < 3"))).collect()]
    assert len(few) == 2


def test_coordinate_pruning_loses_nothing():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(4000, 5))
    v /= np.linalg.norm(v, axis=1)[:, None]
    for q in v[:50]:
        for cosine in (0.6, 0.9, 0.99):
            kept = exact_topk._feasible(q, v, cosine)
            assert kept[v @ q >= cosine].all()


def test_multiprobe_on_odd_rows(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, SCHEMA)
    kept = _clean(odd_rows, True)
    got = {}
    for r in multiprobe.nearest(multiprobe.clean(df)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in kept if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        for _, i, score in found:
            assert score == product(kept[q], kept[i])
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        scores = sorted((-product(kept[q], e), i) for i, e in kept.items() if i != q)[:20]
        hits += len({i for _, i in scores} & {f[1] for f in found})
    assert hits >= 0.9 * 20 * len(got)
    few = multiprobe.nearest(multiprobe.clean(df.where("vec_id < 5"))).collect()
    assert sorted((r.query_id, r.vec_id) for r in few) == [(0, i) for i in range(1, 5)]
    assert multiprobe.nearest(multiprobe.clean(df.limit(0))).count() == 0


def test_probes_come_in_falling_chance():
    order = multiprobe.probe_order(np.array([3.1, -0.5, 7.9]), 0.5, 0.9)
    assert order[0] == (3, -1, 7) and len(set(order)) == len(order)


def test_recall_on_the_shared_table(spark):
    rows = table(spark, "/root/testdata/sf0.1", "embeddings").collect()
    x, ids = np.array([r.embedding for r in rows], dtype=float), np.array([r.vec_id for r in rows])
    got = {}
    for r in multiprobe.nearest(multiprobe.clean(table(spark, "/root/testdata/sf0.1", "embeddings"))).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for at in np.flatnonzero(ids % 20 == 0):
        s = x @ x[at]
        s[at] = -np.inf
        hits.append(len(set(ids[np.lexsort((ids, -s))[:20]].tolist()) & got[ids[at]]))
    assert np.mean(hits) / 20 >= 0.9


def test_recall_beside_copies(spark):
    x, ids = np.random.default_rng(5).normal(size=(6000, 24)), np.arange(6000)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[ids % 3 == 1] = x[1]
    df = spark.createDataFrame([(int(i), v) for i, v in zip(ids, x.tolist())], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    got = {}
    for r in multiprobe.nearest(multiprobe.clean(df)).collect():
        got.setdefault(r.query_id, []).append(r.score)
    hits = []
    for at in np.flatnonzero(ids % 20 == 0):
        s = x @ x[at]
        s[at] = -np.inf
        hits.append(np.mean(np.array(got[ids[at]]) >= np.sort(s)[-20] - 1e-9))
    assert np.mean(hits) >= 0.95 and min(hits) >= 0.5
