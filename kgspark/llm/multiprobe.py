"""Nearest neighbours by multiprobe p-stable hashing (operator 4).

Largest inner product becomes least distance: vectors are divided by the greatest length and get one more coordinate
that makes all of them unit vectors. Each table cuts several random projections into slots. A query visits its own
bucket and perturbed ones in the order of their estimated chance to hold a neighbour, until the chances add up to what
the wanted recall asks of a table. The visits are made in two rounds. A bounded sample gives a first bound of a query's
k-th best score, and its own buckets with the first perturbed ones a close one; from that bound follows the distance of
the query's k-th neighbour, hence the chances, hence how many more buckets are visited. Nothing about it is taken from
other queries, whose neighbours may be copies. Buckets hand on only rows that reach the bound. Candidates of all tables
are merged and ranked by exact products of the original vectors. Queries that find too few candidates are answered from
all rows.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import cut_lineage, map_columns
from .vectors import BLOCK_ROWS, SEED_ROWS, finite, first_k, in_blocks, kth_best, matrix, one_per_id

K = 20
TABLES = 8
WIDTH = 2.0  # of a slot, in standard deviations of a projection
BITS = 1.3  # what one projection tells at this width
BUCKET_ROWS = 256
RECALL = 0.97
TASKS_A_TABLE = 6
FIRST_PROBES = 12  # perturbed buckets of a table in the first round
SEED = 20240601


@dataclass(frozen=True)
class Index:
    """Random projections ``(tables, hashes, dimension + 1)`` and offsets, the greatest length, a bounded sample of ids
    and vectors."""

    directions: np.ndarray
    offsets: np.ndarray
    longest: float
    seed_ids: np.ndarray
    seeds: np.ndarray

    def unit(self, values: np.ndarray, query: bool) -> np.ndarray:
        width = self.directions.shape[2] - 1
        out = np.zeros((len(values), width + 1))
        out[:, : values.shape[1]] = values[:, :width]
        if query:
            return out / np.maximum(np.sqrt((out**2).sum(1)), 1e-300)[:, None]
        out /= self.longest
        out[:, -1] = np.sqrt(np.maximum(0, 1 - (out**2).sum(1)))
        return out

    def places(self, unit: np.ndarray) -> np.ndarray:
        """Position in slots, by row, table and hash."""
        return np.einsum("nd,thd->nth", unit, self.directions) / WIDTH + self.offsets[None]


def clean(embeddings: DataFrame) -> DataFrame:
    """``vec_id, values`` in doubles; vectors null, zero or holding null or non-finite components are left out."""
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), doubles.alias("values"))
    return one_per_id(own.where(finite(F.col("values"))).where(F.exists("values", lambda x: x != 0)))


def fit(vectors: DataFrame, tables: int = TABLES) -> Index:
    """The index parameters, from one row of statistics and a sample of ``SEED_ROWS`` rows (least hash of the id)."""
    squares = F.aggregate("values", F.lit(0.0), lambda s, x: s + x * x)
    rows, longest, width = vectors.agg(F.count(F.lit(1)), F.max(F.sqrt(squares)), F.max(F.size("values"))).first()
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEED_ROWS).collect()
    hashes = max(1, round(math.log2(max(2, rows / BUCKET_ROWS)) / BITS))
    random = np.random.Generator(np.random.PCG64(SEED))
    directions = random.standard_normal((tables, hashes, (width or 0) + 1))
    offsets = random.random((tables, hashes))
    sample.sort(key=lambda r: r["vec_id"])
    ids = np.array([r["vec_id"] for r in sample], dtype=np.int64)
    return Index(directions, offsets, longest or 1.0, ids, matrix([r["values"] for r in sample]))


def _normal(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.array([math.erfc(-v / math.sqrt(2)) for v in np.ravel(x)]).reshape(np.shape(x))


def probe_order(position: np.ndarray, spread: float, wanted: float, most: int | None = None) -> list[tuple[int, ...]]:
    """Slots of one table in falling order of the chance that a neighbour lies there, until ``wanted`` is reached or
    there are ``most``.

    ``position`` is the query's place in slots by hash; a neighbour's place is normal around it with ``spread``.
    """
    reach = max(1, math.ceil(4 * spread))
    slots = np.floor(position)[:, None] + np.arange(-reach, reach + 1)
    chance = _normal((slots + 1 - position[:, None]) / spread) - _normal((slots - position[:, None]) / spread)
    order = np.argsort(-chance, axis=1, kind="stable")
    chance = np.take_along_axis(chance, order, axis=1)
    slots = np.take_along_axis(slots, order, axis=1).astype(int)
    total, out = 0.0, []
    first = (0,) * len(position)
    heap, seen = [(-float(np.prod(chance[:, 0])), first)], {first}
    while heap and total < wanted and (most is None or len(out) < most):
        p, ranks = heapq.heappop(heap)
        total -= p
        out.append(tuple(int(slots[h, r]) for h, r in enumerate(ranks)))
        for h, r in enumerate(ranks):
            if r + 1 < chance.shape[1]:
                more = (*ranks[:h], r + 1, *ranks[h + 1 :])
                if more not in seen:
                    seen.add(more)
                    p = math.prod(float(chance[i, j]) for i, j in enumerate(more))
                    heapq.heappush(heap, (-p, more))
    return out


def _buckets(index: Index):
    def work(values: list[list[float]]) -> tuple[list[list], list[int]]:
        slots = np.floor(index.places(index.unit(matrix(values), False))).astype(int)
        tables = slots.shape[1]
        keys = [" ".join(map(str, slots[i, t])) for i in range(len(values)) for t in range(tables)]
        return [list(range(tables)) * len(values), keys], [i for i in range(len(values)) for _ in range(tables)]

    return work


def sample_floors(index: Index, ids: list[int], queries: np.ndarray, k: int) -> list[float | None]:
    """The k-th best score of each query in the sample; none where the sample is too small."""
    scores = sums(queries, index.seeds)
    return [kth_best(found[index.seed_ids != own], k) for own, found in zip(ids, scores)]


def neighbour_distances(index: Index, queries: np.ndarray, floors: list[float | None]) -> list[float]:
    """Distance between unit vectors of each query and a row of score ``floor``: no k-th neighbour is farther. Without a
    bound it is that of vectors at right angles."""
    lengths = np.sqrt((queries**2).sum(1)) * index.longest
    return [
        math.sqrt(max(1e-12, 2 - 2 * (0.0 if floor is None else min(1.0, floor / max(length, 1e-300)))))
        for floor, length in zip(floors, lengths)
    ]


def _wanted(index: Index, recall: float) -> float:
    return 1 - (1 - recall) ** (1 / len(index.directions))


def first_slots(index: Index, place: np.ndarray, distance: float, recall: float) -> list[tuple[int, ...]]:
    """What the first round visits in a table: the query's own bucket and the likeliest perturbed ones."""
    home = tuple(np.floor(place).astype(int).tolist())
    likely = probe_order(place, distance / WIDTH, _wanted(index, recall), FIRST_PROBES + 1)
    return [home, *(slot for slot in likely if slot != home)][: FIRST_PROBES + 1]


def _rounds(index: Index, recall: float, k: int, second: bool):
    """The buckets of a round with the bound that their rows must reach."""

    def work(ids: list[int], values: list[list[float]], *known: list[float | None]) -> tuple[list[list], list[int]]:
        own = matrix(values)
        places = index.places(index.unit(own, True))
        sampled = sample_floors(index, ids, own, k) if len(ids) else []
        floors = [s if f is None else f for f, s in zip(known[0], sampled)] if known else sampled
        near, far = neighbour_distances(index, own, floors), neighbour_distances(index, own, sampled)
        out, owners = [[], [], []], []
        for i in range(len(ids)):
            for t in range(places.shape[1]):
                slots = first_slots(index, places[i, t], far[i], recall)
                if second:
                    visited = set(slots)
                    slots = [s for s in probe_order(places[i, t], near[i] / WIDTH, _wanted(index, recall)) if s not in visited]
                for slot in slots:
                    for column, value in zip(out, (t, " ".join(map(str, slot)), floors[i])):
                        column.append(value)
                    owners.append(i)
        return out, owners

    return work


def sums(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in doubles, added up in the order of the components, so that equal vectors score equal."""
    out = np.zeros((len(queries), len(vectors)))
    for d in range(min(queries.shape[1], vectors.shape[1])):
        out += np.multiply.outer(queries[:, d], vectors[:, d])
    return out


def _best(vectors: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(vectors) or not len(queries):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
    v, ids = matrix(vectors["values"]), vectors["vec_id"].to_numpy()
    q = matrix(queries["values"])
    own_ids, floors = queries["vec_id"].to_numpy(), queries["floor"].to_numpy(dtype=float)
    out = []
    for at in range(0, len(q), 256):
        scores = sums(q[at : at + 256], v)
        for own, floor, found in zip(own_ids[at : at + 256], floors[at : at + 256], scores):
            rows = np.flatnonzero((ids != own) & ((found >= floor) if not np.isnan(floor) else True))
            if len(rows) > k:
                least = np.partition(found[rows], len(rows) - k)[len(rows) - k]
                rows = rows[found[rows] >= least]
                rows = rows[np.lexsort((ids[rows], -found[rows]))[:k]]
            out.append((np.full(len(rows), own), ids[rows], found[rows]))
    q_ids, v_ids, found = (np.concatenate(c) for c in zip(*out))
    return pd.DataFrame({"query_id": q_ids, "vec_id": v_ids, "score": found})


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query over all tables; a pair may come from several."""
    return first_k(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)


def nearest(
    vectors: DataFrame, every: int = 20, k: int = K, tables: int = TABLES, recall: float = RECALL
) -> DataFrame:
    """``query_id, rank, vec_id, score`` over ``vectors(vec_id, values: array of double)``, each id once.

    Queries are the ids divisible by ``every``, candidates all rows but the query's own. The result is approximate
    (``recall`` is what probing aims at), scores are exact. A query with fewer than ``k`` finds is answered exactly
    from all rows, in blocks. An empty table gives an empty result; see ``clean`` for what takes part.
    """
    held = cut_lineage(vectors.select("vec_id", "values"))
    index = fit(held, tables)
    asked = held.where(F.pmod("vec_id", F.lit(every)) == 0)
    bucketed = map_columns(held, ["values"], lambda: _buckets(index), "`table` INT, bucket STRING", ["vec_id", "values"])
    added = "`table` INT, bucket STRING, floor DOUBLE"

    def visited(queries: DataFrame, second: bool) -> DataFrame:
        spread = queries.repartition(tables * TASKS_A_TABLE, "vec_id")  # few rows, much work a row
        inputs = ["vec_id", "values", *(["known"] if second else [])]
        probes = map_columns(spread, inputs, lambda: _rounds(index, recall, k, second), added, ["vec_id", "values"])
        return in_blocks(bucketed, cut_lineage(probes), ["table", "bucket"], lambda v, q: _best(v, q, k), "DOUBLE")

    near = cut_lineage(_merged(visited(asked, False), k))
    known = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("known"))
    far = visited(asked.join(known, "vec_id", "left"), True)
    found = cut_lineage(_merged(far.unionByName(near.drop("rank")), k))
    enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    short = asked.join(enough.withColumnRenamed("query_id", "vec_id"), "vec_id", "left_anti")
    rows = held.count()
    blocks = max(1, -(-rows // BLOCK_ROWS))
    all_rows = held.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    every_part = short.withColumn("floor", F.lit(None).cast("double")).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    )
    exact = in_blocks(all_rows, every_part, ["part"], lambda v, q: _best(v, q, k), "DOUBLE")
    complete = found.join(enough.select("query_id"), "query_id", "left_semi")
    return complete.unionByName(first_k(exact, k))
