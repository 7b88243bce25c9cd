"""Exact top-k inner products by norm buckets (operator 7).

Vectors are grouped by length in geometric classes. A query's k-th best score over a bounded set of the longest vectors
is a lower bound; divided by the query's length and the longest length of a class it is the local cosine that a vector
of the class must reach. Above 1 the whole class is skipped; a high cosine prunes by coordinates, a low one by length;
what is left is verified by exact integer products.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import cut_lineage, map_columns
from .vectors import SEED_ROWS, finite, first_k, in_blocks, kth_best, matrix, one_per_id

SCALE = 1024
K = 10
CLASSES_PER_OCTAVE = 16
FOCUS = 4  # coordinates looked at in coordinate pruning
COORDINATE_COSINE = 0.6  # from this local cosine on, coordinates prune more than lengths


def scaled(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, values``: ``floor(scale * component)`` of every clean vector."""
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    whole = F.transform("values", lambda x: F.floor(x * scale).cast("long"))
    clean = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), doubles.alias("values")).where(
        finite(F.col("values"))
    )
    return one_per_id(clean.select("vec_id", whole.alias("values")))


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles where every sum stays below 2**53, else in 64-bit integers."""
    width = min(queries.shape[1], vectors.shape[1])
    q, v = queries[:, :width], vectors[:, :width]
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)), dtype=np.int64)
    if float(np.abs(q).max()) * float(np.abs(v).max()) * width < 2**53:
        return np.rint(q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return np.einsum("qd,vd->qv", q, v)


def _best(vectors: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(vectors) or not len(queries):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    vectors = vectors.sort_values(["length", "vec_id"], ascending=[False, True])
    v, ids, lengths = matrix(vectors["values"], np.int64), vectors["vec_id"].to_numpy(), vectors["length"].to_numpy()
    q = matrix(queries["values"], np.int64)
    unit = v / np.maximum(lengths, 1e-300)[:, None]
    out = []
    for at in range(0, len(q), 256):
        part = queries.iloc[at : at + 256]
        scores = None
        for i, (own, length, floor) in enumerate(zip(part["vec_id"], part["length"], part["floor"])):
            rows = np.arange(len(v))
            if floor is not None and not np.isnan(floor) and floor > 0 and length > 0:
                need = floor / length * (1 - 1e-9)
                cosine = need / max(lengths[0], 1e-300)
                if cosine > 1:
                    continue
                rows = rows[: np.searchsorted(-lengths, -need, side="right")]
                if cosine >= COORDINATE_COSINE:
                    rows = rows[_feasible(q[at + i] / length, unit[rows], cosine)]
            if len(rows) < len(v) // 4:
                found = products(q[at + i : at + i + 1], v[rows])[0]
            else:
                if scores is None:
                    scores = products(q[at : at + 256], v)
                found = scores[i, rows]
            good = ids[rows] != own
            if floor is not None and not np.isnan(floor):
                good &= found >= floor
            rows, found = rows[good], found[good]
            if len(found) > k:
                least = np.partition(found, len(found) - k)[len(found) - k]
                rows, found = rows[found >= least], found[found >= least]
                first = np.lexsort((ids[rows], -found))[:k]
                rows, found = rows[first], found[first]
            out.append(pd.DataFrame({"query_id": np.full(len(rows), own), "vec_id": ids[rows], "score": found}))
    if not out:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    return pd.concat(out).astype("int64")


def _feasible(query: np.ndarray, unit: np.ndarray, cosine: float) -> np.ndarray:
    """Rows whose focus coordinates lie where a cosine of ``cosine`` with ``query`` is possible."""
    width = min(len(query), unit.shape[1])
    focus = np.argsort(-np.abs(query[:width]), kind="stable")[:FOCUS]
    middle, spread = query[focus] * cosine, np.sqrt(np.maximum(0, 1 - query[focus] ** 2) * max(0.0, 1 - cosine**2))
    low = np.where(query[focus] < -cosine, -1.0, middle - spread) - 1e-9
    high = np.where(query[focus] > cosine, 1.0, middle + spread) + 1e-9
    return np.all((unit[:, focus] >= low) & (unit[:, focus] <= high), axis=1)


def _floors(seeds: list, k: int):
    ids = np.array([r["vec_id"] for r in seeds], dtype=np.int64)
    rows = matrix([r["values"] for r in seeds], np.int64)

    def work(own: list[int], values: list[list[int]]) -> list[list[float | None]]:
        found = products(matrix(values, np.int64), rows) if len(ids) else np.zeros((len(own), 0))
        return [[kth_best(s[ids != o], k) for s, o in zip(found, own)]]

    return work


def top_products(vectors: DataFrame, every: int = 100, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score`` over ``vectors(vec_id, values: array of long)``.

    Queries are the ids divisible by ``every``, candidates all rows but the query's own. Exact: a class or row is only
    skipped when its bound is below a score that ``k`` candidates reach. Shorter vectors count as filled with zeros.
    Products must fit a long. Empty tables give empty results; see ``scaled`` for what takes part.
    """
    squares = F.aggregate("values", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    octave = F.floor(F.log2("length") * CLASSES_PER_OCTAVE).cast("int")
    held = cut_lineage(
        vectors.withColumn("length", F.sqrt(squares)).withColumn(
            "class", F.when(F.col("length") > 0, octave).otherwise(F.lit(-(1 << 30)))
        )
    )
    longest = held.groupBy("class").agg(F.max("length").alias("longest")).collect()  # at most one row per class
    seeds = held.orderBy(F.desc("length"), "vec_id").limit(SEED_ROWS).select("vec_id", "values").collect()
    asked = held.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "values", "length")
    asked = map_columns(asked, ["vec_id", "values"], lambda: _floors(seeds, k), "floor DOUBLE", asked.columns)
    if not longest:
        longest = [{"class": 0, "longest": 0.0}]
    classes = F.array(*(F.struct(F.lit(r["class"]).alias("class"), F.lit(r["longest"]).alias("longest")) for r in longest))
    reach = F.col("length") * F.col("c.longest") * (1 + 1e-9)
    wanted = (
        asked.withColumn("c", F.explode(classes))
        .where(F.col("floor").isNull() | (F.col("floor") <= 0) | (reach >= F.col("floor")))
        .select("vec_id", "values", "length", "floor", F.col("c.class").alias("class"))
    )
    found = in_blocks(held, wanted, ["class"], lambda v, q: _best(v, q, k), "BIGINT")
    return first_k(found, k)
