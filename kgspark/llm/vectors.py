"""What both vector searches share: clean vectors, blocks of bounded size, the best rows of each query."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 2048
SEED_ROWS = 1024


def finite(values: Column) -> Column:
    """No null and no non-finite component; false for a null vector."""
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return values.isNotNull() & ~F.coalesce(bad, F.lit(True))


def one_per_id(vectors: DataFrame) -> DataFrame:
    """``vec_id, values``: ids that are null are left out, of several vectors of an id the least in order stays."""
    return vectors.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("values").alias("values"))


def matrix(rows, dtype=np.float64) -> np.ndarray:
    """Rows of equal or unequal length as a matrix; missing components are 0."""
    rows = [np.asarray(r, dtype=dtype) for r in rows]
    width = max(map(len, rows), default=0)
    if all(len(r) == width for r in rows):
        return np.array(rows, dtype=dtype).reshape(len(rows), width)
    out = np.zeros((len(rows), width), dtype=dtype)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def in_blocks(vectors: DataFrame, queries: DataFrame, keys: list[str], best: Callable, score: str) -> DataFrame:
    """Meets vectors and queries of equal ``keys``, in blocks of about ``BLOCK_ROWS`` each way, however hot a key is.

    ``best(vectors, queries)`` gets two pandas frames and returns ``query_id, vec_id, score`` rows.
    """

    def blocked(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias(name))

    def spread(df: DataFrame, own: str, count: str, other: str, other_count: str) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.col(count))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other_count) - 1))
        )

    counts = blocked(vectors, "v_blocks").join(blocked(queries, "q_blocks"), keys)
    left = spread(vectors.join(counts, keys), "v_block", "v_blocks", "q_block", "q_blocks").drop("v_blocks", "q_blocks")
    right = spread(queries.join(counts, keys), "q_block", "q_blocks", "v_block", "v_blocks").drop("v_blocks", "q_blocks")
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # columns of its own: both may stem from one table
    place = [*keys, "v_block", "q_block"]
    return left.groupBy(*place).cogroup(right.groupBy(*place)).applyInPandas(
        best, f"query_id BIGINT, vec_id BIGINT, score {score}"
    )


def first_k(found: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of each query, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def kth_best(scores: np.ndarray, k: int) -> float | None:
    return None if len(scores) < k else float(np.partition(scores, len(scores) - k)[len(scores) - k])
