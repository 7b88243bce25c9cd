"""Rules that depend on arrival order, written so that one hot key never lands whole in one task.

``row_number() = 1`` gets a partial group limit before the shuffle, so a hot key sends one row per input partition.
Running and look-ahead rules split a key into chunks of its order column and carry a small summary from chunk to chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("seq",)) -> DataFrame:
    """Keep the earliest row of every key."""
    return _pick(df, keys, [F.col(c).asc_nulls_last() for c in order])


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("seq",)) -> DataFrame:
    """Keep the latest row of every key."""
    return _pick(df, keys, [F.col(c).desc_nulls_last() for c in order])


def with_row_index(df: DataFrame, order: Sequence[str], name: str = "row_index") -> DataFrame:
    """Number all rows 0, 1, 2, … in ``order`` without a single-partition window.

    The range-sorted rows are checkpointed so that both readers see the same partitions; only the number of rows of
    each partition goes through one task.
    """
    sorted_rows = cut_lineage(df.sort(*order))
    placed = sorted_rows.withColumn("_part", F.spark_partition_id()).withColumn(
        "_in_part", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed.join(offsets, "_part")
        .withColumn(name, F.col("_offset") + F.col("_in_part"))
        .drop("_part", "_in_part", "_offset")
    )


def round_robin(df: DataFrame, n: int, order: Sequence[str] = ("seq",), name: str = "slot") -> DataFrame:
    """Give the i-th row slot i mod n."""
    return with_row_index(df, order, "_index").withColumn(name, F.pmod("_index", F.lit(n)).cast("int")).drop("_index")


def with_next(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, value: str, name: str
) -> DataFrame:
    """Add the (non-null) ``value`` of the next row of the same key.

    ``chunk`` must not decrease along ``order``: it splits a key into pieces that are windowed apart, and the first
    value of each piece is handed back to the piece before it.
    """
    keys = list(keys)
    rows = df.withColumn("_chunk", chunk)
    in_chunk = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    local = rows.withColumn("_local_next", F.lead(value).over(in_chunk))
    heads = rows.groupBy(*keys, "_chunk").agg(F.min_by(value, F.struct(*order)).alias("_head"))
    over_chunks = Window.partitionBy(*keys).orderBy("_chunk")
    carried = heads.select(*keys, "_chunk", F.lead("_head").over(over_chunks).alias("_carried"))
    return (
        local.join(carried, [*keys, "_chunk"])
        .withColumn(name, F.coalesce("_local_next", "_carried"))
        .drop("_chunk", "_local_next", "_carried")
    )


def distinct_in_order(df: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """Distinct keys with the order of their first sight; pre-aggregated before the shuffle."""
    return df.groupBy(*keys).agg(F.min(order).alias(order))
