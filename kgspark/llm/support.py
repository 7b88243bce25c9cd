"""Tables, checkpoints and the package on the executors."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import cut_lineage, scratch_path

SLICE_ROWS = 256
SALTS = 64

__all__ = ["cut_lineage", "join_hot", "join_split", "keep_rows", "map_columns", "scratch_path", "ship_package", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_hot(rows: DataFrame, per_key: DataFrame, key: str, spread: Column, salts: int = SALTS) -> DataFrame:
    """``rows`` with the columns of ``per_key``, one row per value of ``key`` there, nulls being equal.

    The few rows of ``per_key`` are repeated for each salt, and each row of the other side has the salt that its column
    ``spread`` gives, so a key that most rows share is read by many tasks.
    """
    repeated = per_key.withColumnRenamed(key, "joined_key").withColumn(
        "joined_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    salted = rows.withColumn("row_salt", F.pmod(spread, F.lit(salts)).cast("int"))
    same = F.col(key).eqNullSafe(F.col("joined_key")) & (F.col("row_salt") == F.col("joined_salt"))
    return salted.join(repeated, same).drop("row_salt", "joined_salt", "joined_key")


def join_split(rows: DataFrame, per_key: DataFrame, key: str) -> DataFrame:
    """As ``join_hot`` for a side that may have very many keys: nothing is repeated.

    What was grouped by the key is written and read again, so that both sides come straight from a shuffle and adaptive
    execution can split a crowded key over tasks.
    """
    other = cut_lineage(per_key.withColumnRenamed(key, "joined_key"))
    return rows.join(other, F.col(key).eqNullSafe(F.col("joined_key"))).drop("joined_key")


def ship_package(spark: SparkSession) -> None:
    """Let the Python workers import this package by name, as ``--py-files`` does; once per application.

    Functions that are imported, not pickled, keep their caches from task to task of a worker. The archive is served
    by the driver; no executor reads the driver's folder.
    """
    context = spark.sparkContext
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = f"{os.path.basename(package)}.zip"
    if archive in context._python_includes:
        return
    folder = tempfile.mkdtemp(prefix="py-files-")
    made = shutil.make_archive(os.path.join(folder, archive[:-4]), "zip", os.path.dirname(package), os.path.basename(package))
    context.addPyFile(made)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that few texts are Python objects at a time; at least one slice, if an empty one."""
    for batch in batches:
        for start in range(0, max(1, batch.num_rows), SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def map_columns(
    df: DataFrame, inputs: Sequence[str], make: Callable[[], Callable], added: str, keep: Sequence[str]
) -> DataFrame:
    """The columns ``keep`` of ``df`` and those of the DDL string ``added``, worked out from the columns ``inputs``.

    ``make()`` gives a function for a task; it takes one list per input column and returns one list per added column,
    or those and the list of row numbers they belong to. Kept columns stay in Arrow: no null turns an integer into a
    float. One narrow stage.
    """
    ship_package(df.sparkSession)
    schema = StructType([df.schema[c] for c in keep] + StructType.fromDDL(added).fields)
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in _small(batches):
            result, rows = work(*(batch.column(c).to_pylist() for c in inputs)), None
            if isinstance(result, tuple):
                result, rows = result
            own = [batch.column(c) if rows is None else batch.column(c).take(pa.array(rows, pa.int64())) for c in keep]
            new = [pa.array(v, kinds.field(len(keep) + i).type, from_pandas=False) for i, v in enumerate(result)]
            arrays = [a.cast(kinds.field(i).type) for i, a in enumerate([*own, *new])]
            yield pa.RecordBatch.from_arrays(arrays, names=kinds.names)

    return df.select(*dict.fromkeys([*keep, *inputs])).mapInArrow(run, schema)


def keep_rows(df: DataFrame, inputs: Sequence[str], make: Callable[[], Callable]) -> DataFrame:
    """The rows of ``df``, with all their columns, for which the function that ``make()`` gives says true."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in _small(batches):
            yield batch.filter(pa.array(work(*(batch.column(c).to_pylist() for c in inputs)), pa.bool_()))

    return df.mapInArrow(run, df.schema)
