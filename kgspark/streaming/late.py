"""Rows of a stream that come too late, kept aside instead of dropped.

A stateful stream with a watermark drops what is older. Here a first stream parts the rows: those behind the watermark of
the batches before go to a side table, all others to a table that the stateful stream reads. The watermark is the newest
event time so far less the delay, as Spark's own; each batch stores the one it leaves behind, so a repeated batch parts
its rows in the same way.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MARKS = "newest_us BIGINT, batch BIGINT"


def _newest(spark: SparkSession, path: str, batch_id: int) -> int | None:
    """The newest event time, in microseconds, of the batches before this one."""
    try:
        marks = spark.read.schema(MARKS).json(f"{path}/marks")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return marks.where(F.col("batch") < batch_id).agg(F.max("newest_us")).first()[0]


def split_late(
    rows: DataFrame, path: str, checkpoint: str, delay_seconds: float, time: str = "ts", **trigger
) -> StreamingQuery:
    """Parts a stream into ``path/accepted`` and ``path/late``, both partitioned by batch.

    A row is late when its event time lies before the newest one of the batches before, less the delay; a row without
    event time is accepted. A repeated batch overwrites what it wrote.
    """
    delay = int(delay_seconds * 1_000_000)

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = _newest(spark, path, batch_id)
        late = F.lit(False) if newest is None else F.coalesce(F.unix_micros(time) < newest - delay, F.lit(False))
        parted = batch.withColumn("_late", late).persist()
        for name, wanted in (("late", F.col("_late")), ("accepted", ~F.col("_late"))):
            parted.where(wanted).drop("_late").write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        own = parted.agg(F.max(F.unix_micros(time)).alias("newest_us"))
        own.coalesce(1).write.mode("overwrite").json(f"{path}/marks/batch={batch_id}")
        parted.unpersist()

    return (
        rows.writeStream.foreachBatch(each_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def accepted_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The accepted rows as a stream, a batch of the splitting stream or several at a time."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/accepted")


def late_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All late rows so far, with their ``batch``."""
    return spark.read.schema(f"{schema}, batch BIGINT").parquet(f"{path}/late")
