"""Tailing run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions.status import log_level
from ..sources.runs import log_lines, run_log_rows

# Fixed value: message that ends the log of a run.
END_OF_RUN = "__EOF__"


def stream_run_log(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Log lines of all runs as they arrive, with level and ``is_end`` on the end marker of a run."""
    raw = (
        spark.readStream.schema(schemas.RUN_LOG)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{ndjson,json}")
        .option("maxFilesPerTrigger", max_files)
        .json(path)
    )
    events = run_log_rows(raw.select("*", F.col("_metadata.file_path").alias("_path")))
    return events.withColumn("level", log_level("message")).withColumn("is_end", F.col("message") == END_OF_RUN)


def append_run_log(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream of run events as newline JSON, one folder for each bucket of runs."""
    return (
        log_lines(events).writeStream.format("json")
        .partitionBy("bucket")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
