"""Run logs and model-call events: usage, health, streaks, circuit states, stage times, run states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import with_next

# Limits and states.
FAILURE_THRESHOLD = 5
CIRCUIT_TIMEOUT = 300.0
REQUESTS_PER_MINUTE = 60
ACTIVE, FAILED, CIRCUIT_OPEN = "active", "failed", "circuit_open"
PENDING, RUNNING, SUCCEEDED, RUN_FAILED = "pending", "running", "succeeded", "failed"
STAGE_BOUNDARIES = ("stage_start", "stage_end", "workflow_end")

ORDER = ("ts", "seq")


def usage_rollup(calls: DataFrame) -> DataFrame:
    """Calls, tokens (missing = 0) and latency per agent, provider and model."""

    def tokens(name: str) -> Column:
        return F.sum(F.coalesce(name, F.lit(0))).alias(name)

    return calls.groupBy("agent", "provider", "model").agg(
        F.count(F.lit(1)).alias("calls"),
        tokens("prompt_tokens"),
        tokens("completion_tokens"),
        tokens("total_tokens"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
    )


SKETCH_SIZE = 400  # of a quantile sketch: ranks are off by less than 1 % of the calls, nearly always


def latency_sketches(calls: DataFrame, period: str = "day") -> DataFrame:
    """``agent, provider, model, period, calls, sketch``: a mergeable quantile sketch of the latencies of each period.

    Sketches are combined before the shuffle and stay a few kilobytes, however many calls a period has; missing
    latencies take no part.
    """
    return calls.groupBy("agent", "provider", "model", F.date_trunc(period, "ts").alias("period")).agg(
        F.count("latency_ms").alias("calls"), F.kll_sketch_agg_bigint("latency_ms", F.lit(SKETCH_SIZE)).alias("sketch")
    )


def latency_percentiles(sketches: DataFrame, by: Sequence[str], quantiles: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """``by, calls, p50, ...``: latencies at the quantiles over all periods, from stored sketches alone.

    A quantile is an observed latency whose rank is off by little, see ``SKETCH_SIZE``.
    """
    merged = sketches.where("calls > 0").groupBy(*by).agg(
        F.sum("calls").alias("calls"), F.kll_merge_agg_bigint("sketch", F.lit(SKETCH_SIZE)).alias("sketch")
    )
    found = (F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)).alias(f"p{q * 100:g}") for q in quantiles)
    return merged.select(*by, "calls", *found)


def succeeded(code: Column | str = "status_code") -> Column:
    c = F.col(code) if isinstance(code, str) else code
    return F.coalesce((c >= 200) & (c < 400), F.lit(False))


def key_health(calls: DataFrame) -> DataFrame:
    """Request counts, last success and failure, and success rate per key."""
    ok = succeeded()
    total = F.count(F.lit(1))
    return calls.groupBy("provider", "key_id").agg(
        total.alias("total_requests"),
        F.count_if(ok).alias("successful_requests"),
        F.count_if(~ok).alias("failed_requests"),
        F.max(F.when(ok, F.col("ts"))).alias("last_success_time"),
        F.max(F.when(~ok, F.col("ts"))).alias("last_failure_time"),
        (F.count_if(ok) / total).alias("success_rate"),
    )


def circuit_states(
    calls: DataFrame,
    failure_threshold: int = FAILURE_THRESHOLD,
    circuit_timeout: float = CIRCUIT_TIMEOUT,
    chunk: str = "hour",
) -> DataFrame:
    """Failure streak and circuit state of the key after every call.

    The state after a call follows from the last failure alone: its streak decides between failed and open; a success
    after it restores the key unless the circuit is open and younger than ``circuit_timeout`` seconds. So no row-by-row
    fold is needed. Keys are cut into ``chunk`` time slices: each slice is windowed apart and receives the streak and
    the last failure of the slices before it.
    """
    keys = ["provider", "key_id"]
    ok = F.col("_ok")
    in_chunk = Window.partitionBy(*keys, "_chunk").orderBy(*ORDER)
    so_far = in_chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (
        calls.withColumn("_ok", succeeded())
        .withColumn("_chunk", F.date_trunc(chunk, "ts"))
        .withColumn("_pos", F.row_number().over(in_chunk))
        .withColumn("_last_ok", F.max(F.when(ok, F.col("_pos"))).over(so_far))
        .withColumn("_streak", F.when(ok, 0).otherwise(F.col("_pos") - F.coalesce("_last_ok", F.lit(0))))
        .withColumn(
            "_fail",
            F.last(
                F.when(
                    ~ok,
                    F.struct(
                        F.col("ts").alias("at"),
                        F.col("_streak").alias("streak"),
                        F.col("_last_ok").isNull().alias("unbroken"),
                    ),
                ),
                ignorenulls=True,
            ).over(so_far),
        )
    )
    ends = rows.groupBy(*keys, "_chunk").agg(
        F.max_by(
            F.struct(
                F.col("_pos").alias("rows"),
                F.col("_streak").alias("tail"),
                F.col("_last_ok").isNotNull().alias("broken"),
                F.col("_fail").alias("fail"),
            ),
            F.struct(*ORDER),
        ).alias("_end")
    )
    over_chunks = Window.partitionBy(*keys).orderBy("_chunk")
    before = over_chunks.rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        ends.select(*keys, "_chunk", "_end.*")
        .withColumn("_before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        .withColumn(
            "_base",
            F.last(F.when(F.col("broken"), F.col("_before") + F.col("rows") - F.col("tail")), ignorenulls=True).over(
                before
            ),
        )
        .withColumn("_carry_streak", F.col("_before") - F.coalesce("_base", F.lit(0)))
        .withColumn(
            "_full_fail",
            F.when(
                F.col("fail").isNotNull(),
                F.struct(
                    F.col("fail.at").alias("at"),
                    (
                        F.col("fail.streak") + F.when(F.col("fail.unbroken"), F.col("_carry_streak")).otherwise(0)
                    ).alias("streak"),
                ),
            ),
        )
        .withColumn("_carry_fail", F.last("_full_fail", ignorenulls=True).over(before))
        .select(*keys, "_chunk", "_carry_streak", "_carry_fail")
    )
    streak = F.when(ok, F.lit(0)).otherwise(
        F.col("_streak") + F.when(F.col("_last_ok").isNull(), F.col("_carry_streak")).otherwise(0)
    )
    local_fail = F.struct(
        F.col("_fail.at").alias("at"),
        (F.col("_fail.streak") + F.when(F.col("_fail.unbroken"), F.col("_carry_streak")).otherwise(0)).alias("streak"),
    )
    failure = F.when(F.col("_fail").isNotNull(), local_fail).otherwise(F.col("_carry_fail"))
    opened = F.col("_failure.streak") >= failure_threshold
    aged = F.unix_micros("ts") - F.unix_micros("_failure.at") >= int(circuit_timeout * 1_000_000)
    state = (
        F.when(F.col("_failure").isNull(), ACTIVE)
        .when(~ok, F.when(opened, CIRCUIT_OPEN).otherwise(FAILED))
        .when(opened & ~aged, CIRCUIT_OPEN)
        .otherwise(ACTIVE)
    )
    internal = ["_ok", "_chunk", "_pos", "_last_ok", "_streak", "_fail", "_carry_streak", "_carry_fail", "_failure"]
    return (
        rows.join(carried, [*keys, "_chunk"])
        .withColumn("consecutive_failures", streak.cast("long"))
        .withColumn("_failure", failure)
        .withColumn("state", state)
        .withColumn("circuit_open_time", F.when(F.col("state") == CIRCUIT_OPEN, F.col("_failure.at")))
        .drop(*internal)
    )


def failure_streaks(calls: DataFrame) -> DataFrame:
    """Longest run of consecutive failures and the current one per key."""
    return (
        circuit_states(calls)
        .groupBy("provider", "key_id")
        .agg(
            F.max("consecutive_failures").alias("longest_streak"),
            F.max_by("consecutive_failures", F.struct(*ORDER)).alias("current_streak"),
        )
    )


def current_circuits(calls: DataFrame, **settings) -> DataFrame:
    """State of every key after its latest call."""
    return (
        circuit_states(calls, **settings)
        .groupBy("provider", "key_id")
        .agg(
            F.max_by(F.struct("state", "consecutive_failures", "circuit_open_time"), F.struct(*ORDER)).alias("_last")
        )
        .select("provider", "key_id", "_last.*")
    )


def rate_breaches(calls: DataFrame, rpm: int = REQUESTS_PER_MINUTE) -> DataFrame:
    """Minutes in which a provider received more than ``rpm`` calls. Also works on a stream with a watermark."""
    per_minute = calls.groupBy("provider", F.window("ts", "1 minute").alias("_window")).agg(
        F.count(F.lit(1)).alias("calls")
    )
    return per_minute.where(F.col("calls") > rpm).select(
        "provider", F.col("_window.start").alias("minute"), "calls"
    )


def run_status(message: Column | str = "message") -> Column:
    """Status that a log line puts its run in; NULL when it changes nothing."""
    m = F.col(message) if isinstance(message, str) else message
    return (
        F.when(F.startswith(m, F.lit("[done]")), SUCCEEDED)
        .when(F.startswith(m, F.lit("[error]")), RUN_FAILED)
        .when(F.startswith(m, F.lit("[info]")) & F.contains(m, F.lit("started")), RUNNING)
    )


def latest_status(events: DataFrame) -> DataFrame:
    """Last status named in the log of every run."""
    status = run_status()
    return events.groupBy("run_id").agg(
        F.coalesce(F.max_by(status, F.when(status.isNotNull(), F.struct(*ORDER))), F.lit(PENDING)).alias("status")
    )


def run_states(events: DataFrame) -> DataFrame:
    """Run state machine: pending, running, then the first of succeeded and failed, which is final."""
    status = run_status()
    final = status.isin(SUCCEEDED, RUN_FAILED)
    return events.groupBy("run_id").agg(
        F.coalesce(
            F.min_by(status, F.when(final, F.struct(*ORDER))),
            F.max(F.when(status == RUNNING, F.lit(RUNNING))),
            F.lit(PENDING),
        ).alias("status"),
        F.max("ts").alias("updated_at"),
    )


def stage_durations(progress: DataFrame, chunk: str = "hour") -> DataFrame:
    """Seconds of every started stage. A stage ends at the next start, end or workflow end of its run; an open one is NULL."""
    marks = progress.where(F.col("event").isin(*STAGE_BOUNDARIES))
    linked = with_next(marks, ["run_id"], ORDER, F.date_trunc(chunk, "ts"), "ts", "ended_at")
    return linked.where("event = 'stage_start'").select(
        "run_id",
        "stage",
        F.col("ts").alias("started_at"),
        "ended_at",
        ((F.unix_micros("ended_at") - F.unix_micros("ts")) / 1e6).alias("seconds"),
    )


def workflow_durations(progress: DataFrame) -> DataFrame:
    """Seconds from the latest workflow start to the workflow end per run."""
    start = F.max(F.when(F.col("event") == "workflow_start", F.col("ts")))
    end = F.max(F.when(F.col("event") == "workflow_end", F.col("ts")))
    return (
        progress.groupBy("run_id")
        .agg(start.alias("started_at"), end.alias("ended_at"))
        .withColumn("seconds", (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1e6)
    )
