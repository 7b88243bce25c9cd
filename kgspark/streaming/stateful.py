"""Keyed stream state: stage times, run states, circuit states.

Spark partitions the events by key and keeps the state, a few bytes per key; a small function folds the rows of a key in
order. Without ``lateness`` rows are put in order within a micro-batch, state does not expire and a final run status does
not move, however late its next line comes. With ``lateness`` (the delay of the stream's watermark) the rows of a key are
held until the watermark has passed them, so that rows of any later batch may still come before them; what is held is
what arrived within the delay. The watermark follows the rows that matter to the fold. Rows older than the watermark are kept out by ``late.split_late``, which lists them. With
a time to live, a key without rows for so long is forgotten. For many keys, run the stream with the RocksDB state store
provider.
"""

from __future__ import annotations

import json
import sys
from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.telemetry import (
    ACTIVE,
    CIRCUIT_OPEN,
    CIRCUIT_TIMEOUT,
    FAILED,
    FAILURE_THRESHOLD,
    PENDING,
    RUN_FAILED,
    STAGE_BOUNDARIES,
    SUCCEEDED,
    run_status,
    succeeded,
)

# The folds are sent to the executors whole, so that the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Times travel as microseconds (`us`), so that no time zone enters the Python side.
STAGE_ROWS = "run_id STRING, stage STRING, started_us BIGINT, ended_us BIGINT"
STAGE_STATE = "stage STRING, started_us BIGINT"
STATUS_ROWS = "run_id STRING, status STRING, updated_us BIGINT"
STATUS_STATE = "status STRING"
CIRCUIT_ROWS = (
    "provider STRING, key_id STRING, seq BIGINT, us BIGINT, consecutive_failures BIGINT, state STRING, opened_us BIGINT"
)
CIRCUIT_STATE = "streak BIGINT, state STRING, opened_us BIGINT"

PIECE = 10_000  # rows of a key that are objects at a time

WATERMARK = "spark.watermarkDelayMs"

Step = Callable[[tuple, "tuple | None", object], "tuple[tuple | None, tuple | None]"]
Fold = Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]


def _stage_step(key: tuple, open_stage: tuple | None, event) -> tuple[tuple | None, tuple | None]:
    """Keeps the open stage of a run and gives it out once it is closed."""
    closed = None if open_stage is None else (key[0], *open_stage, event.us)
    return ((event.stage, event.us) if event.event == "stage_start" else None), closed


def _run_step(key: tuple, state: tuple | None, event) -> tuple[tuple | None, tuple | None]:
    """Keeps the status of a run and gives it out when it changes. Final states do not move."""
    status = state[0] if state else PENDING
    if status in (SUCCEEDED, RUN_FAILED) or event.status == status:
        return (status,), None
    return (event.status,), (key[0], event.status, event.us)


def _circuit_step(failure_threshold: int, circuit_timeout: float) -> Step:
    """Keeps failure streak, state and opening time of a key; gives out the state after every call."""
    timeout_us = int(circuit_timeout * 1_000_000)

    def step(key: tuple, state: tuple | None, call) -> tuple[tuple | None, tuple | None]:
        streak, circuit, opened = state or (0, ACTIVE, 0)
        if call.ok:
            still_open = circuit == CIRCUIT_OPEN and call.us - opened < timeout_us
            streak, circuit = 0, CIRCUIT_OPEN if still_open else ACTIVE
        else:
            streak += 1
            circuit = CIRCUIT_OPEN if streak >= failure_threshold else FAILED
            opened = call.us if circuit == CIRCUIT_OPEN else opened
        return (streak, circuit, opened), (*key, call.seq, call.us, streak, circuit, opened)

    return step


def _run(step: Step, key: tuple, state: tuple | None, events: Iterable) -> tuple[tuple | None, list[tuple]]:
    out = []
    for event in events:
        state, row = step(key, state, event)
        if row is not None:
            out.append(row)
    return state, out


def _at_once(step: Step, columns: list[str], fields: list[str]) -> Fold:
    """Folds the rows of a micro-batch as they are.

    The rows of a key are kept as columns; ``PIECE`` of them at a time become objects.
    """

    def fold(key: tuple, rows: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        whole = pd.concat([frame[fields] for frame in rows], ignore_index=True)
        us, seq = whole["us"], whole["seq"]
        if us.hasnans or seq.hasnans:
            order = sorted(range(len(whole)), key=lambda i: (us[i], seq[i]))
        else:
            order = np.lexsort((seq.to_numpy(), us.to_numpy()))
        state = group.get if group.exists else None
        for start in range(0, len(whole), PIECE):
            events = whole.iloc[order[start : start + PIECE]].itertuples(index=False)
            state, out = _run(step, key, state, events)
            if out:
                yield pd.DataFrame(out, columns=columns)
        if state is not None:
            group.update(state)
        elif group.exists:
            group.remove()

    return fold


def _held(step: Step, columns: list[str], fields: list[str], ttl: float | None) -> Fold:
    """Folds the rows that the watermark has passed and holds the others, until it has passed them too."""
    Event = namedtuple("Event", fields)
    at = fields.index("us")
    keep_us = None if ttl is None else int(ttl * 1_000_000)

    def fold(key: tuple, rows: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        saved = json.loads(group.get[0]) if group.exists else {"state": None, "held": [], "last": None}
        passed = group.getCurrentWatermarkMs() * 1000
        held = saved["held"]
        for frame in rows:
            held.extend(list(e) for e in frame[fields].itertuples(index=False))
        held.sort(key=lambda e: (e[at], e[fields.index("seq")]))
        ready = [e for e in held if e[at] < passed]
        rest = held[len(ready) :]
        state, last, out = saved["state"] and tuple(saved["state"]), saved["last"], []
        for event in ready:
            if keep_us is not None and last is not None and event[at] - last > keep_us:
                state = None
            state, rows_out = _run(step, key, state, [Event(*event)])
            out += rows_out
            last = event[at]
        ends = [rest[0][at]] if rest else [last + keep_us] if keep_us is not None and last is not None and state is not None else []
        if rest or (state is not None and not (keep_us is not None and last is not None and last + keep_us < passed)):
            group.update((json.dumps({"state": state, "held": rest, "last": last}),))
            if ends:
                group.setTimeoutTimestamp(max(ends[0], passed) // 1000 + 1)
        elif group.exists:
            group.remove()
        if out:
            yield pd.DataFrame(out, columns=columns)

    return fold


def _keyed(
    df: DataFrame, keys: list[str], step: Step, rows: str, state: str, lateness: str | None, ttl: float | None
) -> DataFrame:
    timed = df.withColumn("us", F.unix_micros("ts"))
    columns = [field.split()[0] for field in rows.split(", ")]
    fields = [c for c in timed.columns if c not in (*keys, "ts")]
    if lateness is None:
        fold = _at_once(step, columns, fields)
        return timed.drop("ts").groupBy(*keys).applyInPandasWithState(fold, rows, state, "append", GroupStateTimeout.NoTimeout)
    fold = _held(step, columns, fields, ttl)
    if WATERMARK not in timed.schema["ts"].metadata:  # the stream may bring its own
        timed = timed.withWatermark("ts", lateness)
    return timed.groupBy(*keys).applyInPandasWithState(fold, rows, "saved STRING", "append", GroupStateTimeout.EventTimeTimeout)


def stage_stream(progress: DataFrame, lateness: str | None = None, ttl: float | None = None) -> DataFrame:
    """Closed stages with their seconds. ``progress``: a stream of run_id, ts, seq, event, stage.

    With ``lateness`` a stage comes out once the watermark has passed its end; ``ttl`` seconds forget an open stage.
    """
    marks = progress.where(progress.event.isin(*STAGE_BOUNDARIES)).select("run_id", "ts", "seq", "event", "stage")
    return _keyed(marks, ["run_id"], _stage_step, STAGE_ROWS, STAGE_STATE, lateness, ttl).select(
        "run_id",
        "stage",
        F.timestamp_micros("started_us").alias("started_at"),
        F.timestamp_micros("ended_us").alias("ended_at"),
        ((F.col("ended_us") - F.col("started_us")) / 1e6).alias("seconds"),
    )


def run_state_stream(events: DataFrame, lateness: str | None = None, ttl: float | None = None) -> DataFrame:
    """Status changes of runs. ``events``: a stream of run_id, ts, seq, message.

    ``lateness`` as for stages; ``ttl`` seconds after its last line a run is forgotten, final or not.
    """
    marked = events.select("run_id", "ts", "seq", run_status().alias("status")).where("status IS NOT NULL")
    return _keyed(marked, ["run_id"], _run_step, STATUS_ROWS, STATUS_STATE, lateness, ttl).select(
        "run_id", "status", F.timestamp_micros("updated_us").alias("updated_at")
    )


def circuit_stream(
    calls: DataFrame,
    failure_threshold: int = FAILURE_THRESHOLD,
    circuit_timeout: float = CIRCUIT_TIMEOUT,
    lateness: str | None = None,
    ttl: float | None = None,
) -> DataFrame:
    """Circuit state after every call. ``calls``: a stream of provider, key_id, ts, seq, status_code.

    ``lateness`` as for stages; a key without calls for ``ttl`` seconds starts anew, so it should exceed the time-out.
    """
    marked = calls.select("provider", "key_id", "ts", "seq", succeeded().alias("ok"))
    step = _circuit_step(failure_threshold, circuit_timeout)
    return _keyed(marked, ["provider", "key_id"], step, CIRCUIT_ROWS, CIRCUIT_STATE, lateness, ttl).select(
        "provider",
        "key_id",
        "seq",
        F.timestamp_micros("us").alias("ts"),
        "consecutive_failures",
        "state",
        F.when(F.col("state") == CIRCUIT_OPEN, F.timestamp_micros("opened_us")).alias("circuit_open_time"),
    )
