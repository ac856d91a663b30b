"""Jobs as a running machine: keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from deedloom import fixed
from deedloom.streaming.jobs import stored_batches

RUN_SCHEMA = "job_id string, started_at timestamp, ended_at timestamp, status string, error_message string, events long"
# of the open run: microseconds of start, last event and since when it waits; then the events not yet final
_STATE = "started long, last long, status string, waiting long, events long, times array<long>, statuses array<string>"
_SECOND = 1_000_000


def _deadline(run: list, heartbeat: int, ready: int) -> int:
    _, last, _, waiting, _ = run
    silent = last + heartbeat * _SECOND
    return silent if waiting is None else min(silent, waiting + ready * _SECOND)


def _walk(
    key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState, heartbeat: int, ready: int, delay: int
) -> Iterator[pd.DataFrame]:
    """Events that can no longer be preceded move the run of one job on; timers end it where none comes."""
    run, pending = None, []
    if state.exists:
        *run, times, statuses = state.get
        run = None if run[0] is None else run
        pending = list(zip(times, statuses))
    for chunk in chunks:
        pending += zip(chunk["us"].tolist(), chunk["status"].tolist())
    pending.sort()
    watermark = state.getCurrentWatermarkMs() * 1000
    # an event older than the newest one less the delay is late for the next batch at the latest
    final = max(watermark, pending[-1][0] - delay * _SECOND) if pending else watermark
    out = []

    def end(at: int, status: str, message: str | None) -> None:
        out.append((key[0], run[0], at, status, message, run[4]))

    done = 0
    for us, status in pending:
        if us > final:
            break
        done += 1
        if run is not None and us > (limit := _deadline(run, heartbeat, ready)):
            end(limit, "failed", "Timeout")
            run = None
        if run is None:
            run = [us, us, status, None, 0]
        waits = status == fixed.JOB_WAITING
        run = [run[0], us, status, (us if run[3] is None else run[3]) if waits else None, run[4] + 1]
        if status in fixed.JOB_TERMINAL:
            end(us, status, None)
            run = None
    pending = pending[done:]
    if run is not None and not (pending and pending[0][0] <= _deadline(run, heartbeat, ready)) and _deadline(run, heartbeat, ready) < final:
        end(_deadline(run, heartbeat, ready), "failed", "Timeout")
        run = None
    if run is None and not pending:
        if state.exists:
            state.remove()
    else:
        state.update((*(run or [None] * 5), [u for u, _ in pending], [s for _, s in pending]))
        wake = min(([_deadline(run, heartbeat, ready)] if run else []) + ([pending[0][0]] if pending else []))
        state.setTimeoutTimestamp(max(wake // 1000 + 1, state.getCurrentWatermarkMs() + 1))
    if not out:
        return
    columns = ["job_id", "started_at", "ended_at", "status", "error_message", "events"]
    rows = pd.DataFrame(out, columns=columns)
    for c in ("started_at", "ended_at"):
        rows[c] = pd.to_datetime(rows[c], unit="us", utc=True)
    yield rows


def job_runs(
    events: DataFrame, heartbeat: int = fixed.JOB_HEARTBEAT_TIMEOUT, ready: int = fixed.JOB_READY_TIMEOUT, delay: int = 600, folder: str | None = None
) -> DataFrame:
    """Ended runs of each job from a stream of its status events (STR-02): job_id, ts (timestamp) and status.

    A run begins with the first event of a job, and again with the first after an end. It ends with a terminal status
    (completed, failed, cancelled), or fails with a timeout: `heartbeat` seconds after its last event, or `ready`
    seconds after it began to wait for the user, whichever comes first; any other status ends the waiting. An event at
    the limit itself is in time.

    Events may come in any order within `delay` seconds of the newest; those later than that are dropped, as state has
    moved on. Events of the same time go by status. State holds the open runs and the events of their last `delay` seconds, a
    timer in event time ends silent runs, and an end removes the state. A batch orders the events of one job
    in one task, numbers and status only, so the source's batch size is the bound for a busy job. Rows without job, time or status are
    ignored. What is still open stays in the state; with a `folder` the next run goes on from there.
    """
    given = events.where("job_id is not null and ts is not null and status is not null").withWatermark("ts", f"{delay} seconds")
    lean = given.selectExpr("cast(job_id as string) as job_id", "ts", "unix_micros(ts) as us", "cast(status as string) as status")
    runs = lean.groupBy("job_id").applyInPandasWithState(
        partial(_walk, heartbeat=heartbeat, ready=ready, delay=delay), RUN_SCHEMA, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return stored_batches(runs, folder).drop("batch")
