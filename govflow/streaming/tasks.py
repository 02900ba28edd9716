"""The task state machine and lease expiry over a stream of events."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from govflow.operators.tasks import TASK_EDGES

OUTPUT = "run long, seq long, before string, after string, legal boolean"


def judged_transitions(events: DataFrame) -> DataFrame:
    """run, seq, before, after, legal of a stream of events (run, seq, ts, state).

    State per run is its last state. Within a batch a run's events are taken by seq; the source has to deliver the
    batches of a run in order. An illegal event is reported and changes nothing.
    """

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else ""
        rows: list[tuple[Any, ...]] = []
        for event in pd.concat(list(frames)).sort_values("seq").itertuples():
            legal = event.state == now or event.state in TASK_EDGES.get(now, ())
            rows.append((key[0], event.seq, now, event.state, legal))
            now = event.state if legal else now
        state.update((now,))
        yield pd.DataFrame(rows, columns=["run", "seq", "before", "after", "legal"])

    return events.select("run", "seq", "state").groupBy("run").applyInPandasWithState(judge, OUTPUT, "state string", "append", GroupStateTimeout.NoTimeout)


def expired_leases(events: DataFrame, lease_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """run, expired_at of runs that stay RUNNING for longer than their lease, as event time passes.

    A RUNNING event (also a heartbeat) renews the lease, any other state ends it; the watermark fires what is left.
    """

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            until = state.get[0]
            state.remove()
            yield pd.DataFrame({"run": [key[0]], "expired_at": [pd.Timestamp(until, unit="ms")]})
            return
        last = pd.concat(list(frames)).sort_values(["ts", "seq"]).iloc[-1]
        if last["state"] == "RUNNING":
            until = int(last["ts"].timestamp() * 1000) + lease_seconds * 1000
            state.update((until,))
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    return events.withWatermark("ts", delay).groupBy("run").applyInPandasWithState(watch, "run long, expired_at timestamp", "until long", "append", GroupStateTimeout.EventTimeTimeout)


def state_counts(events: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """window_start, state, n: events by state in tumbling windows; late ones beyond the watermark are dropped."""
    counts = events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "state").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "state", "n")
