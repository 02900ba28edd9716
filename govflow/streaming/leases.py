"""Leases of tasks as a stream: heartbeats and releases are judged against the holder and lease that the state of a task keeps,
and a timer tells when a lease ends.

The outcomes are those of ``renewed`` and ``released`` in ``govflow.operators.runs``, request by request in the order of
``seq``; there is one writer of a task's state, so no request is judged against a task that another one changes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from govflow.operators.tasks import lease

TASK, HEARTBEAT, RELEASE = "task", "heartbeat", "release"
#: Timers need the state store that keeps them.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUTPUT = "id long, seq long, kind string, outcome string, status string, lease_until long, reason string"
#: Tasks share a state by a hash of their id, as each access to a state costs more than judging a request does. A running
#: stream can't change the number.
BUCKETS = 16_384
#: The tasks of a bucket as columns; ``dues`` holds the leases that have yet to lapse.
TASKS = "ids array<long>, statuses array<string>, holders array<string>, untils array<long>, dues array<long>"


class Leases(StatefulProcessor):
    def init(self, handle) -> None:
        self.handle = handle
        self.tasks = handle.getValueState("tasks", TASKS)

    def _read(self) -> dict:
        held = self.tasks.get()
        return {} if held is None else {i: tuple(x) for i, *x in zip(*held, strict=True)}

    def _write(self, known: dict, before: int | None) -> None:
        """One timer a bucket, at the first lease that ends."""
        self.tasks.update((list(known), *map(list, zip(*known.values(), strict=True))))
        after = _first_due(known)
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before * 1000)
            if after is not None:
                self.handle.registerTimer(after * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known, requests = self._read(), defaultdict(list)
        timer = _first_due(known)
        for r in rows:
            requests[r.id].append(r)
        for i, mine in requests.items():
            status, holder, until, due = known.get(i, (None,) * 4)
            watched = until if status == "RUNNING" else None
            for r in sorted(mine, key=lambda r: r.seq):
                if r.kind == TASK:
                    status, holder, until = r.status, r.claimed_by, r.lease_until
                    continue
                outcome = reason = None
                if r.kind == HEARTBEAT:
                    caller = (r.claimed_by or "").strip() or None
                    if status != "RUNNING":
                        outcome = "not_running"
                    elif caller and holder is not None and caller != holder:
                        outcome = "other_holder"
                    elif until is not None and until > r.at and (caller is None or holder is not None):
                        outcome, until = "renewed", r.at + min(max(lease(None) if r.seconds is None else r.seconds, lease(0)), lease(10**9))
                    else:
                        outcome = "expired"
                else:
                    outcome = "released" if status == "RUNNING" else "queued" if status == "QUEUED" else "refused"
                    if outcome == "released":
                        status, holder = "QUEUED", None
                        reason = ":".join(x for x in ("RELEASE", (r.reason or "").strip()) if x)
                yield Row(id=i, seq=r.seq, kind=r.kind, outcome=outcome, status=status, lease_until=until, reason=reason)
            watch = until if status == "RUNNING" else None
            known[i] = (status, holder, until, due if watch == watched else watch)
        self._write(known, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known, now = self._read(), timerValues.getCurrentWatermarkInMs()
        fired = expiredTimerInfo.getExpiryTimeInMs()
        for i, (status, holder, until, due) in known.items():
            if due is not None and (due * 1000 < now or due * 1000 <= fired):
                known[i] = (status, holder, until, None)
                yield Row(id=i, seq=None, kind="timer", outcome="lapsed", status=status, lease_until=until, reason=None)
        self._write(known, None)  # the timer that fired is gone

    def close(self) -> None:
        pass


def _first_due(known: dict) -> int | None:
    return min((due for *_, due in known.values() if due is not None), default=None)


def use_timers(spark: SparkSession) -> None:
    """Set the session's state store; streams that are started from now on use it."""
    spark.conf.set(*STORE)


def judged_leases(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """id, seq, kind, outcome, status, lease_until, reason of a stream of events (id, seq, ts, kind, status, claimed_by,
    lease_until, seconds, at, reason).

    A ``task`` event gives a task its state and has no outcome. A ``heartbeat`` at the second ``at`` is renewed,
    other_holder, expired or not_running; a ``release`` is released, queued or refused. Once the watermark of ``ts`` has
    passed the lease of a running task, lapsed follows, once a lease. Requests for unknown tasks are not_running or refused.
    """
    rows = events.withWatermark("ts", delay).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)))
    return rows.groupBy("bucket").transformWithState(statefulProcessor=Leases(), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
