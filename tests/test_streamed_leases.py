import datetime
from types import SimpleNamespace

from govflow.streaming import leases

START = datetime.datetime(2024, 1, 1)
SCHEMA = "id long, seq long, ts timestamp, kind string, status string, claimed_by string, lease_until long, seconds long, at long, reason string"


def run(spark, tmp_path, batches):
    leases.use_timers(spark)
    source, name = f"{tmp_path}/events", "leases_out"
    for batch in batches:
        rows = [(i, seq, START + datetime.timedelta(seconds=at), kind, *(more.get(k) for k in ("status", "claimed_by", "lease_until", "seconds")), at, more.get("reason")) for i, seq, at, kind, more in batch]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = leases.judged_leases(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/checkpoint").start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def test_outcomes_and_timers(spark, tmp_path):
    base = int(START.timestamp())
    task = lambda i, until, status="RUNNING", holder="w1": (i, 0, 0, "task", {"status": status, "claimed_by": holder, "lease_until": until})
    first = [task(1, 100), task(2, 100), task(3, None, "QUEUED"), task(4, 10), task(5, 100, holder=None), task(6, 100, "DONE")]
    second = [
        (1, 1, 50, "heartbeat", {"claimed_by": "w1", "seconds": 60}), (1, 2, 60, "heartbeat", {"claimed_by": " "}), (2, 1, 50, "heartbeat", {"claimed_by": "w2"}), (2, 2, 51, "release", {"reason": " busy "}), (2, 3, 52, "heartbeat", {"claimed_by": "w1"}),
        (3, 1, 50, "release", {}), (4, 1, 50, "heartbeat", {"claimed_by": "w1"}), (5, 1, 50, "heartbeat", {"claimed_by": "w1"}), (5, 2, 51, "heartbeat", {}), (6, 1, 50, "release", {}), (9, 1, 50, "heartbeat", {}),
    ]
    # Leases are seconds of the same clock as the watermark.
    shifted = lambda batch: [(i, s, at, k, m | ({"lease_until": m["lease_until"] + base} if m.get("lease_until") is not None else {})) for i, s, at, k, m in batch]
    late = [(7, 0, 9000, "task", {"status": "QUEUED"}), (7, 1, 9001, "release", {})]

    def with_clock(batch):
        return [(i, s, at, k, m) for i, s, at, k, m in shifted(batch)]

    rows = run_with_base(spark, tmp_path, [with_clock(first), with_clock(second), with_clock(late)], base)
    told = {(r.id, r.seq): (r.outcome, r.status, None if r.lease_until is None else r.lease_until - base, r.reason) for r in rows if r.kind != "timer"}
    assert told == {
        (1, 1): ("renewed", "RUNNING", 110, None), (1, 2): ("renewed", "RUNNING", 1860, None), (2, 1): ("other_holder", "RUNNING", 100, None), (2, 2): ("released", "QUEUED", 100, "RELEASE:busy"), (2, 3): ("not_running", "QUEUED", 100, None),
        (3, 1): ("queued", "QUEUED", None, None), (4, 1): ("expired", "RUNNING", 10, None), (5, 1): ("expired", "RUNNING", 100, None), (5, 2): ("renewed", "RUNNING", 1851, None), (6, 1): ("refused", "DONE", 100, None), (9, 1): ("not_running", None, None, None), (7, 1): ("queued", "QUEUED", None, None),
    }
    assert sorted((r.id, r.lease_until - base) for r in rows if r.kind == "timer") == [(1, 1860), (4, 10), (5, 1851)]


def run_with_base(spark, tmp_path, batches, base):
    """``at`` in the seconds of the leases."""
    real = spark.createDataFrame

    class Shifted:
        def __getattr__(self, name):
            return getattr(spark, name)

        def createDataFrame(self, rows, schema):
            return real([(*r[:8], r[8] + base, r[9]) for r in rows], schema)

    return run(Shifted(), tmp_path, batches)


def test_tasks_of_a_bucket_share_state_and_timer():
    """One read and write of a state for all tasks of a bucket; each is judged by itself and lapses once."""

    class Held:
        value, calls, timers = None, 0, set()

        def getValueState(self, name, schema):
            return self

        def get(self):
            return self.value

        def exists(self):
            return self.value is not None

        def update(self, value):
            self.value, self.calls = value, self.calls + 1

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    row = lambda i, seq, kind, **more: SimpleNamespace(**dict.fromkeys(("status", "claimed_by", "lease_until", "seconds", "reason")) | {"id": i, "seq": seq, "kind": kind, "at": 50} | more)
    held, judge = Held(), leases.Leases()
    judge.init(held)
    first = [row(i, 0, "task", status="RUNNING", claimed_by="w1", lease_until=100 + (i or 2) % 3) for i in (*range(1, 300), None)]
    assert list(judge.handleInputRows((7,), iter(first), None)) == [] and held.calls == 1 and held.timers == {100_000}
    told = list(judge.handleInputRows((7,), iter([row(1, 2, "release"), row(3, 1, "heartbeat", claimed_by="w2"), row(1, 1, "heartbeat", seconds=60), row(999, 1, "release")]), None))
    assert [(r.id, r.seq, r.outcome, r.lease_until) for r in told] == [(1, 1, "renewed", 110), (1, 2, "released", 110), (3, 1, "other_holder", 100), (999, 1, "refused", None)]

    def lapsed(fired, now):
        held.timers.remove(fired)
        at = SimpleNamespace(getExpiryTimeInMs=lambda: fired)
        return {r.id for r in judge.handleExpiredTimer((7,), SimpleNamespace(getCurrentWatermarkInMs=lambda: now), at)}

    assert lapsed(100_000, 100_500) == {i for i in range(1, 300) if i % 3 == 0} and held.timers == {101_000}
    assert lapsed(101_000, 200_000) == {i for i in range(2, 300) if i % 3} | {None} and held.timers == set()
