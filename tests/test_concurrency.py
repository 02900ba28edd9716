import random

import pytest

from govflow.operators import concurrency


@pytest.mark.parametrize("seconds", [1.0, 7.0, 1e9])
def test_against_plain_counting(spark, seconds):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), rng.choice([None, *range(60)])) for _ in range(300)] + [("none", 5, 5), ("none", 9, 3)]
    table = spark.createDataFrame(rows, "model string, begin long, `end` long").repartition(3)
    want = []
    for model in ("a", "b", None):
        mine = [(b, e) for m, b, e in rows if m == model and b is not None and (e is None or e > b)]
        count = lambda t, mine=mine: sum(b <= t and (e is None or e > t) for b, e in mine)
        times = sorted({t for r in mine for t in r if t is not None})
        peak = max(map(count, times))
        want.append((model, peak, float(min(t for t in times if count(t) == peak)), count(25)))
    got = concurrency.gauges(table, "model", 25.0, seconds=seconds)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_gate(spark):
    rows = [("p", 0, 2, 9, None), ("p", 1, 3, None, None), ("p", 1, None, 4, "full"), ("p", 2, None, None, None), ("q", 0, None, 1, "late"), ("q", 0, None, 2, "late"), (None, 5, 6, 7, None)]
    table = spark.createDataFrame(rows, "project string, queued long, admitted long, finished long, rejected string")
    got = {r.project: tuple(r)[1:] for r in concurrency.gate(table, "project", 3.0).collect()}
    # At 2 the first request has been admitted; the others wait.
    assert got == {"p": (2, 3, 2, 2, "full=1"), "q": (0, 2, 0, 0, "late=2"), None: (0, 1, 0, 1, "")}
    assert concurrency.gate(table.limit(0), "project", 3.0).collect() == []
