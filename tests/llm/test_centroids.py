import hashlib
import math

import numpy as np
import pytest

from govflow.llm import centroids


def brute(rows, k=8, rounds=10, dim=64):
    """Plain clustering of (id, vector) in Python's integers."""
    kept = [(i, [int(x) * 1024 if abs(x) > 2**60 else math.floor(1024 * x) for x in v], v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[2]))
    centres = [list(r[1]) for r in starts[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v, _ in kept]
        for j in range(len(centres)):
            mine = [v for (_, v, _), a in zip(kept, at, strict=True) if a == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *nearest(v)) for i, v, _ in kept]
    fits = lambda d: d if d < 2**63 else None
    by = {j: sum(d for _, d, c in found if c == j) for j in range(len(centres))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, fits(d), fits(by[c]), fits(sum(by.values())), digest[c]) for i, d, c in found), key=repr)


def some(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 64))
    return [(i, (centres[i % 5] * (i % 3) + rng.normal(size=64) * 0.3).astype(np.float32).tolist()) for i in range(n)]


def result(spark, rows, kind="float"):
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, block int").repartition(3)
    return sorted((tuple(r) for r in centroids.cluster(table).collect()), key=repr)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 64)
    rows = some(500, 1)
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # many copies
    rows += [(None, rows[3][1]), (None, [0.5] * 64), (3, rows[3][1]), (3, [1.0] * 64), (2000, None), (2001, []), (2002, [1.0] * 63)]
    rows += [(2003, [None] + [1.0] * 63), (2004, [float("nan")] * 64), (2005, [float("inf")] * 64), (2006, [0.0] * 64), (2007, [-0.0] * 64)]
    assert result(spark, rows) == brute(rows)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float((i * 7) % 4)] + [0.0] * 63) for i in range(60)]
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(5, [1.0] * 64)], [(i, [float(i)] * 64) for i in range(3)]])
def test_few_vectors(spark, rows):
    assert result(spark, rows) == brute(rows)


def test_components_beyond_64_bits(spark):
    rows = [(i, [1e30 * (i % 9), 1.0 + i] + [0.25] * 62) for i in range(30)] + [(50, [1.7e308] * 64)]
    assert result(spark, rows, "double") == brute(rows)


def test_looks_at_few_centroids():
    rng = np.random.default_rng(2)
    centres = [[int(x) for x in rng.integers(-10**5, 10**5, 4)] for _ in range(20)]
    vectors = np.concatenate([np.array(c) + rng.integers(-50, 50, (30, 4)) for c in centres])
    told = centroids.Centroids(centres)
    label, best, looked = told.assign(vectors, np.repeat(np.arange(20, dtype=np.int32), 30))
    every = np.array([centroids.squared(vectors, np.array(c)) for c in centres])
    assert (label == every.argmin(0)).all() and (best == every.min(0)).all()
    assert looked < 2 * len(vectors)
    wrong, _, more = told.assign(vectors, np.zeros(600, np.int32))
    assert (wrong == label).all() and looked < more <= 600 * 20
