import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from govflow.llm import nearest


def brute(rows, every=50, k=5):
    """query id -> [(vec_id, cosine)], nearest first, of (id, vector)."""
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for a, (i, q) in enumerate(usable):
        if i % every == 0:
            scores = [(-float((q * v).sum() / np.sqrt((q * q).sum()) / np.sqrt((v * v).sum())), j) for b, (j, v) in enumerate(usable) if b != a and len(v) == len(q)]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted((round(s, 12), j) for s, j in scores)[:k])]
    return sorted(out)


def result(spark, rows, kind="float", **more):
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, row int, size int").repartition(3)
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in nearest.neighbours(table, **more).collect())


def single(rows):
    return [(i, np.array(v, np.float32).tolist() if v is not None and None not in v else v) for i, v in rows]


def test_edge_cases_with_every_list_probed(spark, monkeypatch):
    monkeypatch.setattr(nearest, "REACHED", 1.0)
    monkeypatch.setattr(nearest, "TEST", 50.0)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=20).tolist()) for i in range(120)] + [(i, [1.0] * 20) for i in range(150, 230)] + [(i, [2.0] * 20) for i in range(300, 330)]
    rows += [(50, [1.0] * 20), (500, None), (550, []), (600, [0.0] * 20), (650, [None] + [1.0] * 19), (700, [float("nan")] * 20), (750, [float("inf")] * 20), (None, [1.0] * 20)]
    rows += [(800, [1.0, 2.0, 3.0]), (801, [1.0, 2.0, 3.5]), (850, [3.0, 1.0, 3.0]), (900, [4.0])]
    rows = single(rows)
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(0, [1.0, 2.0])], [(i, [1.0, float(i)]) for i in range(4)]])
def test_few_vectors(spark, rows):
    assert result(spark, rows, "double") == brute(rows)


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CELL_BYTES", 4 * 64 * 100)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 64))
    rows = single([(i, (centres[i % 12] * 0.6 + rng.normal(size=64)).tolist()) for i in range(4000)])
    want, got = brute(rows), result(spark, rows)
    assert len(got) == len(want) == 400
    shared = {(q, v) for q, _, v, _ in want} & {(q, v) for q, _, v, _ in got}
    assert len(shared) >= 0.9 * len(want)
    score = {(q, v): s for q, _, v, s in want}
    assert all(abs(score[q, v] - s) < 1e-9 for q, _, v, s in got if (q, v) in score)


def test_very_large_and_small_components(spark):
    rows = [(i, [1e200 * (1 + i), 1e200, -1e190 * i]) for i in range(5)] + [(50 + i, [1e-200 * (1 + i), 1e-200, 3e-205]) for i in range(5)]
    found = result(spark, rows, "double")
    assert len(found) == 10 and all(-1 <= s <= 1 + 1e-12 for *_, s in found)


def test_candidates_are_abandoned():
    rng = np.random.default_rng(6)
    x = nearest.turned(np.repeat(rng.normal(size=(20, 64)), 100, axis=0) + 0.7 * rng.normal(size=(2000, 64)))[rng.permutation(2000)]
    blocks = [np.ascontiguousarray(x[:, i : i + 16]) for i in range(0, 64, 16)]
    cosines = x[:20] @ x.T
    fifth = np.sort(cosines, axis=1)[:, -6]
    q, c, looked = nearest.survivors(x[:20], blocks, fifth, 5)
    kept = set(zip(q.tolist(), c.tolist(), strict=True))
    true = [(i, j) for i in range(20) for j in np.argsort(-cosines[i])[:6].tolist()]
    assert sum(p in kept for p in true) >= 0.97 * len(true)
    assert looked < 0.75 * 20 * 2000 * 4 and len(q) < 0.02 * 20 * 2000


def test_queries_from_outside(spark):
    rng = np.random.default_rng(7)
    rows = single([(i, rng.normal(size=16).tolist()) for i in range(300)])
    index = nearest.build(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    asked = spark.createDataFrame([(7, rows[9][1]), (8, None), (9, [1.0])], "query_id long, vector array<float>")
    got = nearest.search(index, nearest.outside(index, asked)).where(F.col("rank") == 1).collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(7, 9)]
