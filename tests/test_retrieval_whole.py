"""Retrieval over any number of queries, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from govflow.functions import text as T
from govflow.operators import retrieval


def test_more_queries_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    rng = random.Random(1)
    vectors = [(f"k{i:03}", [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(60)] + [("none", None), ("short", [1.0]), ("zero", [0.0] * 4)]
    asked = [(i, vectors[i][1]) for i in range(30)]

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b):
            return 0.0
        norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / norm, 12) if norm else 0.0

    v, q = spark.createDataFrame(vectors, "chunk_key string, vector array<double>").repartition(3), spark.createDataFrame(asked, "query_id long, vector array<double>")
    want = {(i, key): cosine(x, y) for i, y in asked for key, x in vectors}
    assert {(r.query_id, r.chunk_key): round(r.vec_score, 9) for r in retrieval.vector_scores(v, q).collect()} == {k: round(s, 9) for k, s in want.items()}
    best = {(i, n + 1): key for i, _ in asked for n, key in enumerate(sorted((k for k, _ in vectors), key=lambda k: (-want[i, k], k))[:5])}
    assert {(r.query_id, r.rank): r.chunk_key for r in retrieval.vector_top_k(v, q, 5).collect()} == best


def test_keywords_of_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 4)
    rng = random.Random(2)
    words = ["the", "then", "he", "a.b", "x-1", "été", "合同", "付款", "aaa", "aa", "Ｔhe", "\n"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(40)] + ["", "aaaaa合同付款合同"]
    asked = [(i, texts[i] if i % 2 else texts[i][:9]) for i in range(0, 40, 2)] + [(100, "合 同"), (101, ""), (102, "été!")]
    chunks = spark.createDataFrame([(str(i), x) for i, x in enumerate(texts)], "chunk_key string, text string").repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, text string")
    lows = {r.chunk_key: r.low for r in chunks.select("chunk_key", F.lower(T.fold(F.col("text"))).alias("low")).collect()}
    want = {}
    for r in queries.select("query_id", T.normal_query(F.col("text")).alias("raw"), T.query_terms(F.col("text")).alias("terms")).collect():
        df = {t: sum(t in low for low in lows.values()) for t in r.terms}
        for key, low in lows.items():
            score = 12.0 * (r.raw != "" and r.raw in low) + sum(math.log(1 + len(lows) / (1 + df[t])) * (1 + 0.25 * min(low.count(t), 5)) for t in r.terms if t in low)
            if score > 0:
                want[r.query_id, key] = score
    assert {(r.query_id, r.chunk_key): r.kw_score for r in retrieval.keyword_scores(chunks, queries).collect()} == pytest.approx(want, abs=1e-8)
    # The best of each query, ties by key, and the pairs that are asked for.
    order = sorted(want, key=lambda pair: (pair[0], -round(want[pair], 9), pair[1]))
    best = [pair for pair in order if [p for p in order if p[0] == pair[0]].index(pair) < 3]
    last = sorted(want)[::7]
    wanted = spark.createDataFrame([*last, (101, "1"), (0, "no such")], "query_id long, chunk_key string")
    rows = retrieval.keyword_scores(chunks, queries, 3, wanted)
    found = {(r.query_id, r.chunk_key): r.kw_score for r in rows.collect()}
    assert rows.count() == len(found) < len(want) and {*best, *last} <= found.keys() and found == pytest.approx({pair: want[pair] for pair in found}, abs=1e-8)
    assert [(r.query_id, r.chunk_key) for r in retrieval.top_k(rows, "kw_score", 3).orderBy("query_id", "rank").collect()] == best


def test_keyword_scores_read_each_text_once(spark, monkeypatch):
    """Texts are read and searched once for df, scores and whole queries; a batch holds several slices of them."""
    texts = [f"an anan bananan. {'ana ' * (i % 9)}{'big data lake' if i % 4 == 0 else 'data'}" for i in range(60)]
    read = spark.sparkContext.accumulator(0)

    def marked(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    chunks = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_key string, text string").mapInPandas(marked, "chunk_key string, text string")
    queries = spark.createDataFrame([(1, "Big data lake"), (2, "anan ana an"), (3, "nowhere")], "query_id long, text string")
    monkeypatch.setattr(retrieval, "PAIRS", 70)
    found = {(r.query_id, int(r.chunk_key)): r.kw_score for r in retrieval.keyword_scores(chunks, queries).collect()}
    # Once to number the texts, once to search them.
    assert read.value == 2 * len(texts)
    want = {}
    for q, words in ((1, ["big", "data", "lake"]), (2, ["anan", "ana", "an"])):
        df = {w: sum(w in t for t in texts) for w in words}
        for i, t in enumerate(texts):
            score = sum(math.log(1 + 60 / (1 + df[w])) * (1 + 0.25 * min(t.count(w), 5)) for w in words if w in t) + 12 * (" ".join(words) in t)
            if score:
                want[q, i] = score
    assert found == pytest.approx(want, abs=1e-8)


def test_only_scores_that_reach_the_last_of_the_best_are_kept():
    rng, best, floor = random.Random(2), [[]], retrieval.np.full(1, -retrieval.np.inf)
    rows = [(rng.choice([0.1, 0.5, 0.7, 0.9, float("nan")]), f"k{i}") for i in range(90)]
    for at in range(0, 90, 7):
        retrieval._keep_best(best, floor, 0, retrieval.np.array([s for s, _ in rows[at : at + 7]]), [k for _, k in rows[at : at + 7]], 4)
    assert best[0] == sorted((-s, k) for s, k in rows if s == s)[:4] and floor[0] == -best[0][-1][0]
