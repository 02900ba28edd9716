import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from govflow.operators import bm25

WORDS = re.compile("[一-鿿]|[^\x00-\x2f\x3a-\x60\x7b-\x7f一-鿿]+")


def brute(chunks, queries, k, live=lambda doc: True):
    bags = [(key, doc, Counter(WORDS.findall((text or "").lower()))) for key, doc, text in chunks]
    mean = sum(sum(b.values()) for *_, b in bags) / max(1, len(bags)) or 1.0
    df = Counter(t for *_, b in bags for t in b)
    out = []
    for q, text in queries:
        scores = []
        for no, (key, doc, bag) in enumerate(bags):
            s = 0.0
            for t, times in Counter(WORDS.findall((text or "").lower())).items():
                if bag[t]:
                    s += times * math.log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5)) * bag[t] / (bag[t] + 1.2 * (0.25 + 0.75 * sum(bag.values()) / mean))
            if live(doc) and any(bag[t] for t in WORDS.findall((text or "").lower())):
                scores.append((-round(s, 9), key, no))
        out += [(q, r + 1, key, round(-s, 6)) for r, (s, key, _) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def some(n, seed):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma,", "delta", "é", "x-y", "第三章", "rare"]
    return [(f"k{i}", i % 7, " ".join(rng.choices(words, [9, 7, 5, 4, 2, 2, 1, 0.2], k=rng.randrange(0, 30)))) for i in range(n)]


@pytest.mark.parametrize("span", [4, 128])
def test_against_brute_force(spark, monkeypatch, span):
    monkeypatch.setattr(bm25, "SPAN", span)
    monkeypatch.setattr(bm25, "FIRST", 1)
    chunks = some(200, 3) + [("k5", 5, "alpha alpha beta"), ("k5", 5, "alpha alpha beta"), (None, 1, "gamma"), ("n", None, None), ("e", 2, "")]
    queries = [(1, "Alpha alpha rare"), (2, "beta 第章"), (3, "unknown words"), (4, ""), (5, None), (6, "é x y delta gamma alpha beta rare")]
    table = spark.createDataFrame([(*c, 1) for c in chunks], "chunk_key string, doc_id int, text string, no int").repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, text string")
    index = bm25.build(table)
    got = lambda scope=None: sorted((r.query_id, r["rank"], r.chunk_key, round(r.score, 6)) for r in bm25.search(index, asked, 5, scope).collect())
    named = [c if c[0] is not None else ("", *c[1:]) for c in chunks]
    fix = lambda rows: sorted((q, r, k or "", s) for q, r, k, s in rows)
    assert fix(got()) == brute(named, queries, 5)
    assert fix(got(F.col("doc_id") < 3)) == brute(named, queries, 5, lambda d: d is not None and d < 3)
    assert got(F.lit(False)) == []


def test_reads_only_the_folders_and_blocks_it_needs(spark, monkeypatch):
    monkeypatch.setattr(bm25, "SPAN", 8)
    chunks = [(f"k{i:03}", i, "common words here " + ("needle " * 3 if i in (17, 130) else "") + "filler " * (i % 40)) for i in range(400)]
    index = bm25.build(spark.createDataFrame(chunks, "chunk_key string, doc_id int, text string"))
    asked = bm25.query_terms(spark.createDataFrame([(1, "needle common")], "query_id long, text string")).withColumn("weight", F.lit(1.0))
    rows = bm25.asked_postings(spark, index, asked)
    plan = rows._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and re.search(r"folder#\d+ (IN|INSET) ", plan)
    assert rows.select(bm25.folder(F.col("term"))).distinct().count() <= 2
    best = bm25.search(index, spark.createDataFrame([(1, "needle common")], "query_id long, text string"), 2).collect()
    assert [r.chunk_key for r in best] == ["k130", "k017"] or [r.chunk_key for r in best] == ["k017", "k130"]
    scored = []
    real = bm25._scored
    monkeypatch.setattr(bm25, "_scored", lambda rows, *a: scored.append(rows.select("block").distinct().count()) or real(rows, *a))
    bm25.search(index, spark.createDataFrame([(1, "needle common")], "query_id long, text string"), 2).collect()
    assert scored[-1] <= 4 < rows.select("block").distinct().count()


def test_empty_index(spark):
    index = bm25.build(spark.createDataFrame([], "chunk_key string, doc_id int, text string"))
    assert bm25.search(index, spark.createDataFrame([(1, "a")], "query_id long, text string")).collect() == []


def test_a_text_is_searched_for_its_terms_once(spark, monkeypatch):
    """Lengths and postings come from one pass; blocks are inverted some at a time."""
    monkeypatch.setattr(bm25, "SPAN", 4)
    monkeypatch.setattr(bm25, "BLOCKS", 2)
    monkeypatch.setattr(bm25, "terms_of", None)
    chunks = [*some(90, 5), ("n", 1, None), ("e", 1, "")]
    index = bm25.build(spark.createDataFrame(chunks, "chunk_key string, doc_id int, text string").repartition(2))
    bags = {key: Counter(WORDS.findall((text or "").lower())) for key, _, text in chunks}
    assert {r.chunk_key: r.length for r in index.chunks.collect()} == {key: bag.total() for key, bag in bags.items()}
    assert {r.term: r.df for r in index.terms.collect()} == Counter(t for bag in bags.values() for t in bag)
    names = {r.no: r.chunk_key for r in index.chunks.collect()}
    rows = spark.read.schema(bm25.POSTINGS).parquet(index.postings).collect()
    assert sorted((names[no], r.term, tf, n) for r in rows for no, tf, n in zip(r.nos, r.tfs, r.lengths, strict=True)) == sorted((key, t, tf, bag.total()) for key, bag in bags.items() for t, tf in bag.items())
    assert all(r.most == max(r.tfs) and r.least == min(r.lengths) and {no // 4 for no in r.nos} == {r.block} and r.nos == sorted(r.nos) for r in rows)
