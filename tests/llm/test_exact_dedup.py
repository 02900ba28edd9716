import hashlib

from govflow.llm import exact_dedup


def brute(rows):
    out = []
    for i, t in rows:
        same = [j for j, u in rows if (u or "") == (t or "")]
        known = [j for j in same if j is not None]
        keep = max(known) if known else None
        out.append((i, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rows = [(i, ["a", "b", "", None, "é", "é", "a ", "x" * 100_000][i % 8]) for i in range(200)]
    rows += [(None, "a"), (None, "only null"), (None, "only null"), (7, "x" * 100_000), (500, "single")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, digest string").repartition(7)
    got = sorted((tuple(r) for r in exact_dedup.exact_dedup(docs).collect()), key=repr)
    assert got == brute(rows)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.where("text = 'a'").select("doc_id").collect()[0][0] == max(i for i, t in rows if t == "a" and i is not None)


def test_digest_collisions_are_told_apart_by_content(spark, monkeypatch):
    class Clashing:
        def __getattr__(self, name):
            return getattr(real, name)

        def sha2(self, c, n):
            return real.sha2(real.lit("same"), n)

    real = exact_dedup.F
    monkeypatch.setattr(exact_dedup, "F", Clashing())
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, None)]
    got = sorted(tuple(r)[:4] for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True), (4, 4, 1, True)]


def test_empty_table(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
