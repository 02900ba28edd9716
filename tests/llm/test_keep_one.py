"""What stays of null ids, null texts, repeated rows and empty tables, with all columns."""

from govflow.llm import exact_dedup, near_dedup

SCHEMA = "doc_id long, text string, keep string, digest string"
TEXT = "one two three four five six seven eight nine ten"
ROWS = [(1, TEXT, "a", None), (1, TEXT, "b", "x"), (2, TEXT, "c", None), (None, TEXT, "d", None), (None, "only here", "e", None), (None, "only here", "f", None), (3, None, "g", None), (4, "", "h", None)]


def names(rows):
    return sorted(r.keep for r in rows.collect())


def test_exact(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and names(kept) == ["c", "e", "f", "h"]
    assert names(exact_dedup.keep_one(docs.limit(0))) == []


def test_near(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and names(kept) == ["a", "b", "d", "e", "f", "g", "h"]
    assert names(near_dedup.keep_one(docs.limit(0))) == []
