"""Pages whose id is null or comes twice stay apart in the queries on cleaning rules."""

import duckdb
import pytest

from govflow.plans import registry

LONG = "words of a paragraph that is long enough to count"
ROWS = [(1, "a\nb"), (1, "a\nb"), (None, f"{LONG}\nc"), (None, f"{LONG}\nc"), (2, f"{LONG}\n{LONG}\nd"), (2, f"{LONG}\n{LONG}\nd"), (3, "a\n\n \nb\n")]


@pytest.mark.parametrize("name", ["clean_whitespace", "clean_dedupe", "clean_encoding"])
def test_as_in_sql(spark, tmp_path, name):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = registry.queries()[name](spark, str(tmp_path))
    found = duck.sql(registry.oracle_sql()[name])
    rows = [tuple(dict(zip(found.columns, r, strict=True))[c] for c in got.columns) for r in found.fetchall()]
    assert rows and sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)


def test_the_first_of_two_blank_lines_stays(spark, tmp_path):
    """The reference keeps the first one, also where a page begins with it."""
    spark.createDataFrame([(1, ""), (2, None), (3, " \na")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in registry.queries()["clean_whitespace"](spark, str(tmp_path)).collect())
    assert got == [(1, 1, 0, ""), (2, 1, 0, ""), (3, 1, 0, ""), (3, 1, 2, "a"), (3, 1, 3, "")]
