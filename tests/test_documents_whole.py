"""Cycles of any length, codes of any number in use, documents of no pages."""

import random

import pytest
from pyspark.sql import functions as F

from govflow.operators import documents, hierarchy


def test_cycles_of_any_length(spark):
    rng = random.Random(3)
    parent = {i: (i + 1) % 25 for i in range(25)} | {i: i + 1 for i in range(100, 160)} | {200: 0, 201: 200, 202: 202, 203: None, 204: 999, 205: 206, 206: 205}
    parent |= {i: rng.randint(1000, 1400) for i in range(1000, 1400)}

    def cyclic(i):
        at, seen = parent.get(i), set()
        while at is not None and at != i and at not in seen:
            seen.add(at)
            at = parent.get(at)
        return at == i

    rows = spark.createDataFrame(list(parent.items()), "id long, parent_id long")
    assert sorted(r.id for r in hierarchy.on_cycle(rows).collect()) == sorted(i for i in parent if cyclic(i))
    assert hierarchy.on_cycle(rows.where("id between 100 and 159")).collect() == []
    with pytest.raises(ValueError):
        hierarchy.on_cycle(rows.union(spark.createDataFrame([(1, 7)], rows.schema)))


@pytest.mark.parametrize(("codes", "free"), [([], 1), (["P-1995-002", "P-1995-x"], 3), ([f"P-1995-{i:03}" for i in range(31, 61)], 61), ([f"P-1995-{i:03}" for i in [6, 7, 8, 9, 10, 12]], 11), (["P-1995-2", "P-1996-002"], 2)])
def test_next_code_has_no_last_try(spark, codes, free):
    rows = spark.createDataFrame([(c,) for c in codes], "code string")
    assert [r.code for r in documents.next_codes(rows, "P", 1995).collect()] == [f"P-1995-{free:03}"]


def test_documents_of_no_pages(spark):
    rows = spark.createDataFrame([(0, 1200), (0, 0), (3, 1600), (2, 1)], "pages long, chars int")
    assert [r.n for r in rows.select(documents.estimated_chunks(F.col("pages"), F.col("chars")).alias("n")).collect()] == [3, 0, 6, 2]
