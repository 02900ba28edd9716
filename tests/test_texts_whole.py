"""The queries over whole texts, against brute force on a fixture."""

import re

import pytest

from govflow.plans import registry

LINES = ["short", "A line, that goes on for much longer than a heading may be.", "## mark", "1.2 part", "60% of it and 30 % more", "1,200 then 1200 and 12"]
TEXTS = ["\n".join(LINES[(i + j) % 6] for j in range(23)) for i in range(4)] + ["", "x" * 70 + " last"]
LONG = "word " * 20 + "behind"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, LONG)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    turns = [(1, 0, "user", "pay 1,200 now"), (1, 1, "bot", "1200.00 and 77"), (1, 2, "user", "6.5 and 77"), (2, 0, "user", "none 1002.5"), (2, 1, "bot", "1,002.5 units")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return at


def got(spark, tables, name):
    return [tuple(r) for r in registry.queries()[name](spark, tables).collect()]


def test_whole_texts(spark, tables):
    assert got(spark, tables, "query_terms") == [(1, 2, "behind word")]
    lines = [(d, i // 10 + 1, i % 10, x) for d, text in enumerate(TEXTS) for i, x in enumerate(text.split("\n"))]
    assert sorted(got(spark, tables, "clean_encoding")) == sorted((d, p, i, x.replace(",", "，")) for d, p, i, x in lines)
    levels = {"short": 6, "## mark": 2, "1.2 part": 2}
    want = [levels.get(x, 6 if 2 <= len(x) <= 30 and not re.match(r"\d", x) else 0) for *_, x in lines]
    assert dict(got(spark, tables, "heading_levels_plain")) == {n: want.count(n) for n in set(want)}


def test_numbers_are_read_from_the_texts(spark, tables):
    sums = {(d, p): 90 * sum(x == LINES[4] for e, q, _, x in pages if (e, q) == (d, p)) for pages in [[(d, i // 10 + 1, i, x) for d, t in enumerate(TEXTS) for i, x in enumerate(t.split("\n"))]] for d, p, *_ in pages}
    found = {(d, p, n): float(total) for d, p, n, total, _ in got(spark, tables, "percent_sum_check")}
    assert found == {(d, p, 0): float(s) for (d, p), s in sums.items() if s} | {(d, p, 1): 100.0 + p % 4 for d, p in sums}
    styles = dict(got(spark, tables, "number_style_check"))
    assert styles[1] == "1,001 | 1001; 1,200 | 1200" and styles[4] == "1,004 | 1004"
    answers = {(c, n): (status, missing) for c, n, status, missing in got(spark, tables, "answer_numbers")}
    assert answers[1, 1] == ("warn", "6.5,77") and answers[1, 2] == ("warn", "6.5") and answers[1, 0][0] == "warn"
    assert {r[0]: r[1:3] for r in got(spark, tables, "answer_rates")} == {"user": (3, 1.0), "bot": (2, 0.5)}
