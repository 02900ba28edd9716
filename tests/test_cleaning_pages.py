"""Cleaning works on pages that hold their lines: no window or sort over lines, tables told by the lines beside, common keys by document."""

import random

from pyspark.sql import functions as F

from govflow.functions import text as T
from govflow.operators import cleaning

PAGES = "doc_id long, page_no long, text string"
BODY = "words of page {} that stand on no other page and are long enough for a line"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_clean_has_no_window_over_lines_and_one_text_scan_for_the_keys(spark, tmp_path):
    spark.createDataFrame([(1, 1, "a\nb")], PAGES).write.parquet(str(tmp_path / "p"))
    found = plan(cleaning.clean(spark.read.parquet(str(tmp_path / "p"))))
    # The one window is over the keys of a document.
    assert found.count("Window [") == 1 and found.count("windowspecdefinition(doc_id") == 1
    assert found.count("FileScan parquet") == 2


def test_no_length_is_asked_for_below_the_steps(spark):
    pages = spark.createDataFrame([(1, 1, "a\nb")], PAGES)
    assert "size(" not in "".join(x for x in plan(cleaning.spread(cleaning.held(pages))).splitlines() if "Filter" in x)


def test_tables_by_the_lines_beside_equal_runs(spark):
    draw, rows = random.Random(3), []
    for page in range(200):
        rows.append((1, page, "\n".join(draw.choice(["x", "a | b | c", "--- | --- | ---", "1 | 2"]) for _ in range(draw.randint(1, 9)))))
    got = {(r.page_no, r.line_no): r.table for r in cleaning.tables(cleaning.lines_of(spark.createDataFrame(rows, PAGES))).collect()}
    for _, page, text in rows:
        lines = [T.Line(x) for x in text.split("\n")]
        for i in range(len(lines)):
            run = [i]
            while run[0] > 0 and lines[run[0] - 1].pipe:
                run.insert(0, run[0] - 1)
            while run[-1] + 1 < len(lines) and lines[run[-1] + 1].pipe:
                run.append(run[-1] + 1)
            want = lines[i].pipe and (len(run) >= 3 or len(run) == 2 and any(lines[j].separator for j in run))
            assert got[page, i] == want


def test_common_keys_meet_all_pages_of_a_long_document_and_none_without_an_id(spark):
    rows = [(d, p, f"Report head {p}\n{BODY.format(chr(97 + p % 26) * (p // 26 + 1))}\nbody again {'z' * p}\nlast {'y' * p}") for d in (1, None) for p in range(1, 61)]
    done = cleaning.clean(spark.createDataFrame(rows, PAGES)).where("rule = 'c1'").groupBy("doc_id").agg(F.count(F.lit(1)), F.max("line_no")).collect()
    assert [tuple(r) for r in done] == [(1, 60, 0)]


def test_only_ascii_space_is_trimmed(spark):
    row = spark.createDataFrame([(" \t x  \u2028",)], "t string").select(T.strip(F.col("t")).alias("t")).first()
    assert row.t == "x  \u2028"
