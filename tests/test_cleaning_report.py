"""What cleaning did, on literals: pages that are skipped or all removed, totals, rules, and the clipped difference."""

import json

from pyspark.sql import functions as F

from govflow.operators import cleaning, cleaning_report

SCHEMA = "doc_id string, page_no long, text string, source string"
LONG = "a line of plain words that is longer than any heading may be, and then some"
OTHER = "another line of plain words that stands on one page alone, so no header"
TABLE = "a | b | c\n 1 | 2 | 3\n4 | 5 | 6 "


def report(spark, rows):
    pages, supported = spark.createDataFrame(rows, SCHEMA), F.col("source") != "ocr"
    return pages, cleaning.clean(pages.where(supported)), supported


ROWS = [
    ("d", 1, f"{OTHER}\n{TABLE}\nPage 1 of 7", "pdf"),
    ("d", 2, "- 2 -", "pdf"),
    ("d", 3, f"{LONG}\n\n{LONG}\n第 3 页 共 9 页", "pdf"),
    ("d", 4, "  as it was  ", "ocr"),
    ("d", 5, None, None),
    (None, 1, "lost � sign", "pdf"),
]


def test_counters(spark):
    rows = {r.doc_id: r for r in cleaning_report.document_counters(*report(spark, ROWS)).collect()}
    d = rows["d"]
    assert (d.pages, d.pages_cleaned, d.pages_skipped, d.pages_all_removed) == (5, 3, 2, 1)
    assert (d.removed_lines, d.table_blocks, d.table_chars, d.total_pages, d.duplicate_paragraphs) == (3, 1, len(TABLE) - 2, 9, 1)
    before = sum(len(r[2] or "") for r in ROWS if r[0])
    after = len(OTHER) + 1 + len(TABLE) - 2 + 2 * len(LONG) + 2 + len("  as it was  ")
    assert (d.before_chars, d.after_chars, d.removed_chars, d.removed_ratio) == (before, after, before - after, round((before - after) / before, 4))
    assert (rows[None].pages, rows[None].replacement_chars, rows[None].total_pages) == (1, 1, None)


def test_diff(spark):
    given = report(spark, ROWS)
    diff = {r.doc_id: r.content for r in cleaning_report.cleaning_diff(*given, samples=2).collect()}
    found = json.loads(diff["d"])
    assert found["rules_fired"] == {"c2": 3} and found["removed_samples"] == [{"page_no": 1, "rule": "c2", "line": "Page 1 of 7"}, {"page_no": 2, "rule": "c2", "line": "- 2 -"}]
    assert found["pages_all_removed"] == 1 and json.loads(diff[None])["removed_samples"] == []
    clipped = {r.doc_id: r.content for r in cleaning_report.cleaning_diff(*given, samples=2, most=50).collect()}
    assert clipped["d"] == diff["d"][:50]


def test_no_pages_and_cleaning_that_is_off(spark):
    pages, cleaned, supported = report(spark, ROWS)
    assert cleaning_report.cleaning_diff(pages.limit(0), cleaned.limit(0), supported).collect() == []
    off = cleaning_report.document_counters(pages, cleaning.clean(pages, enabled=False)).where("doc_id = 'd'").collect()[0]
    assert (off.removed_lines, off.removed_chars, off.table_blocks, off.total_pages, off.pages_all_removed) == (0, 0, 0, None, 0)
