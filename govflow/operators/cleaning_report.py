"""What cleaning did: counters by document, how often each rule fired, and the difference as clipped JSON.

Lines are summed up by page in the tasks that hold them; only a row a page, or the first removed lines, go on. Where lines
are asked for several times, they are written once, so that cleaning isn't done again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govflow.functions import text as T
from govflow.operators.cleaning import LEAST_PARAGRAPH, keyed_paragraphs

from .durable import durable

SAMPLES, MOST_CHARS = 20, 4000


def page_counters(pages: DataFrame, cleaned: DataFrame, supported: Column | None = None) -> DataFrame:
    """A row for each page: supported, before_chars, after_chars, removed_lines, all_removed, table_blocks, table_chars,
    replacement_chars, and last_total (line_no, total) of its last page-number line with a total above zero.

    pages: doc_id, page_no (one row each), text; ``cleaned`` holds the lines of the supported ones. A page that isn't
    supported comes out as it was. A page is all removed when it had text and only blank lines are left.
    """
    kept = F.col("rule").isNull()
    # A table begins where the line before is in none; only the numbers of table lines are collected, so no line is shuffled.
    held = F.array_sort(F.collect_list(F.when(F.col("table"), F.col("line_no"))))
    total = F.when(F.col("total_pages") > 0, F.struct("line_no", F.col("total_pages").alias("total")))
    by_page = cleaned.groupBy("doc_id", "page_no").agg(
        (F.coalesce(F.sum(F.when(kept, F.char_length("text"))), F.lit(0)) + F.greatest(F.count_if(kept) - 1, F.lit(0))).alias("after"),
        F.coalesce(F.bool_or(kept & (T.strip(F.col("text")) != "")), F.lit(False)).alias("filled"),
        F.count_if(~kept).alias("removed_lines"),
        held.alias("_held"),
        F.coalesce(F.sum("table_chars"), F.lit(0)).alias("table_chars"),
        F.coalesce(F.sum("lost_chars"), F.lit(0)).alias("replacement_chars"),
        F.max(total).alias("last_total"),
    )
    begins = F.filter("_held", lambda x, i: F.coalesce(F.get("_held", i - 1) != x - 1, F.lit(True)))
    by_page = by_page.withColumn("table_blocks", F.size(begins).cast("long")).drop("_held")
    text, on = F.coalesce("text", F.lit("")), F.struct("doc_id", "page_no")
    rows = pages.select("doc_id", "page_no", F.coalesce(F.lit(True) if supported is None else supported, F.lit(False)).alias("supported"), F.char_length(text).alias("before_chars"), (T.strip(text) != "").alias("had_text"))
    rows = rows.join(by_page.select(on.alias("_page"), *by_page.columns[2:]), on == F.col("_page"), "left")
    counts = ("removed_lines", "table_blocks", "table_chars", "replacement_chars")
    return rows.select(
        "doc_id",
        "page_no",
        "supported",
        "before_chars",
        F.when(F.col("supported"), F.coalesce("after", F.lit(0))).otherwise(F.col("before_chars")).alias("after_chars"),
        (F.col("supported") & F.col("had_text") & ~F.coalesce("filled", F.lit(False))).alias("all_removed"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        "last_total",
    )


def document_counters(pages: DataFrame, cleaned: DataFrame, supported: Column | None = None) -> DataFrame:
    """``page_counters`` by document: pages (all, cleaned, skipped, all removed), characters before, after and removed with
    their ratio (four digits, halves up), removed lines, duplicate paragraphs, tables, replacement characters, and the
    total that the last page number with one tells."""
    return _document_counters(pages, durable(cleaned, "cleaned-lines"), supported)


def _document_counters(pages: DataFrame, cleaned: DataFrame, supported: Column | None) -> DataFrame:
    by_page = page_counters(pages, cleaned, supported)
    sums = by_page.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if("supported").alias("pages_cleaned"),
        F.count_if(~F.col("supported")).alias("pages_skipped"),
        F.count_if("all_removed").alias("pages_all_removed"),
        *[F.sum(c).cast("long").alias(c) for c in ("before_chars", "after_chars", "removed_lines", "table_blocks", "table_chars", "replacement_chars")],
        F.max(F.when(F.col("last_total").isNotNull(), F.struct("page_no", "last_total"))).alias("last"),
    )
    same = keyed_paragraphs(cleaned).where(F.char_length("key") >= LEAST_PARAGRAPH).groupBy("doc_id", "key").agg((F.count(F.lit(1)) - 1).alias("again"))
    repeats = same.where("again > 0").groupBy("doc_id").agg(F.sum("again").alias("duplicate_paragraphs"))
    removed = F.greatest(F.col("before_chars") - F.col("after_chars"), F.lit(0))
    rows = sums.join(repeats.select(F.struct("doc_id").alias("_doc"), "duplicate_paragraphs"), F.struct("doc_id") == F.col("_doc"), "left").drop("_doc")
    return rows.withColumns(
        {
            "duplicate_paragraphs": F.coalesce("duplicate_paragraphs", F.lit(0)),
            "removed_chars": removed,
            "removed_ratio": F.when(F.col("before_chars") > 0, T.rounded(removed / F.col("before_chars"), 4)).otherwise(0.0),
            "total_pages": F.col("last.last_total.total"),
        }
    ).drop("last")


def rules_fired(cleaned: DataFrame) -> DataFrame:
    """doc_id, rule, lines: how many lines each rule has removed; rules that didn't fire have no row."""
    return cleaned.where("rule is not null").groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("lines"))


def cleaning_diff(pages: DataFrame, cleaned: DataFrame, supported: Column | None = None, samples: int = SAMPLES, most: int = MOST_CHARS) -> DataFrame:
    """doc_id, content: counters, rules fired and the first removed lines by page and line, as JSON of at most ``most``
    characters. The best places of each task are kept before the shuffle, so a document's lines never meet."""
    cleaned = durable(cleaned, "cleaned-lines")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "line_no"))
    first = cleaned.where("rule is not null").select("doc_id", "page_no", "line_no", "rule", "text").withColumn("place", place).where(F.col("place") <= samples)
    held = first.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "page_no", "rule", F.col("text").alias("line")))).alias("x"))
    fired = rules_fired(cleaned).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "lines")))).alias("rules_fired"))
    rows = _document_counters(pages, cleaned, supported)
    for name, part in (("x", held), ("rules_fired", fired)):
        rows = rows.join(part.select(F.struct("doc_id").alias("_doc"), name), F.struct("doc_id") == F.col("_doc"), "left").drop("_doc")
    removed = F.transform(F.coalesce("x", F.array().cast(held.schema["x"].dataType)), lambda x: F.struct(x["page_no"].alias("page_no"), x["rule"].alias("rule"), x["line"].alias("line")))
    whole = F.to_json(F.struct(*[c for c in rows.columns if c != "x"], removed.alias("removed_samples")))
    return rows.select("doc_id", F.left(whole, F.lit(most)).alias("content"))
