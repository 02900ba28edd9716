"""Cleaning rules over page lines, in their fixed order, and the pages that come out.

The lines frame has doc_id, page_no, line_no (from 0), text; rules add ``table`` (the line is part of a table), change
``text`` or set ``rule`` (what removed the line). A page comes as one row, so a rule works on pages that hold their lines
(``held``: an array ``lines`` of structs in order) without any shuffle or sort of lines; given lines, it brings them
together by page first (``gathered``) and gives lines back (``spread``). Lines have no line break.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govflow.functions import text as T

# Patterns of page-number lines, full-width marks that stay, characters without width, hyphens.
PAGE_NUMBER = (r"^[-—–\s]*\d{1,4}[-—–\s]*$", r"^第\s*(\d+)\s*页(\s*共\s*(\d+)\s*页)?$", r"^(\d+)\s*/\s*(\d+)$", r"(?i)^page\s+(\d+)(\s+of\s+(\d+))?$")
# One anchored pattern for all of them; the flag stands in the last one.
ANY_PAGE_NUMBER = T.any_of(*PAGE_NUMBER)
KEPT_WIDE = "，；：？！（）"
HYPHENS = ("-", "‐", "‑")
NO_WIDTH = r"[​-‍﻿⁠]"
EDGE, LEAST_KEY, LEAST_PARAGRAPH = 2, 4, 20


WIDE = "".join(c for c in T.FULL_WIDTH if c not in KEPT_WIDE)
NARROW = "".join(h for c, h in zip(T.FULL_WIDTH, T.HALF_WIDTH, strict=True) if c not in KEPT_WIDE)
#: Slots that the pages of a document are dealt to where they meet its common keys.
SLOTS = 16


def lines_of(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, line_no, text: every line of pages (doc_id, page_no, text), empty ones too; a null page is one empty line."""
    return pages.select("doc_id", "page_no", F.posexplode_outer(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "text"))


def held(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, lines: the same lines, held by their pages."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return pages.select("doc_id", "page_no", F.transform(lines, lambda x, i: F.struct(i.alias("line_no"), x.alias("text"))).alias("lines"))


def gathered(lines: DataFrame) -> DataFrame:
    """doc_id, page_no, lines of a lines frame."""
    rest = [c for c in lines.columns if c not in ("doc_id", "page_no", "line_no")]
    return lines.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("line_no", *rest))).alias("lines"))


def spread(pages: DataFrame) -> DataFrame:
    """The lines frame of pages that hold their lines. A page has a line at least; that is told by ``outer``, as Spark would
    else ask for a length, and compute the array for it once more, below every step that makes it."""
    return pages.select("doc_id", "page_no", F.inline_outer("lines"))


def _by_page(rule: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @wraps(rule)
    def run(frame: DataFrame, *args, **kwargs) -> DataFrame:
        if "lines" in frame.columns:
            return rule(frame, *args, **kwargs)
        done = spread(rule(gathered(frame), *args, **kwargs))
        return done.select(*frame.columns, *[c for c in done.columns if c not in frame.columns])

    return run


def _fields(pages: DataFrame) -> list[str]:
    return pages.schema["lines"].dataType.elementType.names


def _line(line: Column, fields: list[str], changes: dict[str, Column]) -> Column:
    """The line's fields, some of them changed or added."""
    return F.struct(*[changes.get(f, line[f]).alias(f) for f in fields], *[c.alias(n) for n, c in changes.items() if n not in fields])


def _each(pages: DataFrame, changes: Callable[[Column], dict[str, Column]]) -> DataFrame:
    fields = _fields(pages)
    return pages.withColumn("lines", F.transform("lines", lambda x: _line(x, fields, changes(x))))


@_by_page
def encoding(lines: DataFrame) -> DataFrame:
    """Full-width letters and digits to ASCII, but for marks of sentences; counts replacement characters."""

    def changes(x):
        text = x["text"]
        lost = F.char_length(text) - F.char_length(F.replace(text, F.lit("�"), F.lit("")))
        # Translation goes character by character, so it is left to lines that need it.
        return {"text": F.when(text.rlike("[！-～]"), F.translate(text, WIDE, NARROW)).otherwise(text), "lost_chars": lost.cast("long")}

    return _each(lines, changes)


@_by_page
def tables(lines: DataFrame) -> DataFrame:
    """Mark runs of rows with two pipes or more: three rows, or two with a separator row.

    A row is in such a run if it has two rows before it, two behind it or one on each side, or if it and a row beside it
    are two of which one is a separator; so the two lines on each side tell.
    """
    fields = _fields(lines)
    rows = _each(lines, lambda x: {"_pipe": T.is_pipe_row(x["text"])})
    rows = _each(rows, lambda x: {"_ruled": x["_pipe"] & T.is_separator_row(x["text"])})

    def marked(x, i):
        def beside(n, flag="_pipe"):
            return F.coalesce(F.get("lines", i + n)[flag], F.lit(False))

        three = (beside(-1) & beside(1)) | (beside(-1) & beside(-2)) | (beside(1) & beside(2))
        two = (x["_ruled"] & (beside(-1) | beside(1))) | beside(-1, "_ruled") | beside(1, "_ruled")
        return _line(x, fields, {"table": x["_pipe"] & (three | two)})

    return rows.withColumn("lines", F.transform("lines", marked))


@_by_page
def repeated_edges(lines: DataFrame) -> DataFrame:
    """Set rule c1: lines within two of a page's begin or end whose key is at the edge of at least half of the pages
    that aren't blank (two at least).

    A page has four such lines at most, so a document has eight such keys at most; these meet its pages.
    """
    edge = lambda x, i: (x["line_no"] < EDGE) | (i >= F.size("lines") - EDGE)
    outer = F.transform(F.filter("lines", lambda x, i: edge(x, i) & ~x["table"]), lambda x: T.repeat_key(x["text"]))
    keys = F.filter(F.array_distinct(outer), lambda k: F.char_length(k) >= LEAST_KEY)
    filled = F.exists("lines", lambda x: F.char_length(T.strip(x["text"])) > 0)
    # The empty key stands for the page itself. Null ids have no keys in common.
    page = F.when(filled, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    seen = lines.where("doc_id is not null").select("doc_id", "page_no", F.explode_outer(F.concat(keys, page)).alias("_key"))
    seen = seen.where("_key is not null").groupBy("doc_id", "_key").agg(F.countDistinct("page_no").alias("_on"))
    of_doc = F.max(F.when(F.col("_key") == "", F.col("_on"))).over(Window.partitionBy("doc_id"))
    common = seen.withColumn("_pages", of_doc).where((F.col("_key") != "") & (F.col("_on") >= F.greatest(F.lit(2), F.ceil(F.col("_pages") * 0.5))))
    common = common.groupBy("doc_id").agg(F.collect_list("_key").alias("_common"))
    common = common.select("doc_id", "_common", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLOTS - 1).cast("long"))).alias("_slot"))
    # A document of many pages and pages without an id are dealt to several tasks.
    slot = F.when(F.col("doc_id").isNull(), F.xxhash64("page_no", "lines")).otherwise(F.pmod(F.xxhash64("page_no"), F.lit(SLOTS)))
    rows, fields = lines.withColumn("_slot", slot).join(common, ["doc_id", "_slot"], "left"), _fields(lines)

    def flagged(x, i):
        hit = F.col("_common").isNotNull() & edge(x, i) & ~x["table"] & F.array_contains("_common", T.repeat_key(x["text"]))
        return _line(x, fields, {"rule": F.when(hit, "c1")})

    return rows.withColumn("lines", F.transform("lines", flagged)).select(lines.columns)


def is_page_number(line: Column) -> Column:
    return T.strip(line).rlike(ANY_PAGE_NUMBER)


def total_pages(line: Column) -> Column:
    """The number of pages that a page-number line tells, else null."""
    value = T.strip(line)
    found = [F.nullif(F.regexp_extract(value, pattern, group), F.lit("")) for pattern, group in zip(PAGE_NUMBER[1:], (3, 2, 3), strict=True)]
    return F.coalesce(*found).try_cast("int")


@_by_page
def page_numbers(lines: DataFrame) -> DataFrame:
    """Set rule c2 on lines that are only a page number, and total_pages where they tell it."""
    rows = _each(lines, lambda x: {"_number": ~x["table"] & is_page_number(x["text"])})
    fields = _fields(lines)
    changes = lambda x: {"rule": F.coalesce(x["rule"], F.when(x["_number"], "c2")), "total_pages": F.when(x["_number"], total_pages(x["text"]))}
    return rows.withColumn("lines", F.transform("lines", lambda x: _line(x, fields, changes(x))))


@_by_page
def watermarks(lines: DataFrame, patterns: tuple[str, ...] = ()) -> DataFrame:
    """Set rule c8 on lines that one of the given patterns finds; none by default."""
    if not patterns:
        return lines

    def changes(x):
        hit = F.lit(False)
        for pattern in patterns:
            hit = hit | x["text"].rlike(pattern)
        return {"rule": F.coalesce(x["rule"], F.when(hit & ~x["table"], "c8"))}

    return _each(lines, changes)


def paragraphs(lines: DataFrame) -> DataFrame:
    """doc_id, page_no, paragraph, first_line, key, duplicate: blank-line paragraphs of the lines that are left.

    A paragraph repeats an earlier one of the document when their keys without white space (20 characters or more) agree.
    """
    found = keyed_paragraphs(lines)
    same = Window.partitionBy("doc_id", "key").orderBy("page_no", "paragraph")
    return found.withColumn("duplicate", (F.char_length("key") >= LEAST_PARAGRAPH) & (F.row_number().over(same) > 1))


def keyed_paragraphs(lines: DataFrame) -> DataFrame:
    """``paragraphs`` without telling the repeated ones."""
    if "lines" in lines.columns:
        pages = lines.withColumn("lines", F.filter("lines", lambda x: x["rule"].isNull()))
    else:
        pages = gathered(lines.where("rule is null").select("doc_id", "page_no", "line_no", "text"))
    # A line without white space, behind its number; a blank one ends a paragraph.
    bare = lambda x: F.regexp_replace(x["text"], r"\s+", "")
    parts = F.transform("lines", lambda x: F.when(T.strip(x["text"]) == "", "\n").otherwise(F.concat(x["line_no"].cast("string"), F.lit("\t"), bare(x), F.lit("\r"))))
    rows = pages.select("doc_id", "page_no", F.posexplode_outer(F.split(F.array_join(parts, ""), "\n", -1)).alias("paragraph", "x")).where("x <> ''")
    return rows.select(
        "doc_id",
        "page_no",
        F.col("paragraph").cast("long").alias("paragraph"),
        F.substring_index("x", "\t", 1).cast("int").alias("first_line"),
        F.regexp_replace("x", r"\d+\t([^\r]*)\r", "$1").alias("key"),
    )


@_by_page
def white_space(lines: DataFrame) -> DataFrame:
    """Set rule c3 on a blank line behind a blank line; characters without width go, ends are trimmed, and outside of
    tables three spaces or more become one. Lines that a rule has removed don't count."""
    fields = _fields(lines)

    def squeezed(x):
        plain = T.strip(F.replace(F.regexp_replace(x["text"], NO_WIDTH, ""), F.lit(T.IDEOGRAPHIC_SPACE), F.lit(" ")))
        return _line(x, fields, {"text": F.when(x["table"], plain).otherwise(F.regexp_replace(plain, r"[ \t\x0B\f]{3,}", " "))})

    def again(x, i):
        blank = (x["text"] == "") & F.coalesce(F.get("_live", i - 1)["text"] == "", F.lit(False))
        return _line(x, fields, {"rule": F.when(blank, "c3")})

    rows = lines.withColumn("_live", F.transform(F.filter("lines", lambda x: x["rule"].isNull()), squeezed))
    done = F.concat(F.transform("_live", again), F.filter("lines", lambda x: x["rule"].isNotNull()))
    return rows.withColumn("lines", F.array_sort(done)).drop("_live")


@_by_page
def merge_lines(lines: DataFrame) -> DataFrame:
    """Set rule c4 on lines that were joined to the line before them, which gets their text.

    A joined line is the end of the text so far, so whether a line goes on depends on the line before it alone, and so do
    the space between them and the hyphen that falls. No state has to be carried: each line is held against the one before
    and the one behind. Removed lines stay as they are.
    """
    fields = _fields(lines)
    whole = lambda x: [x[f].alias(f) for f in fields]

    def joints(x, i):
        here, before = x["_here"], F.get("_live", i - 1)
        goes_on = (here != "") & (before["_here"] != "") & ~x["table"] & ~before["table"]
        joined = goes_on & ~T.ends_sentence(before["_here"], stripped=True) & ~T.is_boundary(here, stripped=True)
        return F.struct(*whole(x), here.alias("_here"), F.coalesce(joined, F.lit(False)).alias("_joined"))

    def pieces(x, i):
        broken = x["_joined"] & F.right(F.get("_live", i - 1)["_here"], F.lit(1)).isin(*HYPHENS) & x["_here"].rlike("^[a-z]")
        return F.struct(*whole(x), x["_here"].alias("_here"), x["_joined"].alias("_joined"), broken.alias("_broken"))

    def piece(x):
        return F.when(x["_broken"], x["_here"]).otherwise(x["text"])

    def part(x, i):
        """What a line gives to its run; a run begins with a line break."""
        met = ~x["_broken"] & F.right(piece(F.get("_live", i - 1)), F.lit(1)).rlike("^[A-Za-z0-9,.]") & x["text"].rlike("^[A-Za-z0-9]")
        falls = F.coalesce(F.get("_live", i + 1)["_broken"], F.lit(False))
        text = F.when(falls, F.left(piece(x), F.char_length(piece(x)) - 1)).otherwise(piece(x))
        return F.concat(F.when(~x["_joined"], "\n").when(met, " ").otherwise(""), F.coalesce(text, F.lit("")))

    rows = lines.withColumn("_live", F.transform(F.filter("lines", lambda x: x["rule"].isNull()), lambda x: F.struct(*whole(x), T.strip(x["text"]).alias("_here"))))
    rows = rows.withColumn("_live", F.transform("_live", joints))
    rows = rows.withColumn("_live", F.transform("_live", pieces))
    rows = rows.withColumn("_runs", F.split(F.array_join(F.transform("_live", part), ""), "\n", -1))
    first = F.transform(F.filter("_live", lambda x: ~x["_joined"]), lambda x, i: _line(x, fields, {"text": F.get("_runs", i + 1)}))
    gone = F.transform(F.filter("_live", lambda x: x["_joined"]), lambda x: _line(x, fields, {"rule": F.lit("c4")}))
    done = F.concat(first, gone, F.filter("lines", lambda x: x["rule"].isNotNull()))
    return rows.withColumn("lines", F.array_sort(done)).drop("_live", "_runs")


def table_ranges(cleaned: DataFrame) -> DataFrame:
    """doc_id, page_no, start, end, rows: runs of table lines, by the numbers that lines have once removed ones are gone."""
    live = cleaned.where("rule is null").withColumn("_at", F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("line_no")) - 1)
    held = Window.partitionBy("doc_id", "page_no", "table").orderBy("_at")
    runs = live.withColumn("_run", F.col("_at") - F.row_number().over(held)).where("table")
    return runs.groupBy("doc_id", "page_no", "_run").agg(F.min("_at").cast("long").alias("start"), F.max("_at").cast("long").alias("end"), F.count(F.lit(1)).alias("rows")).drop("_run")


def clean(pages: DataFrame, watermark_patterns: tuple[str, ...] = (), merge: bool = True, enabled: bool = True) -> DataFrame:
    """All rules in order; lines with what removed them. Paragraph duplicates are only marked (see ``paragraphs``). Where
    cleaning isn't enabled, all lines come as they are."""
    if not enabled:
        none = {"table": F.lit(False), "rule": F.lit(None).cast("string"), "lost_chars": F.lit(0).cast("long"), "table_chars": F.lit(None).cast("int"), "total_pages": F.lit(None).cast("int")}
        return lines_of(pages).withColumns(none)
    rows = _each(tables(encoding(held(pages))), lambda x: {"table_chars": F.when(x["table"], F.char_length(x["text"]))})
    rows = watermarks(page_numbers(repeated_edges(rows)), watermark_patterns)
    return spread(white_space(merge_lines(rows) if merge else rows))


def counters(pages: DataFrame, cleaned: DataFrame) -> DataFrame:
    """doc_id, chars_before, chars_after, removed_lines, table_lines, lost_chars, removed_ratio (four digits)."""
    before = pages.groupBy("doc_id").agg(F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("chars_before"))
    kept = F.col("rule").isNull()
    page = cleaned.groupBy("doc_id", "page_no").agg(
        (F.sum(F.when(kept, F.char_length("text"))) + F.greatest(F.count_if(kept) - 1, F.lit(0))).alias("after"),
        F.count_if(~kept).alias("removed"),
        F.count_if("table").alias("rows"),
        F.sum("lost_chars").alias("lost"),
    )
    after = page.groupBy("doc_id").agg(F.coalesce(F.sum("after"), F.lit(0)).alias("chars_after"), F.sum("removed").alias("removed_lines"), F.sum("rows").alias("table_lines"), F.sum("lost").alias("lost_chars"))
    ratio = F.when(F.col("chars_before") == 0, 0.0).otherwise(F.round((F.col("chars_before") - F.col("chars_after")) / F.col("chars_before"), 4))
    return before.join(after, "doc_id").withColumn("removed_ratio", ratio)
