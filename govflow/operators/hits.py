"""Search hits as they are shown: a snippet of the chunk, and a summary of its page where that tells more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govflow.functions import text as T

from .chunking import parent_summaries

#: Characters of a snippet and of a page's summary; words of a note that tell of a fallback (fixed values).
SNIPPET, SUMMARY = 500, 200
FALLBACK_WORDS = ("降级", "关键词", "不可用")


def shaped(hits: DataFrame, chunks: DataFrame, snippet: int = SNIPPET, summary: int = SUMMARY) -> DataFrame:
    """The columns of ``hits`` (chunk_key, ...) with doc_id, page_no, snippet and parent_summary of their chunks (chunk_key,
    doc_id, page_no, order_in_page, text, parent_key). Hits whose chunk is gone are left out.

    The summary is that of all chunks of the page, clipped; it is null for a page of one chunk, where it is what the hit
    itself says, and with a ``summary`` of 0. Only pages of hits are put together.
    """
    fields = ["chunk_key", "doc_id", "page_no", F.coalesce("text", F.lit("")).alias("chunk_text"), "parent_key"]
    found = hits.join(chunks.select(*fields), "chunk_key")
    pages = chunks.join(found.select("parent_key").distinct(), "parent_key", "left_semi")
    told = found.join(parent_summaries(pages, summary), "parent_key", "left")
    same = F.col("summary") == T.strip(F.col("chunk_text"))
    shown = F.when(F.lit(summary > 0) & ~F.coalesce(same, F.lit(True)), F.col("summary"))
    return told.select(*hits.columns, "doc_id", "page_no", T.clip(F.col("chunk_text"), snippet).alias("snippet"), shown.alias("parent_summary"))


def fallback_note(brief: Column) -> Column:
    """What stands in the first pair of brackets of a tool's note, if it tells of a fallback; else null."""
    start, end = F.instr(brief, "（"), F.instr(brief, "）")
    inside = F.when((start > 0) & (end > start), F.substring(brief, start + 1, end - start - 1))
    told = F.lit(False)
    for word in FALLBACK_WORDS:
        told = told | F.contains(inside, F.lit(word))
    return F.when(told, inside)
