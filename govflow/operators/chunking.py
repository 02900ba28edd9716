"""Chunks of pages: the plain packer as expressions, the structure-aware one page by page, and their counters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govflow.functions import text as T
from govflow.operators.durable import durable

CHUNK_CHARS, MAX_CHARS, PAGE_LINES = 500, 2000, 10
DEEPEST, PAGES_A_BLOCK = 5, 1024
#: Characters and rows that a task's worker collects before it hands them back.
SLICE_CHARS, SLICE_ROWS = 1 << 20, 2000


def pages_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", page_lines: int = PAGE_LINES) -> DataFrame:
    """doc_id, page_no (from 1), text: blocks of lines stand for the pages of a document.

    There is a block at least, which ``outer`` tells: Spark would else ask for their number first, with the text split anew
    for every block."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size("lines") / page_lines).cast("int") - 1), lambda i: F.array_join(F.slice("lines", i * page_lines + 1, F.lit(page_lines)), "\n"))
    rows = docs.select(F.col(id_col).alias("doc_id"), lines.alias("lines")).select("doc_id", F.posexplode_outer(blocks).alias("page_no", "text"))
    return rows.select("doc_id", (F.col("page_no") + 1).cast("long").alias("page_no"), "text")


def packed(text: Column, limit: int = CHUNK_CHARS) -> Column:
    """Chunks of one page: blank-line paragraphs (lines where there is only one) joined while they fit ``limit``; a long
    paragraph stays whole, and the joining line breaks don't count towards the next paragraph."""

    def parts(pattern):
        return F.filter(F.transform(F.split(T.strip(text), pattern, -1), T.strip), lambda x: x != "")

    paragraphs = parts(r"\n\s*\n")
    chosen = F.when(F.size(paragraphs) > 1, paragraphs).otherwise(parts("\n"))

    def add(done, p):
        last = F.element_at(done, -1)
        fits = (F.size(done) > 0) & (F.char_length(last) + F.char_length(p) <= limit)
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(last, F.lit("\n"), p)))).otherwise(F.concat(done, F.array(p)))

    # element_at of an empty array is asked for only when the size says that there is one.
    safe = lambda done, p: F.when(F.size(done) == 0, F.array(p)).otherwise(add(done, p))
    return F.aggregate(chosen, F.array().cast("array<string>"), safe)


def plain_chunks(pages: DataFrame, limit: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, page_no, order_in_page (from 0), text, chunk_key, parent_key."""
    rows = pages.select("doc_id", "page_no", F.posexplode(packed(F.coalesce("text", F.lit("")), limit)).alias("order_in_page", "text"))
    doc = F.col("doc_id").cast("string")
    return rows.withColumns({"chunk_key": T.chunk_key(doc, F.col("page_no"), F.col("text")), "parent_key": F.concat(doc, F.lit(":p="), F.col("page_no").cast("string"))})


@dataclass(frozen=True)
class Options:
    """Sizes in characters. The overlap is at most 0.15 of a chunk; the hard limit is never below the chunk size."""

    chunk: int = CHUNK_CHARS
    most: int = MAX_CHARS
    overlap: float = 0.12

    def __post_init__(self):
        object.__setattr__(self, "overlap", min(0.15, max(0.0, self.overlap)))
        object.__setattr__(self, "most", max(self.most, self.chunk))


def _blocks(text: str):
    """(is a table, lines) of a page: runs of rows with pipes, three or two with a separator row, and what is between."""
    lines, at = [T.Line(x) for x in text.split("\n")], 0
    while at < len(lines):
        end = at
        while end < len(lines) and lines[end].pipe == lines[at].pipe:
            end += 1
        block = lines[at:end]
        yield block[0].pipe and (len(block) >= 3 or (len(block) == 2 and any(x.separator for x in block))), block
        at = end


class _Page:
    """Chunks of one page, from the section path that is open where it begins."""

    def __init__(self, options: Options, path: list[str], text: str):
        self.options, self.path, self.order, self.last, self.out = options, list(path), 0, "", []
        for table, block in _blocks(text):
            if table:
                self._table([x.text for x in block])
            else:
                self._prose(block)

    def _section(self, line: T.Line) -> None:
        if 0 < line.level <= DEEPEST:
            del self.path[line.level - 1 :]
            self.path.append(line.text)

    def _units(self, block):
        """(text, section, boundary): paragraphs where the block has blank lines, else lines."""
        by_line = all(x.text for x in block)
        held: list[T.Line] = []
        for line in [*block, T.Line("")]:
            if line.text:
                if not held:
                    first_boundary = line.boundary
                self._section(line)
                held.append(line)
                section = " > ".join(self.path) if len(held) == 1 else section
            if held and (by_line or not line.text):
                yield "\n".join(x.text for x in held), section, first_boundary
                held = []

    def _prose(self, block) -> None:
        held, section = "", ""
        for text, where, boundary in self._units(block):
            if held and (boundary or len(held) + 1 + len(text) > self.options.chunk or len(text) > self.options.most):
                self._emit(held, section)
                held = ""
            if len(text) > self.options.most:
                for piece in self._cut(text):
                    self._emit(piece, where)
                continue
            if not held:
                section, start = where, "" if boundary else self._overlap()
                held = f"{start}\n{text}" if start else text
            else:
                held = f"{held}\n{text}"
        self._emit(held, section)

    def _cut(self, text: str) -> list[str]:
        """Sentences joined up to the hard limit; longer ones by characters."""
        out, most = [""], self.options.most
        for sentence in re.findall(f"[^{T.SENTENCE_MARKS}]*[{T.SENTENCE_MARKS}]|[^{T.SENTENCE_MARKS}]+$", text):
            if len(sentence) > most:
                out += [sentence[i : i + most] for i in range(0, len(sentence), most)] + [""]
            elif len(out[-1]) + len(sentence) > most:
                out.append(sentence)
            else:
                out[-1] += sentence
        return [x for x in out if x]

    def _overlap(self) -> str:
        """The end of the chunk before, from behind its last sentence end within the window if there is one."""
        window = int(self.options.chunk * self.options.overlap)
        tail = self.last[-window:] if window else ""
        ends = [i for i, c in enumerate(tail[:-1]) if c in T.SENTENCE_MARKS]
        return (tail[ends[-1] + 1 :] if ends and len(self.last) > window else tail).strip()

    def _table(self, rows: list[str]) -> None:
        """A table as one chunk, or its rows with the header again in each."""
        section, whole = " > ".join(self.path), "\n".join(rows)
        if len(whole) <= self.options.most:
            self._emit(whole, section, len(rows))
        else:
            n = 2 if T.Line(rows[1]).separator else 1
            title = " ".join(rows[0].replace("|", " ").split())
            head = f"【表格：{title if len(title) <= 60 else title[:60] + '…'}】\n" + "\n".join(rows[:n]) + "\n"
            body: list[str] = []
            for row in rows[n:]:
                if body and len(head) + sum(map(len, body)) + len(body) + len(row) > self.options.most:
                    self._emit(head + "\n".join(body), section, len(body) + n)
                    body = []
                body.append(row)
            self._emit(head + "\n".join(body), section, len(body) + n)
        self.last = ""  # nothing overlaps with a table

    def _emit(self, text: str, section: str, table_rows: int = 0) -> None:
        text = text.strip()
        for piece in [text] if len(text) <= self.options.most else self._cut(text):
            if piece:
                self.out.append((self.order, piece, table_rows > 0, table_rows, section))
                self.order, self.last = self.order + 1, piece


def _by_page(batches: Iterator[pa.RecordBatch], of_page: Callable, texts: tuple[str, ...], **others: pa.DataType) -> Iterator[pa.RecordBatch]:
    """doc_id, page_no and a page's rows, which ``of_page`` gives for its other columns: strings (``texts``) and ``others``.

    Pages are taken out of their batch one by one, and rows go back in slices: besides Spark's batch, which has a bound of
    its own in rows and bytes, a worker holds the strings of one page and one slice."""

    def made(batch, at, rows, kinds):
        ids = batch.select(["doc_id", "page_no"]).take(pa.array(at, pa.int32()))
        columns = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
        return pa.RecordBatch.from_arrays([*ids.columns, *columns], names=[*ids.schema.names, *kinds])

    for batch in batches:
        kinds, inputs = dict.fromkeys(texts, batch.schema.field("text").type) | others, batch.columns[2:]
        at, rows, chars = [], [], 0
        for i in range(batch.num_rows):
            for row in of_page(*(x[i].as_py() for x in inputs)):
                at.append(i)
                rows.append(row)
                chars += sum(len(x or "") for x in row[: len(texts)])
                if chars >= SLICE_CHARS or len(rows) == SLICE_ROWS:
                    yield made(batch, at, rows, kinds)
                    at, rows, chars = [], [], 0
        if rows:
            yield made(batch, at, rows, kinds)


def _headings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row at the begin of each page (place 0, no level) and one for each heading outside of its tables."""

    def of_page(text):
        yield None, 0, None
        lines = (x for table, block in _blocks(text or "") if not table for x in block)
        yield from ((x.text, i, x.level) for i, x in enumerate(lines, 1) if 0 < x.level <= DEEPEST)

    return _by_page(batches, of_page, ("text",), place=pa.int32(), level=pa.int32())


def _chunks(batches: Iterator[pa.RecordBatch], options: Options) -> Iterator[pa.RecordBatch]:
    """The chunks of each page, from its text and the path that is open where it begins."""

    def of_page(text, path):
        return ((piece, section, order, table, n) for order, piece, table, n, section in _Page(options, path, text or "").out)

    return _by_page(batches, of_page, ("text", "section_path"), order_in_page=pa.int64(), is_table=pa.bool_(), table_rows=pa.int64())


def open_sections(pages: DataFrame, pages_a_block: int = PAGES_A_BLOCK) -> DataFrame:
    """doc_id, page_no, path: the headings that are open where a page begins, outermost first.

    A heading of level L closes those from depth L on, so its depth is min(depth before + 1, L). Unrolled, the depth of
    the i-th heading of a document is the least of i and L_j + i - j over all j <= i, which is a running minimum, and the
    path is the last heading of each depth down to the present one. Both are found in blocks of pages first and carried
    from block to block as one row each, so neither a document nor its headings have to fit a task. Texts stay where they
    are: only headings are shuffled. A page without text has a path too; rows of one page share it.
    """
    kinds = dict(pages.dtypes)
    found = pages.select("doc_id", "page_no", "text").mapInArrow(_headings, f"doc_id {kinds['doc_id']}, page_no {kinds['page_no']}, text string, place int, level int")
    rows = durable(found.withColumn("block", F.floor(F.col("page_no") / pages_a_block)), "headings")
    within = Window.partitionBy("doc_id", "block").orderBy("page_no", "place", "level", "text")
    before = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def with_given(rows: DataFrame, given: DataFrame) -> DataFrame:
        """Rows with what the blocks before theirs hand on. A null id makes a document too, so structs are compared."""
        names = [c for c in given.columns if c not in ("doc_id", "block")]
        return rows.join(given.select(F.struct("doc_id", "block").alias("_block"), *names), F.struct("doc_id", "block") == F.col("_block"), "left").drop("_block")

    i, level = F.col("i"), F.col("level")
    rows = rows.withColumn("i", F.count("level").over(within)).withColumn("slack", F.min(level - i).over(within))
    sums = rows.groupBy("doc_id", "block").agg(F.count("level").alias("n"), F.min("slack").alias("least"))
    sums = sums.withColumn("i_given", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("slack_given", F.min(F.col("least") - F.col("i_given")).over(before))
    rows = with_given(rows, sums.drop("n", "least"))
    from_start = F.col("i_given") + i
    rows = rows.withColumn("depth", F.least(from_start, from_start + F.col("slack_given"), i + F.col("slack")).cast("int"))

    depths = range(1, DEEPEST + 1)
    here = {d: F.when(level.isNotNull() & (F.col("depth") == d), F.struct("i", "text")) for d in depths}
    lasts = rows.groupBy("doc_id", "block").agg(*[F.max(here[d]).alias(f"given_{d}") for d in depths])
    lasts = lasts.withColumns({f"given_{d}": F.last(f"given_{d}", ignorenulls=True).over(before) for d in depths})
    rows = with_given(rows.withColumns({f"at_{d}": F.last(here[d], ignorenulls=True).over(within) for d in depths}), lasts)
    path = F.slice(F.array(*[F.coalesce(f"at_{d}.text", f"given_{d}.text") for d in depths]), F.lit(1), F.col("depth"))
    return rows.where("place = 0").select("doc_id", "page_no", path.alias("path")).dropDuplicates(["doc_id", "page_no"])


def structured_chunks(pages: DataFrame, options: Options | None = None, pages_a_block: int = PAGES_A_BLOCK) -> DataFrame:
    """doc_id, page_no, order_in_page, text, is_table, table_rows, section_path.

    Headings and clauses begin chunks, tables stay whole, chunks overlap within a page, none is over the hard limit.
    What runs on from page to page is the section path alone (``open_sections``), so each page is a row by itself and a
    document may be of any length. A null text is an empty page; of a page that is there twice, both rows are chunked.
    """
    chosen = options or Options()
    kinds = dict(pages.dtypes)
    starts = open_sections(pages, pages_a_block).select(F.struct("doc_id", "page_no").alias("_page"), "path")
    rows = pages.select("doc_id", "page_no", "text").join(starts, F.struct("doc_id", "page_no") == F.col("_page"), "left").drop("_page")
    made = rows.mapInArrow(lambda batches: _chunks(batches, chosen), f"doc_id {kinds['doc_id']}, page_no {kinds['page_no']}, text string, section_path string, order_in_page long, is_table boolean, table_rows long")
    return made.select("doc_id", "page_no", "order_in_page", "text", "is_table", "table_rows", "section_path")


def counters(chunks: DataFrame, limit: int = CHUNK_CHARS) -> DataFrame:
    """One row: chunks, mean length (halves up), longest, over the limit, not first on their page, distinct parents."""
    n = F.char_length("text")
    return chunks.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.floor(F.avg(n) + 0.5).cast("long").alias("mean_chars"),
        F.max(n).cast("long").alias("max_chars"),
        F.count_if(n > limit).alias("over_limit"),
        F.count_if(F.col("order_in_page") > 0).alias("overlapped"),
        F.countDistinct("parent_key").alias("parents"),
    )


def table_counters(chunks: DataFrame, most: int = MAX_CHARS) -> DataFrame:
    """One row of ``structured_chunks``: chunks, mean length (halves up), longest, over the hard limit, not first on their
    page, table chunks, their rows and the longest of them, distinct pages; all 0 without chunks."""
    n, table = F.char_length("text"), F.col("is_table")
    sums = chunks.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.coalesce(F.floor(F.avg(n) + 0.5), F.lit(0)).cast("long").alias("mean_chars"),
        F.max(n).alias("max_chars"),
        F.count_if(n > most).alias("over_limit"),
        F.count_if(F.col("order_in_page") > 0).alias("overlapped"),
        F.count_if(table).alias("table_chunks"),
        F.sum(F.when(table, F.col("table_rows"))).alias("table_rows"),
        F.max(F.when(table, n)).alias("max_table_chars"),
        F.countDistinct(F.struct("doc_id", "page_no")).alias("parents"),
    )
    return sums.select(*[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in sums.columns])


def parent_summaries(chunks: DataFrame, most: int = 200) -> DataFrame:
    """parent_key, summary: the chunks of a page joined and clipped; pages of one chunk have none."""
    held = chunks.groupBy("parent_key").agg(F.array_sort(F.collect_list(F.struct("order_in_page", "text"))).alias("x")).where(F.size("x") > 1)
    return held.select("parent_key", T.clip(F.array_join(F.transform("x", lambda x: x["text"]), "\n"), most).alias("summary"))
