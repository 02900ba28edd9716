"""Open sections and chunks page by page, against the plain walk over a whole document."""

import random
import tracemalloc

import pyarrow as pa

from govflow.operators import chunking

LINES = ["# One", "## Two", "### Three", "#### Four", "##### Five", "###### Six", "第三章 总则", "第二节 范围", "1.2 x", "1.2.3.4 y", "words that are too long for a heading of their own, so plain", "", "| a | b |", "|---|---|", "# in | a | table", "第五条 付款", "A sentence."]
SCHEMA = "doc_id string, page_no long, text string"


def walk(texts):
    """The path at the begin of each page, and the chunks, from line to line with one stack of headings."""
    path, starts, chunks = [], [], []
    for number, text in enumerate(texts, 1):
        starts.append((number, list(path)))
        page = chunking._Page(chunking.Options(chunk=80, most=200), path, text or "")
        chunks += [(number, *x) for x in page.out]
        for table, block in chunking._blocks(text or ""):
            for line in [] if table else block:
                if line.text and 0 < line.level < 6:
                    del path[line.level - 1 :]
                    path.append(line.text)
    return starts, chunks


def test_paths_and_chunks_equal_the_walk(spark):
    draw = random.Random(8)
    docs = {name: ["\n".join(draw.choices(LINES if draw.random() < 0.7 else LINES[10:], k=draw.randint(0, 9))) for _ in range(draw.randint(1, 40))] for name in "abcdefgh"}
    docs["nothing"] = [None, "", "plain"]
    rows = [(d, n, text) for d, texts in docs.items() for n, text in enumerate(texts, 1)]
    draw.shuffle(rows)
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for size in (3, 1024):
        paths = {(r.doc_id, r.page_no): r.path for r in chunking.open_sections(pages, size).collect()}
        assert paths == {(d, n): p for d, texts in docs.items() for n, p in walk(texts)[0]}
        got = sorted((tuple(r) for r in chunking.structured_chunks(pages, chunking.Options(chunk=80, most=200), size).collect()), key=lambda r: r[:3])
        assert got == sorted(((d, *c) for d, texts in docs.items() for c in walk(texts)[1]), key=lambda r: r[:3])
    assert max(len(p) for p in paths.values()) == 5


def test_null_ids_repeated_pages_and_no_pages(spark):
    long = "words that are too long for a heading of their own, so plain"
    pages = spark.createDataFrame([(None, 1, f"# A\n{long}"), (None, 2, long), ("d", 1, "# B"), ("d", 1, "# B"), ("d", 2, long)], SCHEMA)
    rows = sorted((r.doc_id or "", r.page_no, r.text, r.section_path) for r in chunking.structured_chunks(pages, pages_a_block=1).collect())
    assert rows == [("", 1, f"# A\n{long}", "# A"), ("", 2, long, "# A"), ("d", 1, "# B", "# B"), ("d", 1, "# B", "# B"), ("d", 2, long, "# B")]
    assert chunking.structured_chunks(pages.limit(0)).collect() == []


def test_table_counters(spark):
    long = "words that are too long for a heading of their own, so plain"
    pages = spark.createDataFrame([("d", 1, f"{long}\n| a | b |\n|---|---|\n| 1 | 2 |"), ("d", 2, long)], SCHEMA)
    found = chunking.table_counters(chunking.structured_chunks(pages)).collect()[0].asDict()
    assert found == {"chunks": 3, "mean_chars": round((2 * len(long) + 29) / 3), "max_chars": len(long), "over_limit": 0, "overlapped": 1, "table_chunks": 1, "table_rows": 3, "max_table_chars": 29, "parents": 2}
    assert set(chunking.table_counters(chunking.structured_chunks(pages.limit(0))).collect()[0]) == {0}


def test_a_worker_holds_one_page_and_one_slice():
    """Of a batch of 7 million characters the strings of about a million are there at a time."""
    page = "# head\n" + "\n".join(f"| {i} | words of a row |" for i in range(200)) + "\n" + "words of a line that is too long for a heading\n" * 200
    n = 500
    batch = pa.RecordBatch.from_pydict({"doc_id": [str(i) for i in range(n)], "page_no": [1] * n, "text": [page] * (n - 1) + [None], "path": [["# a"]] * n})
    chunks = len(chunking._Page(chunking.Options(), ["# a"], page).out)
    steps = (chunking._headings, batch.drop_columns("path"), 2 * n - 1), (lambda x: chunking._chunks(x, chunking.Options()), batch, chunks * (n - 1))
    for step, given, want in steps:
        rows, ids = 0, set()
        tracemalloc.start()
        for out in step(iter([given])):
            assert out.num_rows <= chunking.SLICE_ROWS and out.nbytes < 4 * chunking.SLICE_CHARS
            rows += out.num_rows
            ids.update(out.column("doc_id").to_pylist())
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == want and len(ids) >= n - 1 and peak < 5 << 20


def test_ids_of_any_type(spark):
    long = "words that are too long for a heading of their own, so plain"
    pages = spark.sql(f"SELECT explode(array(date'2020-01-02', NULL)) AS doc_id, 1.5BD AS page_no, '# A\\n{long}' AS text")
    rows = chunking.structured_chunks(pages)
    assert rows.columns == ["doc_id", "page_no", "order_in_page", "text", "is_table", "table_rows", "section_path"]
    assert sorted((str(r.doc_id), str(r.page_no), r.order_in_page, r.text, r.is_table, r.table_rows, r.section_path) for r in rows.collect()) == [(d, "1.5", 0, f"# A\n{long}", False, 0, "# A") for d in ("2020-01-02", "None")]
