"""Text rules, checks, cleaning and chunking on literals."""

import decimal

import pytest
from pyspark.sql import functions as F

from govflow.functions import checks
from govflow.functions import text as T
from govflow.operators import chunking, cleaning, retrieval


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


@pytest.mark.parametrize(("raw", "folded"), [("7，982，300.00", "7,982,300.00"), ("a：b；c（d）e％f／g－h", "a:b;c(d)e%f/g-h"), ("甲　乙", "甲 乙"), ("中文标点。不动", "中文标点。不动"), (None, "")])
def test_fold(spark, raw, folded):
    assert value(spark, T.fold(F.lit(raw).cast("string"))) == folded


def test_query_terms(spark):
    terms = value(spark, T.query_terms(F.lit("如何付款 K100AI-8B")))
    assert "付款" in terms and "k100ai-8b" in terms and "如何" not in terms
    assert value(spark, T.query_terms(F.lit("款 x"))) == ["x", "款"]
    assert value(spark, T.query_terms(F.lit("招 a 标"))) == ["a", "招标"]
    assert value(spark, T.query_terms(F.lit(""))) == []


def test_chunk_keys_parse(spark):
    key = value(spark, T.chunk_key(F.lit("ab12"), F.lit(3), F.lit("x"), F.lit(1), F.lit(2)))
    parsed = value(spark, T.parse_chunk_key(F.lit(key)))
    assert (parsed.doc, parsed.page, parsed.clean_rev, parsed.chunk_rev) == ("ab12", 3, 1, 2)
    brief = value(spark, T.parse_chunk_key(T.chunk_key(F.lit("ab12"), F.lit(3), F.lit("x"))))
    assert brief.hash == parsed.hash and brief.clean_rev is None
    assert value(spark, T.parse_chunk_key(F.lit("nonsense"))) is None


LINES = ["# a", "### b c", "第三章 总则", "第二节 范围", "1.2 x", "1.2.3.4 y", "Short", "A sentence.", "Ends here!", "第五条 付款", "- item", "", "x", "1、clause", "（一）part", "w" * 31, "冒号：", "| a | b |"]


def test_line_rules_agree_in_both_forms(spark):
    rows = spark.createDataFrame([(x,) for x in LINES], "t string").select("t", T.heading_level(F.col("t")).alias("level"), T.is_clause(F.col("t")).alias("clause"), T.is_bullet(F.col("t")).alias("bullet"), T.ends_sentence(F.col("t")).alias("ends"), T.is_boundary(F.col("t")).alias("boundary"), T.is_pipe_row(F.col("t")).alias("pipe")).collect()
    for r in rows:
        line = T.Line(r.t)
        assert (r.level, r.clause, r.bullet, r.ends, r.boundary, r.pipe) == (line.level, line.clause, line.bullet, line.ends_sentence, line.boundary, line.pipe), r.t
    levels = {r.t: r.level for r in rows}
    assert [levels[x] for x in LINES[:8]] == [1, 3, 1, 2, 2, 4, 6, 6] and levels["Ends here!"] == 0 and levels["第五条 付款"] == 0


@pytest.mark.parametrize(("text", "amount"), [("柒佰柒拾捌万元整", 7_780_000), ("壹亿贰仟万元整", 120_000_000), ("叁仟贰佰壹拾元整", 3_210), ("拾万元整", 100_000), ("零", None), ("", None), (None, None)])
def test_amounts_in_words(text, amount):
    assert checks.amount_in_words(text) == (None if amount is None else decimal.Decimal(amount))


def pages(spark, *texts):
    return spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(texts)], "doc_id string, page_no long, text string")


def test_amount_case(spark):
    found = checks.amount_case(pages(spark, "总价¥7,780,000.00（大写：柒佰柒拾捌万元整）", "总价7,780,001.00（柒佰柒拾捌万元整）", "no amounts 1.5")).collect()
    assert {r.page_no: r.status for r in found} == {1: "pass", 2: "fail"}


@pytest.mark.parametrize(("text", "status"), [("70% 30%", "pass"), ("70% 20%", "warn"), ("70% 29%", "pass"), ("70% 28%", "warn"), ("70%\n30％", "pass"), ("70%\n\n30%", None), ("7．5% 92.5%", "pass")])
def test_percent_sum(spark, text, status):
    assert [r.status for r in checks.percent_sum(pages(spark, text)).collect()] == ([status] if status else [])


def test_number_style_and_traceability(spark):
    assert [r.styles for r in checks.number_style(pages(spark, "1,234 and 1234", "7,780,000.00 7780000")).collect()] == ["1,234 | 1234"]
    result = value(spark, checks.traceable(F.lit("about 1,200.50 and 30"), F.lit("1200.5 of 0")))
    assert (result.status, result.missing) == ("warn", ["30"])
    assert value(spark, checks.traceable(F.lit("none"), F.lit("1"))).status == "skip"
    assert value(spark, checks.traceable(F.lit("7 0"), F.lit("7.00"))).status == "pass"


@pytest.mark.parametrize(("text", "result"), [("1 + 2*3", "7"), ("(1,000 - 1) / 3", "333"), ("-2e3", "-2000"), ("0.1+0.2", "0.3")])
def test_calculator(text, result):
    assert format(checks.calculate(text).normalize(), "f") == result


@pytest.mark.parametrize("text", ["1/0", "2**3", "7//2", "5%2", "a", "", "__import__('os')", "1" * 201, "(1", "1,000 1"])
def test_calculator_rejects(text):
    with pytest.raises(ValueError):
        checks.calculate(text)


def test_calculator_column(spark):
    row = value(spark, checks.calculated(F.lit("1/4")))
    assert row.value == "0.25" and row.error is None and value(spark, checks.calculated(F.lit("1/0"))).error


def test_headers_go_only_when_they_repeat(spark):
    three = pages(spark, *[f"某某项目招标文件 第 {i} 页\nbody {i} of text\nend {'x' * i}" for i in (1, 2, 3)])
    removed = cleaning.repeated_edges(cleaning.tables(cleaning.lines_of(three))).where("rule = 'c1'").collect()
    assert {(r.page_no, r.line_no) for r in removed} == {(1, 0), (2, 0), (3, 0)} | {(r.page_no, 1) for r in removed if r.line_no == 1}
    two = pages(spark, "first heading\nalpha\nbeta gamma", "other title\ndelta\nepsilon")
    assert cleaning.repeated_edges(cleaning.tables(cleaning.lines_of(two))).where("rule = 'c1'").count() == 0


def test_clean_merges_lines_and_keeps_tables(spark):
    text = "The first line goes on and is long enough to\ncontinue here with a long line and a hyphen-\nated word of the sentence which then ends.\n\n\n\n| a | b |\n|---|---|\n| 1    | 2 |\n12\n第 3 页 共 9 页"
    done = cleaning.clean(pages(spark, text)).orderBy("line_no").collect()
    kept = [r.text for r in done if r.rule is None]
    assert kept[0] == "The first line goes on and is long enough to continue here with a long line and a hyphenated word of the sentence which then ends."
    assert kept.count("") == 1 and "| 1    | 2 |" in kept
    assert {r.text: r.rule for r in done}["12"] == "c2" and {r.total_pages for r in done} == {None, 9}


def test_paragraph_duplicates(spark):
    p = "a paragraph that is long enough to count"
    found = cleaning.paragraphs(cleaning.lines_of(pages(spark, f"{p}\n\nshort\n\n{p}", f"{p}\n\nshort")).withColumn("rule", F.lit(None).cast("string"))).collect()
    assert sorted((r.page_no, r.paragraph, r.duplicate) for r in found) == [(1, 0, False), (1, 1, False), (1, 2, True), (2, 0, True), (2, 1, False)]


def brute_pack(text, limit=500):
    import re

    parts = [p.strip() for p in re.split(r"\n\s*\n", text.strip()) if p.strip()]
    if len(parts) <= 1:
        parts = [p.strip() for p in text.split("\n") if p.strip()]
    out, buffer = [], ""
    for p in parts:
        if buffer and len(buffer) + len(p) > limit:
            out, buffer = [*out, buffer], p
        else:
            buffer = f"{buffer}\n{p}" if buffer else p
    return out + [buffer] if buffer else out


def test_plain_chunks_against_brute_force(spark):
    texts = ["", " \n ", "one", "a\n\nb\n\n" + "c" * 600, "\n".join("x" * n for n in (200, 250, 60, 500, 1, 1)), "p1\nstill\n\np2 " + "y" * 480 + "\n \n" + "z" * 30]
    got = {r.page_no: r.c for r in pages(spark, *texts).select("page_no", chunking.packed(F.col("text")).alias("c")).collect()}
    assert [got[i + 1] for i in range(len(texts))] == [brute_pack(t) for t in texts]


def test_tables_stay_whole_or_repeat_their_header(spark):
    table = lambda n: "\n".join(["| name | amount |", "|---|---|", *[f"| row {i} of the table | {i} |" for i in range(n - 2)]])
    whole = chunking.structured_chunks(pages(spark, table(26))).collect()
    assert [(r.is_table, r.table_rows) for r in whole] == [(True, 26)]
    split = chunking.structured_chunks(pages(spark, table(302))).orderBy("order_in_page").collect()
    assert len(split) > 1 and all(len(r.text) <= 2000 and r.text.startswith("【表格：name amount】\n| name | amount |\n|---|---|\n") for r in split)
    assert sum(r.table_rows - 2 for r in split) == 300


def test_structured_chunks(spark):
    body = "A sentence that fills some space in the chunk and goes on for a while! " * 5
    rows = chunking.structured_chunks(pages(spark, f"# One\n{body}\n{body}\n## Two\n{body}", f"{body}\n{'x' * 4500}")).orderBy("page_no", "order_in_page").collect()
    assert [r.section_path for r in rows][:1] == ["# One"] and rows[-1].section_path == "# One > ## Two"
    assert all(len(r.text) <= 2000 for r in rows) and max(r.page_no for r in rows) == 2
    assert any(r.text.startswith("## Two") for r in rows)
    second = [r for r in rows if r.page_no == 1][1]
    assert second.text.split("\n")[0] in body and len(second.text.split("\n")[0]) <= 60


def test_evaluation(spark):
    cases = spark.createDataFrame([(1, "d", [1, 2, 3], None), (2, "d", [9], None), (3, "d", [9], ["k"]), (4, None, [], None), (5, "other", [2], None)], "case_id long, doc_id string, pages array<long>, keys array<string>")
    hits = spark.createDataFrame([(i, 1, "d", 7, "k") for i in range(1, 6)] + [(i, 2, "d", 2, "z") for i in range(1, 6)], "case_id long, rank int, doc_id string, page_no long, chunk_key string")
    found = {r.case_id: (r.recall, r.rr, r.status) for r in retrieval.judged(cases, hits).collect()}
    assert found == {1: (0.3333, 0.5, "PASS"), 2: (0.0, 0.0, "FAIL"), 3: (1.0, 1.0, "PASS"), 4: (None, None, "SKIPPED_UNLABELED"), 5: (0.0, 0.0, "FAIL")}
    assert retrieval.overall(retrieval.judged(cases.where("case_id = 4"), hits)).collect()[0].recall is None


def test_keyword_search_folds_widths(spark):
    chunks = spark.createDataFrame([("a", "总价７，９８２，３００．００元"), ("b", "nothing")], "chunk_key string, text string")
    queries = spark.createDataFrame([(1, "7,982,300.00"), (2, "")], "query_id long, text string")
    assert [(r.query_id, r.chunk_key) for r in retrieval.keyword_scores(chunks, queries).collect()] == [(1, "a")]


def test_scopes(spark):
    chunks = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "chunk_key string, doc_id string")
    meta = spark.createDataFrame([("1", "p"), ("2", None), ("3", "")], "doc_id string, project_id string")
    ids = lambda scope: {r.doc_id for r in retrieval.in_scope(chunks, meta, scope).collect()}
    assert ids({"project_id": None}) == {"1", "2", "3"} and ids({"project_id": {"p", ""}}) == {"1"} and ids({"project_id": set()}) == set()


def test_cosine_edge_cases(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", []), ("d", [0.0, 0.0]), ("e", [1.0]), ("f", [-1.0, 0.0])], "chunk_key string, vector array<float>")
    queries = spark.createDataFrame([(1, [2.0, 0.0])], "query_id long, vector array<float>")
    assert {r.chunk_key: r.vec_score for r in retrieval.vector_scores(rows, queries).collect()} == {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0, "e": 0.0, "f": -1.0}


def test_counters_add_up_what_cleaning_left(spark):
    texts = ["Report 1\nfirst line of it.\n\n\nsecond \ufffd line.\n- 1 -", "Report 2\na | b | c\n1 | 2 | 3\n4 | 5 | 6\n- 2 -", ""]
    frame = pages(spark, *texts)
    cleaned = cleaning.clean(frame)
    rows = cleaned.collect()
    left = {}
    for r in sorted(rows, key=lambda r: (r.page_no, r.line_no)):
        left.setdefault(r.page_no, [])
        if r.rule is None:
            left[r.page_no].append(r.text)
    after = sum(len("\n".join(lines)) for lines in left.values())
    got = cleaning.counters(frame, cleaned).collect()
    assert len(got) == 1
    before = sum(map(len, texts))
    assert (got[0].chars_before, got[0].chars_after, got[0].removed_lines) == (before, after, sum(r.rule is not None for r in rows))
    assert (got[0].table_lines, got[0].lost_chars, got[0].removed_ratio) == (3, 1, round((before - after) / before, 4))
    assert got[0].removed_lines >= 4 and after < before
