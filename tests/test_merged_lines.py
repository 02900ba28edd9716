"""Merging of lines as a window, against the plain form that walks from line to line."""

import random

from govflow.functions import text as T
from govflow.operators import cleaning

WORDS = ["alpha", "Beta,", "co-", "inter‑", "end.", "结束。", "条款", "5", "", "  ", " led-  ", "x" * 35, "- item", "第三条 付款", "1.2 scope", "a|b|c", "lower case goes on over more than thirty characters", "Über alles and more words than a heading has", "-"]
SCHEMA = "doc_id string, page_no long, line_no int, text string, table boolean, rule string, lost_chars long"


def plain(rows):
    """Lines of one page in order: the text that a line gets and the rule that removes it."""
    texts, rules, last = [r[3] for r in rows], [r[5] for r in rows], None
    for i, (_, _, _, line, table, rule, _) in enumerate(rows):
        if rule is not None:
            continue
        here = T.Line(line)
        if last is not None and here.text and texts[last].strip() and not table and not rows[last][4]:
            before = texts[last]
            if not T.Line(before).ends_sentence and not here.boundary:
                if before.strip()[-1] in "-‐‑" and here.text[0].isascii() and here.text[0].islower():
                    texts[last] = before[:-1] + here.text
                else:
                    apart = before[-1].isascii() and (before[-1].isalnum() or before[-1] in ",.") and line[0].isascii() and line[0].isalnum()
                    texts[last] = before + (" " if apart else "") + line
                rules[i] = "c4"
                continue
        last = i
    return [(*r[:3], t, r[4], u, r[6]) for r, t, u in zip(rows, texts, rules, strict=True)]


def test_merged_lines_equal_the_walk(spark):
    draw = random.Random(5)
    found = []
    for page in range(1, 161):
        rows = []
        for n in range(draw.randint(1, 30)):
            text = draw.choice(["", " ", "  "]).join(draw.choices(WORDS, k=draw.randint(1, 3)))
            rows.append((draw.choice(["d", "e"]) if n == 0 else rows[0][0], page, n, text, draw.random() < 0.1, draw.choice(["c1", None, None, None]), n))
        found.append(rows)
    lines = spark.createDataFrame([r for rows in found for r in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, cleaning.merge_lines(lines).collect()), key=lambda r: r[1:3])
    assert got == sorted((r for rows in found for r in plain(rows)), key=lambda r: r[1:3])
    assert sum(r[5] == "c4" for r in got) > 100


def test_long_paragraphs_nulls_and_no_lines(spark):
    words = "and so the sentence goes on without any end of it"
    lines = spark.createDataFrame([(None, 1, n, words, False, None, 0) for n in range(20000)], SCHEMA)
    rows = cleaning.merge_lines(lines).where("rule is null").collect()
    assert [r.text for r in rows] == [" ".join([words] * 20000)]
    assert cleaning.merge_lines(lines.limit(0)).collect() == []
