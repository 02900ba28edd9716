import random
import re

import pytest
from pyspark.sql import functions as F

from govflow.operators import judging


def normal(text):
    text = re.sub(judging.SPACES, "", text or "")
    text = re.sub("[，,](?=[0-9]{3}([^0-9]|$))", "", text)
    return re.sub(f"([0-9])[{judging.UNITS}]", r"\1", text)


def hit(hay, token):
    if token is None:
        return False
    if re.fullmatch("[0-9]+", token):
        for m in re.finditer(f"(?={token})", hay):
            before, after = hay[: m.start()][-1:], hay[m.start() + len(token) :]
            if not re.match("[A-Za-z0-9]", before) and not re.match("[0-9]|,[0-9]", after):
                return True
        return False
    return re.sub(judging.SPACES, "", token) in hay


def answers():
    rng = random.Random(2)
    parts = ["合同 3 个", "1,855,560 元", "没有", "a12", "12", "12,3", "9、2、3", "第12页", " data ", "x", "0", "2024-10-20", "é"]
    return [(i, "".join(rng.choices(parts, k=rng.randrange(0, 6)))) for i in range(300)] + [(900, None), (901, "")]


def test_groups_against_brute_force(spark):
    groups = [(1, ["合同", "3"]), (2, ["12"]), (3, ["没 有", "x"]), (4, []), (5, ["1855560"]), (6, ["da ta", "12", "é"]), (7, [None, "x"]), (8, [" "]), (9, ["2", "2", "3"]), (10, ["0"])]
    rows = spark.createDataFrame([(*r, 1) for r in answers()], "id long, answer string, complete_ int").repartition(3)
    got = {r.id: r.complete for r in judging.complete_groups(rows, spark.createDataFrame(groups, "group_id long, tokens array<string>")).collect()}
    assert got == {i: [g for g, tokens in groups if all(hit(normal(a), t) for t in tokens)] for i, a in answers()}
    assert sum(map(len, got.values())) > 600
    none = judging.complete_groups(rows, spark.createDataFrame([], "group_id long, tokens array<string>"))
    assert {tuple(r.complete) for r in none.collect()} == {()}


def test_too_many_tokens(spark, monkeypatch):
    monkeypatch.setattr(judging, "MOST_TOKENS", 3)
    with pytest.raises(ValueError):
        judging.complete_groups(spark.createDataFrame([], "answer string"), spark.createDataFrame([(1, ["a", "b", "c"])], "group_id long, tokens array<string>"))


def test_tokens_as_columns(spark):
    tokens = ["12", "3", "合同", "没 有", "1855560", "0", "x", None]
    rows = spark.createDataFrame([(i, a, t) for i, a in answers() for t in tokens], "id long, answer string, token string")
    got = rows.select("id", "token", F.coalesce(judging.token_hit(judging.normal_answer(F.col("answer")), F.col("token")), F.lit(False)).alias("hit")).collect()
    text = dict(answers())
    assert all(r.hit == hit(normal(text[r.id]), r.token) for r in got)


SCHEMA = "case_id int, category string, answer string, tools array<string>, tool string, must array<string>, anyof array<array<string>>, truth array<string>, forbidden array<string>, pages array<int>, cited array<int>, refusal boolean, cross array<string>, asks_truth boolean"


def test_judging(spark):
    base = {"category": "fact", "answer": "合同 3 个，金额 1,855,560 元", "tools": ["q"], "tool": None, "must": None, "anyof": None, "truth": None, "forbidden": None, "pages": [], "cited": None, "refusal": None, "cross": None, "asks_truth": None}
    cases = [
        ({}, "PASS"), ({"tool": "q", "must": ["3", "合同"]}, "PASS"), ({"tool": "r"}, "FAIL"), ({"must": ["3", "4"]}, "FAIL"), ({"anyof": [["4"], ["3", "金额"]]}, "PASS"), ({"anyof": [["4"], ["3", "5"]]}, "FAIL"),
        ({"truth": ["1855560"], "cross": ["1855560"]}, "PASS"), ({"truth": ["18555"]}, "FAIL"), ({"truth": ["0"], "answer": "2024-0-1"}, "FAIL"), ({"truth": ["0"], "answer": "没有 0 条"}, "PASS"), ({"anyof": [["0"]], "answer": "0"}, "FAIL"),
        ({"pages": [1, 2], "cited": [2, 1]}, "PASS"), ({"pages": [1, 2], "cited": [2]}, "FAIL"), ({"pages": [1]}, "FAIL"), ({"pages": None}, "SKIP"), ({"asks_truth": True}, "SKIP"), ({"asks_truth": True, "must": ["9"]}, "FAIL"),
        ({"category": "negative", "refusal": True}, "FAIL"), ({"category": "negative", "refusal": True, "answer": "未找到"}, "PASS"), ({"category": "negative"}, "PASS"), ({"category": "permission", "forbidden": ["1855560"]}, "FAIL"), ({"forbidden": ["77"]}, "PASS"), ({"answer": None, "must": ["x"]}, "FAIL"),
    ]
    rows = spark.createDataFrame([tuple((base | {"case_id": i} | c)[n.split()[0]] for n in SCHEMA.split(", ")) for i, (c, _) in enumerate(cases)], SCHEMA)
    got = {r.case_id: r.status for r in judging.judged(rows).collect()}
    assert got == {i: status for i, (_, status) in enumerate(cases)}
    table = {r.category: r for r in judging.judging_table(judging.judged(rows)).collect()}
    assert (table["negative"].cases, table["negative"].passed, table["negative"].refusal_rate, table["negative"].tool_rate) == (3, 2, 0.6667, None)
    assert table["fact"].agree_rate == 1.0 and table["fact"].tool_rate == 0.5 and table["permission"].failed == 1
