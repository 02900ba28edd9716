"""Judging of answers: expected values and words, groups of tokens, refusals, tools and citations.

Tokens of a case are looked up in its own answer by column functions. Groups that all answers share are looked up by one
automaton over the tokens of all groups, which reads each answer once.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a refusal, units behind numbers, and white space that answers are compared without (fixed values).
REFUSALS = ("没有", "未找到", "找不到", "不存在", "未登记", "无相关", "无此", "暂无", "无数据", "不包含", "未提及", "未包含", "未提供", "无法确认", "无法给出", "无法计算", "无法提供", "no data", "not found", "no such", "cannot find")
UNITS = "元个条份项次户人页天%％"
SPACES = r"[\s  -​　]"
#: Tokens of all shared groups at most; they are held in each task.
MOST_TOKENS = 200_000
NUMBER = re.compile(r"[0-9]+")


def normal_answer(text: Column) -> Column:
    """Without white space, separators of thousands, and units right behind a digit; null is empty."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")
    plain = F.regexp_replace(plain, "[，,](?=[0-9]{3}([^0-9]|$))", "")
    return F.regexp_replace(plain, f"([0-9])[{UNITS}]", "$1")


def token_hit(hay: Column, token: Column) -> Column:
    """Whether a token stands in a normal answer: digits as a number of their own (no letter or digit before, no digit behind,
    nor a comma and a digit), any other text, white space aside, anywhere."""
    number = F.regexp_like(hay, F.concat(F.lit("(?<![A-Za-z0-9])"), token, F.lit("(?![0-9])(?!,[0-9])")))
    return F.when(F.regexp_like(token, F.lit("^[0-9]+$")), number).otherwise(F.contains(hay, F.regexp_replace(token, SPACES, "")))


def refuses(hay: Column) -> Column:
    found = F.lit(False)
    for word in REFUSALS:
        found = found | F.contains(hay, F.lit(word)) | F.contains(F.lower(hay), F.lit(word))
    return found


def complete_groups(answers: DataFrame, groups: DataFrame) -> DataFrame:
    """The columns of ``answers`` (answer) and ``complete``: the ids of ``groups`` (group_id, tokens) all of whose tokens stand in
    it, as ``token_hit`` has it, in ascending order. A group without tokens is always complete; null tokens never hit.

    The groups are rules, not data: more than MOST_TOKENS tokens are an error.
    """
    import ahocorasick

    rules = [(r.group_id, list(dict.fromkeys(r.tokens or []))) for r in groups.select(F.col("group_id").cast("long").alias("group_id"), "tokens").limit(MOST_TOKENS + 1).collect()]
    if len(rules) + sum(len(t) for _, t in rules) > MOST_TOKENS:
        raise ValueError(f"groups of more than {MOST_TOKENS} tokens")
    automaton, users = ahocorasick.Automaton(), {}
    for at, (_, tokens) in enumerate(rules):
        for token in tokens:
            if token is not None:
                plain = token if NUMBER.fullmatch(token) else re.sub(SPACES, "", token)
                users.setdefault(plain, []).append((at, token))
    for plain in users:
        if plain:
            automaton.add_word(plain, plain)
    automaton.make_automaton()
    always = [x for x in users.get("", [])]
    names = answers.columns

    def hits(hay: str) -> list[int]:
        found = set()
        for end, plain in automaton.iter(hay) if len(automaton) else ():
            if plain not in found:
                if NUMBER.fullmatch(plain):
                    before, after = hay[end - len(plain)] if end >= len(plain) else "", hay[end + 1 : end + 3]
                    if (before.isascii() and before.isalnum()) or NUMBER.match(after) or (after[:1] == "," and NUMBER.match(after[1:])):
                        continue
                found.add(plain)
        held = {u for plain in found for u in users[plain]} | set(always)
        counts = [0] * len(rules)
        for at, _ in held:
            counts[at] += 1
        return sorted(g for (g, tokens), n in zip(rules, counts, strict=True) if n == len(tokens))

    def run(batches):
        for batch in batches:
            found = [hits(hay) for hay in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(found, pa.list_(pa.int64()))], [*names, "complete"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in answers.schema)
    return answers.select("*", normal_answer(F.col("answer")).alias("normal answer")).mapInArrow(run, f"{fields}, complete array<bigint>")


def judged(cases: DataFrame) -> DataFrame:
    """case_id, category, status and what was checked, of cases with their answers:

    answer; tools called, expected tool; must, tokens that all have to stand in the answer; anyof, groups of which one has to;
    truth, values as must, where a truth of zeros needs a refusal too; forbidden, values that may not stand in it; pages that
    have to be cited, cited pages; refusal, whether a negative case has to be refused; cross, values of a second way.

    FAIL if anything is missing or leaked; else SKIP without a truth that a case asks for (asks_truth) or with null pages;
    else PASS. Checks that a case doesn't ask for are null.
    """
    hay = normal_answer(F.col("answer"))
    rows = cases.select("*", hay.alias("normal answer"), refuses(hay).alias("refused answer"))
    hay, refused = F.col("normal answer"), F.col("refused answer")
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    all_hit = lambda tokens: F.forall(tokens, lambda t: F.coalesce(token_hit(hay, t), F.lit(False)))
    zero = lambda tokens: F.forall(tokens, lambda t: t == "0")
    checks = {
        "tool_called": F.when(F.trim("tool") != "", F.coalesce(F.array_contains("tools", F.col("tool")), F.lit(False))),
        "must_hit": F.when(has("must"), all_hit("must")),
        # A lone zero also stands in dates, so it counts beside words of a refusal only.
        "any_hit": F.when(has("anyof"), F.exists("anyof", all_hit) & (refused | ~F.exists("anyof", zero))),
        "truth_hit": F.when(has("truth"), all_hit("truth") & (refused | ~zero("truth"))),
        "pages_hit": F.when(has("pages"), F.size(F.array_except("pages", F.coalesce("cited", F.array().cast("array<int>")))) == 0),
        "refused": F.when(F.col("category") == "negative", refused | ~F.coalesce("refusal", F.lit(False))),
        "kept_back": F.when(has("forbidden"), ~F.exists("forbidden", lambda v: F.coalesce(F.contains(hay, v), F.lit(False)))),
    }
    agree = F.when(F.col("truth").isNotNull() & F.col("cross").isNotNull(), F.array_join("truth", "|") == F.array_join("cross", "|")).alias("agree")
    out = rows.select("case_id", "category", *[c.alias(n) for n, c in checks.items()], agree, (F.coalesce(F.size("cited"), F.lit(0)) > 0).alias("has_citation"), (F.col("pages").isNull() | (F.coalesce("asks_truth", F.lit(False)) & F.col("truth").isNull())).alias("open"))
    failed = F.lit(False)
    for name in checks:
        failed = failed | ~F.coalesce(name, F.lit(True))
    status = F.when(failed, "FAIL").when(F.col("open"), "SKIP").otherwise("PASS")
    return out.select("case_id", "category", status.alias("status"), *checks, "agree", "has_citation")


def judging_table(rows: DataFrame) -> DataFrame:
    """category, cases, passed, failed, skipped, and the rates of tools called, refusals, citations and agreement of ``judged``
    rows: of the cases that were checked, null where none was."""
    rate = lambda c: F.round(F.try_divide(F.count_if(c), F.count(c)), 4)
    n = lambda s: F.count_if(F.col("status") == s)
    return rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("cases"), n("PASS").alias("passed"), n("FAIL").alias("failed"), n("SKIP").alias("skipped"),
        rate(F.col("tool_called")).alias("tool_rate"), rate(F.col("refused")).alias("refusal_rate"), rate(F.col("has_citation")).alias("citation_rate"), rate(F.col("agree")).alias("agree_rate"),
    )
