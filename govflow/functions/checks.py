"""Checks of numbers in documents: amounts in words, percentages, styles, traceable answers; and a calculator."""

import ast
import decimal
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Digits, units and sections of amounts written in words, and the patterns of numbers.
DIGITS = {"零": 0, "壹": 1, "贰": 2, "叁": 3, "肆": 4, "伍": 5, "陆": 6, "柒": 7, "捌": 8, "玖": 9}
UNITS = {"拾": 10, "佰": 100, "仟": 1000}
SECTIONS = {"万": 10_000, "亿": 100_000_000}
IN_WORDS = r"(?U)[零壹贰叁肆伍陆柒捌玖拾佰仟万亿]{2,}"
IN_FIGURES = r"(?U)\d{1,3}(?:[,，]\d{3})+(?:[.．]\d{1,2})?|\d+[.．]\d{1,2}"
PERCENT = r"(?U)(\d+(?:[.．]\d+)?)\s*[%％]"
ANY_NUMBER = r"(?U)\d{1,3}(?:[,，]\d{3})+(?:[.．]\d{1,2})?|\d+(?:[.．]\d{1,2})?"
STYLED = r"[0-9０-９][0-9０-９,，.．]*"
SENTENCE, PARAGRAPH = r"[。；;\n]", r"(?U)\n\s*\n"
EXACT = "decimal(38,10)"


def amount_in_words(text: str | None) -> decimal.Decimal | None:
    """The value of an amount in words; None where it has none or is 0. A unit without a digit counts once."""
    whole = part = digit = 0
    for c in text or "":
        if c in DIGITS:
            digit = DIGITS[c]
        elif c in UNITS:
            part, digit = part + (digit or 1) * UNITS[c], 0
        elif c in SECTIONS:
            whole, part, digit = whole + (part + digit) * SECTIONS[c], 0, 0
    total = whole + part + digit
    return decimal.Decimal(total) if total else None


def amounts_in_words(text: Column) -> Column:
    """``amount_in_words`` over a column; a scan that keeps state from character to character."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(amount_in_words)

    return F.pandas_udf(run, "decimal(38,2)")(text)


def to_decimal(text: Column) -> Column:
    """A number without thousands commas, full-width forms folded; null where it is none."""
    plain = F.translate(text, "．０１２３４５６７８９,，", ".0123456789")
    return plain.try_cast(EXACT)


def amount_case(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, n, status of pages (doc_id, page_no, text): sentences that give an amount in words and figures
    pass when one of the figures equals the first amount in words; a page fails with any sentence that doesn't."""
    sentence = F.explode(F.split("text", SENTENCE, -1)).alias("s")
    rows = pages.select("doc_id", "page_no", sentence).select("doc_id", "page_no", F.regexp_extract("s", IN_WORDS, 0).alias("words"), F.regexp_extract_all("s", F.lit(IN_FIGURES), 0).alias("figures"))
    rows = rows.where((F.col("words") != "") & (F.size("figures") > 0)).withColumn("amount", amounts_in_words(F.col("words"))).where("amount is not null")
    equal = F.exists("figures", lambda x: to_decimal(x) == F.col("amount"))
    return rows.groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("n"), F.when(F.bool_and(F.coalesce(equal, F.lit(False))), "pass").otherwise("fail").alias("status"))


def percent_sum(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, paragraph, total, status: paragraphs with two percentages or more pass within 1 of 100."""
    rows = pages.select("doc_id", "page_no", F.posexplode(F.split("text", PARAGRAPH)).alias("paragraph", "p"))
    found = F.transform(F.regexp_extract_all("p", F.lit(PERCENT), 1), to_decimal)
    rows = rows.select("doc_id", "page_no", "paragraph", F.filter(found, lambda x: x.isNotNull()).alias("found")).where(F.size("found") >= 2)
    total = F.aggregate("found", F.lit(0).cast(EXACT), lambda s, x: (s + x).cast(EXACT)).cast("decimal(18,2)")
    rows = rows.select("doc_id", "page_no", "paragraph", total.alias("total"))
    return rows.withColumn("status", F.when(F.abs(F.col("total") - 100) <= 1, "pass").otherwise("warn"))


def number_style(pages: DataFrame, most: int = 12) -> DataFrame:
    """doc_id, styles: numbers of four characters or more that a document writes in several ways, the first by value.

    Numbers are the same when their digits are, so a trailing zero makes another one.
    """
    rows = pages.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(STYLED), 0)).alias("raw")).where(F.char_length("raw") >= 4)
    rows = rows.withColumn("plain", F.translate("raw", "．０１２３４５６７８９,，", ".0123456789"))
    kinds = rows.groupBy("doc_id", "plain").agg(F.array_join(F.array_sort(F.collect_set("raw")), " | ").alias("style"), F.countDistinct("raw").alias("n")).where("n > 1")
    held = kinds.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("plain", "style"))).alias("x"))
    return held.select("doc_id", F.array_join(F.transform(F.slice("x", 1, most), lambda x: x["style"]), "; ").alias("styles"))


def numbers_of(text: Column) -> Column:
    """Distinct numbers of a text but 0, without trailing zeros, as text."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ANY_NUMBER), 0), to_decimal)
    kept = F.filter(found, lambda x: x.isNotNull() & (x != 0))
    return F.array_distinct(F.transform(kept, lambda x: F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")))


def traceable(answer: Column, source: Column) -> Column:
    """struct(status, missing): numbers of an answer that its source lacks; skip without numbers."""
    own = numbers_of(answer)
    missing = F.array_sort(F.array_except(own, numbers_of(source)))
    return F.struct(F.when(F.size(own) == 0, "skip").when(F.size(missing) == 0, "pass").otherwise("warn").alias("status"), F.slice(missing, 1, 20).alias("missing"))


def review_pages(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id, pages: pages that failed (error), are blank or have a finding (doc_id, page_no, status fail or warn)."""
    doubtful = pages.where(F.col("error").isNotNull() | (F.trim(F.coalesce("text", F.lit(""))) == "")).select("doc_id", "page_no")
    doubtful = doubtful.union(findings.where(F.col("status").isin("fail", "warn")).select("doc_id", "page_no")).where("page_no > 0")
    return doubtful.groupBy("doc_id").agg(F.array_sort(F.collect_set("page_no")).alias("pages"))


def calculate(expression: str) -> decimal.Decimal:
    """The value of + - * / with parentheses and signs; ValueError for anything else or a division by 0."""
    if len(expression) > 200 or not re.fullmatch(r"[0-9.eE+\-*/()\s,]*", expression) or "**" in expression or "//" in expression:
        raise ValueError("not an expression of numbers, + - * / and parentheses")
    operations = {ast.Add: "add", ast.Sub: "subtract", ast.Mult: "multiply", ast.Div: "divide"}
    source = expression.replace(",", "").strip()
    context = decimal.Context(prec=34, rounding=decimal.ROUND_HALF_EVEN)

    def value(node):
        if isinstance(node, ast.Constant):
            return decimal.Decimal(ast.get_source_segment(source, node))
        if isinstance(node, ast.UnaryOp):
            inner = value(node.operand)
            return -inner if isinstance(node.op, ast.USub) else inner
        if isinstance(node, ast.BinOp) and type(node.op) in operations:
            return getattr(context, operations[type(node.op)])(value(node.left), value(node.right))
        raise ValueError("not an expression")

    try:
        return value(ast.parse(source, mode="eval").body)
    except (SyntaxError, decimal.DecimalException, RecursionError) as e:
        raise ValueError(str(e) or type(e).__name__) from None


def calculated(expression: Column) -> Column:
    """struct(value, error): the value of each expression as text, or what is wrong with it."""

    def one(text):
        try:
            return format(calculate(text or ""), "f"), None
        except ValueError as e:
            return None, str(e)

    def run(expressions: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in expressions], columns=["value", "error"])

    return F.pandas_udf(run, "value string, error string")(expression)
