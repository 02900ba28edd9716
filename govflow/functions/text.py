"""Text functions on columns: folding, query terms, keys, and the structure of lines.

Lengths are in code points. Trimming takes all ASCII white space off, as regular expressions see it.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as full width, bigrams without meaning, and the patterns of headings, clauses and bullets.
FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F)))
HALF_WIDTH = "".join(map(chr, range(0x21, 0x7F)))
IDEOGRAPHIC_SPACE, ASCII_SPACE = "　", " \t\n\x0b\f\r"
STOP_BIGRAMS = ("的是", "了的", "和和", "在在", "有有", "我我", "你你", "他他", "什么", "怎么", "哪些", "哪个", "如何", "请问", "告诉")
HEADING = r"^#{1,6}\s+\S.*$"
CHAPTER = r"^第\s*[一二三四五六七八九十百千0-9]+\s*章\s*\S.*$"
SECTION = r"^第\s*[一二三四五六七八九十百千0-9]+\s*[节篇]\s*\S.*$"
NUMBERED = r"^\d+(\.\d+){1,3}\s*\S.*$"
CLAUSE = r"^第\s*[一二三四五六七八九十百千0-9]+\s*条.*$|^\d+(\.\d+)*[\.、]?\s*\S.*$|^[（(][一二三四五六七八九十0-9]+[）)]\s*.*$|^[一二三四五六七八九十]+、\s*\S.*$"
BULLET = r"^[-*·•▪◦○●－—]+\s*\S.*$|^[①-⑳]\s*.*$"


def any_of(*patterns: str) -> str:
    """One pattern for several that begin with ^; as ^ stands before all of them, it is tried at the begin of a text only."""
    parts = [re.sub(r"^(\(\?i\))?\^", r"\1", p).replace("|^", "|") for p in patterns]
    return f"^(?:{'|'.join(parts)})"


BOUNDARY = any_of(HEADING, CHAPTER, SECTION, NUMBERED, CLAUSE, BULLET)
SENTENCE_MARKS = "。！？；!?;"
LINE_ENDS = SENTENCE_MARKS + "…：:）】\"”"
SHORT_HEADING = 30


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(ASCII_SPACE))


def fold(text: Column) -> Column:
    """Full-width forms to ASCII, the ideographic space to a space; null to empty."""
    return F.translate(F.coalesce(text, F.lit("")), FULL_WIDTH + IDEOGRAPHIC_SPACE, HALF_WIDTH + " ")


def normal_query(text: Column) -> Column:
    return F.lower(strip(fold(text)))


def query_terms(text: Column) -> Column:
    """Distinct terms in order: words of letters and digits, then bigrams of Han characters (a single one by itself).

    Other characters are dropped before the bigrams are formed, so these span gaps.
    """
    query = normal_query(text)
    words = F.regexp_extract_all(query, F.lit(r"[a-z0-9][a-z0-9\-.]*"), 0)
    han = F.regexp_replace(query, r"[^一-鿿]", "")
    n = F.char_length(han)
    pairs = F.transform(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(han, i, F.lit(2)))
    telling = F.filter(pairs, lambda x: ~x.isin(*STOP_BIGRAMS))
    return F.array_distinct(F.concat(words, F.when(n == 1, F.array(han)).otherwise(F.array().cast("array<string>")), telling))


def occurrences(text: Column, term: Column) -> Column:
    """How often ``term`` stands in ``text`` without overlaps; 0 for an empty term."""
    gone = F.char_length(text) - F.char_length(F.replace(text, term, F.lit("")))
    return F.when(F.char_length(term) > 0, (gone / F.char_length(term)).cast("int")).otherwise(0)


def short_hash(text: Column, digits: int = 12) -> Column:
    return F.substring(F.sha1(F.encode(text, "UTF-8")), 1, digits)


def chunk_key(doc: Column, page: Column, text: Column, clean_rev: Column | None = None, chunk_rev: Column | None = None) -> Column:
    """doc:page:hash, or with revisions d=..:p=..:h=..:c=..:k=.."""
    if clean_rev is None:
        return F.concat_ws(":", doc, page.cast("string"), short_hash(text))
    return F.format_string("d=%s:p=%s:h=%s:c=%s:k=%s", doc, page.cast("string"), short_hash(text), clean_rev.cast("string"), chunk_rev.cast("string"))


def parse_chunk_key(key: Column) -> Column:
    """struct(doc, page, hash, clean_rev, chunk_rev) of either form; null for anything else."""
    long = r"^d=([0-9a-f]+):p=(\d+):h=([0-9a-f]{4,40}):c=(\d+):k=(\d+)$"
    brief = r"^([0-9a-f]+):(\d+):([0-9a-f]{4,40})$"

    def part(pattern, i, kind):
        return F.regexp_extract(key, pattern, i).try_cast(kind)

    names = (("doc", "string"), ("page", "int"), ("hash", "string"), ("clean_rev", "int"), ("chunk_rev", "int"))
    revised = F.struct(*[part(long, i + 1, kind).alias(name) for i, (name, kind) in enumerate(names)])
    legacy = F.struct(*[(part(brief, i + 1, kind) if i < 3 else F.lit(None).cast(kind)).alias(name) for i, (name, kind) in enumerate(names)])
    return F.when(key.rlike(long), revised).when(key.rlike(brief), legacy)


def embed_rev(model: str, dimensions: int) -> str:
    return hashlib.sha1(f"{model}|{dimensions}".encode()).hexdigest()[:8]


def task_key(content_hash: Column, pipeline_rev: str) -> Column:
    """sha1 of the content's hash and the revision: the same task again; a null hash counts as empty."""
    return F.sha1(F.concat(F.coalesce(content_hash, F.lit("")), F.lit(f"|{pipeline_rev}")))


def repeat_key(line: Column) -> Column:
    """A line without white space and digits, in lower case: equal for headers that differ in a page number."""
    return F.lower(F.regexp_replace(F.regexp_replace(line, r"\s+", ""), r"\d+", ""))


def ends_sentence(line: Column, stripped: bool = False) -> Column:
    return F.right(line if stripped else strip(line), F.lit(1)).isin(*LINE_ENDS)


def is_clause(line: Column) -> Column:
    return strip(line).rlike(CLAUSE)


def is_bullet(line: Column) -> Column:
    return strip(line).rlike(BULLET)


def heading_level(line: Column) -> Column:
    """1 to 6, or 0: markdown marks, chapters (1), sections (2), dotted numbers by their dots, short lines (6)."""
    value = strip(line)
    dots = F.char_length(F.regexp_replace(F.regexp_extract(value, r"^[0-9.]*", 0), "[^.]", ""))
    n = F.char_length(value)
    return (
        F.when(value.rlike(HEADING), F.char_length(F.regexp_extract(value, "^#+", 0)))
        .when(value.rlike(CHAPTER), 1)
        .when(value.rlike(SECTION), 2)
        .when(value.rlike(NUMBERED), F.least(F.lit(6), 1 + F.greatest(F.lit(1), dots)))
        .when((n >= 2) & (n <= SHORT_HEADING) & ~ends_sentence(value) & ~is_clause(value), 6)
        .otherwise(0)
    )


def is_boundary(line: Column, stripped: bool = False) -> Column:
    """A heading of any level, a clause or a bullet; what has a level is told by the patterns or is short."""
    value = line if stripped else strip(line)
    n = F.char_length(value)
    return ((n >= 2) & (n <= SHORT_HEADING) & ~ends_sentence(value, stripped=True)) | value.rlike(BOUNDARY)


def sentences(text: Column) -> Column:
    """Pieces that end with a sentence mark, which they keep, and what is left."""
    return F.regexp_extract_all(text, F.lit(f"[^{SENTENCE_MARKS}]*[{SENTENCE_MARKS}]|[^{SENTENCE_MARKS}]+$"), 0)


def is_pipe_row(line: Column) -> Column:
    return F.char_length(line) - F.char_length(F.replace(line, F.lit("|"), F.lit(""))) >= 2


def is_separator_row(line: Column) -> Column:
    body = F.regexp_replace(line, r"[|\s]", "")
    return is_pipe_row(line) & body.rlike(r"^[-:+]+$") & body.contains("-")


def clip(text: Column, n: int, mark: str = "…") -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(mark))).otherwise(text)


def snippet(text: Column, n: int = 200) -> Column:
    """White space collapsed; at most ``n`` with the mark."""
    flat = strip(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(flat) > n, F.concat(F.left(flat, F.lit(n - 1)), F.lit("…"))).otherwise(flat)


def rounded(x: Column, digits: int) -> Column:
    """floor(x * 10^n + 0.5) / 10^n"""
    power = float(10**digits)
    return F.floor(x * power + 0.5) / power


# -- the same line rules for the sequential operators, which keep state from line to line ------------------------------

_HEADING, _CHAPTER, _SECTION, _NUMBERED, _CLAUSE, _BULLET = (re.compile(p) for p in (HEADING, CHAPTER, SECTION, NUMBERED, CLAUSE, BULLET))


class Line:
    """The structure of one line of text."""

    def __init__(self, text: str):
        self.text = text.strip()

    @property
    def ends_sentence(self) -> bool:
        return self.text[-1:] != "" and self.text[-1] in LINE_ENDS

    @property
    def clause(self) -> bool:
        return bool(_CLAUSE.match(self.text))

    @property
    def bullet(self) -> bool:
        return bool(_BULLET.match(self.text))

    @property
    def level(self) -> int:
        t = self.text
        if _HEADING.match(t):
            return len(t) - len(t.lstrip("#"))
        for level, pattern in ((1, _CHAPTER), (2, _SECTION)):
            if pattern.match(t):
                return level
        if _NUMBERED.match(t):
            return min(6, 1 + max(1, re.match("[0-9.]*", t)[0].count(".")))
        return 6 if 2 <= len(t) <= SHORT_HEADING and not self.ends_sentence and not self.clause else 0

    @property
    def boundary(self) -> bool:
        return self.level > 0 or self.clause or self.bullet

    @property
    def pipe(self) -> bool:
        return self.text.count("|") >= 2

    @property
    def separator(self) -> bool:
        body = re.sub(r"[|\s]", "", self.text)
        return self.pipe and "-" in body and not body.strip("-:+")
