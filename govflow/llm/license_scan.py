"""Licence scan by ordered signature rules.

Hand-written regular expressions, each gated by a keyword, run on normalised words. Overlapping detections are resolved
by priority and interval containment: a detection goes when one of a higher priority, or an equal one that is longer
(then earlier in the rules), contains it. Base phrases are reported at all their places whatever contains them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .license_rules import BASE, BASE_PRIORITY, parsed

#: Bytes of a text in UTF-8: A-Z to a-z, other ASCII but 0-9 and a-z to a space; all else is part of words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

DETECTION = pa.struct([("label", pa.string()), ("priority", pa.int32()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("base", pa.bool_()), ("resolved", pa.bool_())])
SCHEMA = "doc_id long, n_words long, detections array<struct<label:string,priority:int,start_word:long,end_word:long,base:boolean,resolved:boolean>>"


class Scanner:
    def __init__(self, rules: list[tuple[str, int, str, str]]):
        border = r"(?:(?<= )|^)(?:%s)(?= |$)"
        self.gates: dict[bytes, list] = {}
        for order, (label, priority, keyword, pattern) in enumerate(rules):
            self.gates.setdefault(keyword.encode(), []).append((order, label, priority, re.compile((border % pattern).encode())))
        # A longer keyword is looked for only where a shorter one that it contains was found.
        self.tree: dict[bytes, list[bytes]] = {}
        for keyword in self.gates:
            shorter = [k for k in self.gates if k != keyword and k in keyword]
            self.tree.setdefault(min(shorter, key=len) if shorter else b"", []).append(keyword)

    def scan(self, text: str) -> tuple[int, list[tuple]]:
        norm = b" ".join(text.encode().translate(FOLD).split())
        n_words = norm.count(b" ") + 1 if norm else 0
        found, base = [], []
        todo = list(self.tree.get(b"", ()))
        while todo:
            keyword = todo.pop()
            if keyword in norm:
                todo += self.tree.get(keyword, ())
                for order, label, priority, pattern in self.gates[keyword]:
                    found += [(m.start(), m.end(), priority, order, label, False) for m in pattern.finditer(norm)]
        padded = b" " + norm + b" "
        for order, (phrase, label) in enumerate(BASE):
            needle, at = b" " + phrase.encode() + b" ", -1
            while (at := padded.find(needle, at + 1)) >= 0:
                base.append((at, at + len(phrase), BASE_PRIORITY, order - len(BASE), label, True))
        if not found and not base:
            return n_words, []
        spaces = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
        every = found + base
        starts = np.searchsorted(spaces, [x[0] for x in every]).tolist()
        ends = (np.searchsorted(spaces, [x[1] for x in every]) + 1).tolist()
        spans = [(s, e, *x[2:]) for s, e, x in zip(starts, ends, every, strict=True)]
        kept = resolve(spans)
        return n_words, sorted(
            ({"label": x[4], "priority": x[2], "start_word": x[0], "end_word": x[1], "base": x[5], "resolved": i in kept} for i, x in enumerate(spans) if x[5] or i in kept),
            key=lambda d: (d["start_word"], d["end_word"], d["label"]),
        )


def resolve(spans: list[tuple]) -> set[int]:
    """Positions of the spans (start, end, priority, order, ...) that none contains that goes before them."""
    kept: set[int] = set()
    starts: list[int] = []  # of the spans kept at higher priorities, ascending, with the largest end up to each
    reach: list[int] = []
    for priority in sorted({x[2] for x in spans}, reverse=True):
        level = sorted((i for i, x in enumerate(spans) if x[2] == priority), key=lambda i: (spans[i][0], -spans[i][1], spans[i][3]))
        furthest, new = -1, []
        for i in level:
            start, end = spans[i][:2]
            at = bisect_right(starts, start)
            if end > furthest and not (at and reach[at - 1] >= end):
                new.append(i)
            furthest = max(furthest, end)
        kept.update(new)
        merged = sorted((spans[i][0], spans[i][1]) for i in kept)
        starts, reach, far = [], [], -1
        for start, end in merged:
            far = max(far, end)
            starts.append(start)
            reach.append(far)
    return kept


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(parsed())


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, detections: label, priority, words [start_word, end_word), base, resolved.

    Detections are those that stay after suppression (``resolved``) and all places of base phrases (``base``). A null
    text counts as empty: 0 words, no detections. Rows are independent; null and repeated ids pass through; other
    columns of ``docs`` are not read.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def scan(batches):
        scan_one = scanner().scan
        for batch in batches:
            out = [scan_one(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([n for n, _ in out], pa.int64()), pa.array([d for _, d in out], pa.list_(DETECTION))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "detections"])

    return rows.mapInArrow(scan, SCHEMA)
