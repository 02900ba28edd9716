"""Language identification by rank-order profiles of character n-grams.

A language's profile is its most frequent n-grams of one to three characters in the training documents, by rank. A
document goes to the language with the smallest out-of-place distance: the sum over the document's own most frequent
n-grams of how far their ranks are apart, where an n-gram that a profile lacks counts as far as can be.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_name, id_bucket

#: N-grams of a profile, and of a document.
PROFILE = 400
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Distinct n-grams that a task counts before it hands them on.
TASK_GRAMS = 2_000_000
#: Stands for "no character" in a packed n-gram; above all code points.
CUT = re.compile(r"\s")
ABSENT = np.int64((1 << 21) - 1)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str) -> np.ndarray:
    """All n-grams of a text, packed into 63 bits; words are framed by 0, other characters dropped."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    is_letter = letters()[codes]
    if not is_letter.any():
        return np.empty(0, np.int64)
    codes = np.where(is_letter, codes, 0)
    framed = np.concatenate([[0], codes, [0]])
    held = framed != 0
    framed = framed[np.concatenate([[True], held[1:] | held[:-1]])]
    one = framed[framed != 0]
    two = (framed[:-1] << 21) | framed[1:]
    three = ((framed[:-2] << 42) | (framed[1:-1] << 21) | framed[2:])[framed[1:-1] != 0]
    return np.concatenate([(ABSENT << 42) | (ABSENT << 21) | one, (ABSENT << 42) | two, three])


#: Characters of a text that are counted at a time.
SLICE = 1_000_000


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, ascending, and their counts. Long texts are cut at white space, which no n-gram spans."""
    if len(text) <= SLICE:
        return np.unique(grams(text), return_counts=True)
    keys, counts, at = np.empty(0, np.int64), np.empty(0, np.int64), 0
    while at < len(text):
        cut = CUT.search(text, at + SLICE)
        end = cut.end() if cut else len(text)
        keys, counts = merged([(keys, counts), np.unique(grams(text[at:end]), return_counts=True)])
        at = end
    return keys, counts


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def top(keys: np.ndarray, counts: np.ndarray, n: int = PROFILE) -> np.ndarray:
    """The n most frequent keys (ascending keys given); ties by key."""
    return keys[np.argsort(-counts, kind="stable")[:n]]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", profile: int = PROFILE) -> DataFrame:
    """lang, gram, rank (from 0): profiles of every non-null language over all rows of ``docs``.

    Null texts and texts without letters add nothing. Counts are summed per task before the shuffle.
    """
    bounded_batches(docs.sparkSession)

    def count(batches):
        held: dict[str, list] = {}

        def rows():
            for lang, parts in held.items():
                keys, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            new: dict[str, list] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new.setdefault(lang, []).append(gram_counts(text))
            for lang, parts in new.items():
                held[lang] = [merged(held.get(lang, []) + parts)]
            if sum(len(k) for parts in held.values() for k, _ in parts) > TASK_GRAMS:
                yield from rows()
                held.clear()
        yield from rows()

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # The top of each salt first, so that no task ranks all n-grams of one language.
    order = [F.desc("n"), F.asc("gram")]
    first = counts.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(16))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= profile)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)) - 1)
    return ranked.where(F.col("rank") < profile).select("lang", "gram", "rank")


class Profiles:
    """Ranks of all profile n-grams by language, for vectorised distances."""

    def __init__(self, frame: pd.DataFrame):
        self.langs = sorted(frame.lang.unique())
        self.keys = np.sort(frame.gram.unique())
        self.far = int(frame["rank"].max()) + 1 if len(frame) else 1
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), -1, np.int64)
        at = np.searchsorted(self.keys, frame.gram.to_numpy())
        self.ranks[at, np.searchsorted(self.langs, frame.lang.to_numpy())] = frame["rank"].to_numpy()

    def predict(self, text: str | None) -> tuple[str, float]:
        keys, counts = gram_counts(text or "")
        if not len(keys) or not self.langs:
            return UNKNOWN, 0.0
        own = top(keys, counts, self.far)
        at = np.searchsorted(self.keys, own)
        at[(at >= len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != own)] = len(self.keys)
        ranks = self.ranks[at]
        apart = np.where(ranks < 0, self.far, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        order = np.argsort(apart, kind="stable")
        best = int(apart[order[0]])
        if len(order) == 1:
            return self.langs[order[0]], 1.0 - best / (len(own) * self.far)
        second = int(apart[order[1]])
        return self.langs[order[0]], second / (best + second) if best + second else 0.5


def predict(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row.

    ``und`` with score 0 where the text is null or has no letter, or no language was learned. The score compares the
    two nearest languages: 0.5 for a tie (the first by name wins), 1 for certainty. Profiles are a few hundred rows a
    language, so they go through the driver.
    """
    bounded_batches(docs.sparkSession)
    model = Profiles(profiles.toPandas())

    def run(batches):
        for batch in batches:
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training; false for a null id, which isn't trained on either."""
    return F.coalesce(id_bucket(id_col, FOLDS) == HELD_OUT, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learn from documents outside the held-out fold, predict all."""
    learned = train(docs.where(id_bucket("doc_id", FOLDS) != HELD_OUT))
    return predict(docs, learned).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame) -> DataFrame:
    """The rows whose language can be told, with all their columns; a null ``lang`` becomes the predicted one.

    Rows of null texts, or texts without a letter, go. A given ``lang`` stays as it is. Where no language was learned,
    as in a table without labels, all rows with a letter stay, and a null ``lang`` stays null.
    """
    profiles = train(docs.where(id_bucket("doc_id", FOLDS) != HELD_OUT))
    model = Profiles(profiles.toPandas())

    def tell(text: str | None) -> str | None:
        if not model.langs:
            return UNKNOWN if len(grams(text or "")) else None
        found = model.predict(text)[0]
        return None if found == UNKNOWN else found

    @F.pandas_udf("string")
    def language(text: pd.Series) -> pd.Series:
        return text.map(tell)

    bounded_batches(docs.sparkSession)
    name = fresh_name("lang")
    # Not deterministic to the optimizer, or it would run once more for the filter.
    told = docs.withColumn(name, language.asNondeterministic()(F.col("text"))).where(F.col(name).isNotNull())
    known = F.coalesce(F.col("lang"), F.nullif(F.col(name), F.lit(UNKNOWN))).cast(docs.schema["lang"].dataType)
    return told.select(*[known.alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])
