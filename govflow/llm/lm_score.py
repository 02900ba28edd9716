"""Scores of texts under a subword lattice model and a word unigram model.

The pieces of an existing vocabulary weight all segmentations of a word: the word's probability is the sum over them,
by a forward recursion in log space. Pieces never cross white space, so a text's marginal probability is the product
of its words' and of the end symbol's. The vocabulary's own scores are merge ranks; as a Zipf distribution over them
they are the prior of the piece probabilities, which the counts over the training documents then move.

Word counts and word probabilities are tables by word. The most frequent words (a fixed number) are broadcast and added
up where a document is read; all other words of a document are joined by hash and word.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, id_bucket, materialize

VOCABULARY = "piece_bpe_32k.model"
FOLDS, HELD_OUT = 7, 2
#: Frequent words that are broadcast at most, 20 MB or so.
HEAD = 200_000
#: Distinct words that a task counts before it hands them on, and their bytes.
TASK_WORDS, TASK_BYTES = 500_000, 64 << 20
#: Words, and their bytes, that are handed on or scored at a time; cells (words times characters) of one lattice.
BLOCK, BLOCK_BYTES, CELLS = 50_000, 8 << 20, 1 << 20
#: Words of more characters are scored by themselves; characters of such a word whose pieces are looked up at a time.
LONG_WORD, WINDOW = 256, 1 << 15
#: Weight of the vocabulary's prior, in pieces.
PRIOR = 32_000.0
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)
START = "▁"
LOG_2 = math.log(2.0)


@lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


class Lattice:
    """Natural log probabilities of pieces, looked up by a polynomial hash of code points."""

    def __init__(self, path: str, log_probs: np.ndarray):
        model = processor(path)
        kept: dict[str, float] = {}
        self.bytes = np.full(256, -np.inf)
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                self.bytes[int(model.id_to_piece(i)[3:5], 16)] = log_probs[i]
            elif not (model.is_control(i) or model.is_unknown(i)):
                kept[model.id_to_piece(i)] = log_probs[i]
        self.longest = max(map(len, kept))
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, BASE)]), dtype=np.uint64)
        self.keys, self.values = [], []
        for n in range(1, self.longest + 1):
            pieces = [p for p in kept if len(p) == n]
            codes = np.array([[ord(c) for c in p] for p in pieces], np.uint64).reshape(len(pieces), n)
            hashes = (codes * powers[:n][::-1]).sum(axis=1, dtype=np.uint64) if pieces else np.empty(0, np.uint64)
            order = np.argsort(hashes)
            self.keys.append(hashes[order])
            self.values.append(np.array([kept[p] for p in pieces])[order] if pieces else np.empty(0))

    def _piece(self, n: int, hashes: np.ndarray) -> np.ndarray:
        keys = self.keys[n - 1]
        if not len(keys):
            return np.full(hashes.shape, -np.inf)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, self.values[n - 1][at], -np.inf)

    def _fallback(self, code: int) -> float:
        return float(self.bytes[list(chr(code).encode())].sum())

    def log_probs(self, words: list[str]) -> np.ndarray:
        """The natural log of each word's probability over all its segmentations."""
        out = np.zeros(len(words))
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[i] = self._long(np.frombuffer((START + w).encode("utf-32-le", "surrogatepass"), np.uint32))
            else:
                by_length.setdefault(len(w) + 1, []).append(i)
        for n, rows in by_length.items():
            step = max(1, CELLS // n)
            for part in (rows[i : i + step] for i in range(0, len(rows), step)):
                out[part] = self._forward(np.array([[ord(START), *map(ord, words[i])] for i in part], np.uint32), n)
        return out

    def _edges(self, codes: np.ndarray) -> list[np.ndarray]:
        """Log probabilities of the pieces of 1, 2, ... characters that begin at each column."""
        codes = codes.astype(np.uint64)
        hashes, edges = np.zeros_like(codes), []
        for k in range(1, min(self.longest, codes.shape[1]) + 1):
            hashes = hashes[:, : codes.shape[1] - k + 1] * BASE + codes[:, k - 1 :]
            edges.append(self._piece(k, hashes))
        lacking = np.isneginf(edges[0])
        if lacking.any():  # a character that is no piece is spelled in bytes
            unknown, at = np.unique(codes[lacking], return_inverse=True)
            edges[0][lacking] = np.array([self._fallback(int(c)) for c in unknown])[at]
        return edges

    def _forward(self, codes: np.ndarray, n: int) -> np.ndarray:
        alpha = np.full((len(codes), n + 1), -np.inf)
        alpha[:, 0] = 0.0
        edges = self._edges(codes)
        for end in range(1, n + 1):
            terms = np.stack([alpha[:, end - k] + edges[k - 1][:, end - k] for k in range(1, min(self.longest, end) + 1)])
            best = terms.max(axis=0)
            alpha[:, end] = best + np.log(np.exp(terms - best).sum(axis=0))
        return alpha[:, n]

    def _long(self, codes: np.ndarray) -> float:
        """The same recursion for one word, with probabilities in place of their logs: each step is one product of a few
        numbers, and they are scaled by a power of two before they grow small."""
        m, n = self.longest, len(codes)
        recent, log = np.zeros(m), 0.0
        recent[-1] = 1.0
        for begin in range(0, n, WINDOW):
            low, high = max(0, begin - m), min(n, begin + WINDOW)
            # ways[i, j]: the piece that ends behind character begin + i and began m - j characters before.
            ways = np.zeros((high - begin, m))
            for k, edge in enumerate(self._edges(codes[None, low:high]), 1):
                starts = np.arange(max(low, begin + 1 - k), high - k + 1)
                ways[starts + k - 1 - begin, m - k] = np.exp(edge[0, starts - low])
            alpha = np.concatenate([recent, np.zeros(high - begin)])
            for i, way in enumerate(ways):
                last = alpha[i : i + m]
                alpha[i + m] = now = way.dot(last)
                if now < 1e-100:
                    # The least exponent that brings the largest number in use near one.
                    used = alpha[i + 1 : i + m + 1]
                    shift = math.frexp(used.max())[1]
                    used[:] = np.ldexp(used, -shift)
                    log += shift * LOG_2
            recent = alpha[-m:]
        with np.errstate(divide="ignore"):
            return log + float(np.log(recent[-1]))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word (bytes), n: how often each word of ``docs`` stands in rows where ``learn`` is true (0 for words of others only)."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        held: Counter = Counter()
        size = 0  # bytes of the words held, at most

        def rows():
            words, counts = list(held), list(held.values())
            for at in range(0, len(words), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + BLOCK], pa.binary()), pa.array(counts[at : at + BLOCK], pa.int64())], ["word", "n"])
            held.clear()

        for batch in batches:
            size += batch.column(0).nbytes
            if size > TASK_BYTES:
                size = batch.column(0).nbytes + sum(map(len, held))
            for text, learn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if learn:
                    held.update(words_of(text))
                else:
                    for w in words_of(text):
                        held.setdefault(w, 0)
                if len(held) > TASK_WORDS or size > TASK_BYTES:
                    yield from rows()
                    size = batch.column(0).nbytes
        yield from rows()

    counted = docs.select(F.col(text_col).alias("text"), "learn").mapInArrow(run, "word binary, n long")
    return materialize(counted.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def piece_log_probs(counts: DataFrame, ends: int, path: str) -> tuple[np.ndarray, float]:
    """Natural log probability of each piece, and of the end symbol.

    Counts are of the vocabulary's own segmentation of every learned word. The table that goes through the driver has
    at most one row for each piece of the vocabulary.
    """

    def run(batches):
        model = processor(path)
        total = np.zeros(model.get_piece_size(), np.int64)
        for batch in batches:
            ids = model.encode([w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()], num_threads=1)
            flat = np.fromiter((i for x in ids for i in x), np.int64)
            weights = np.repeat(batch.column(1).to_numpy(), [len(x) for x in ids])
            np.add.at(total, flat, weights)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "n"])

    found = counts.where("n > 0").select("word", "n").mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    model = processor(path)
    size = model.get_piece_size()
    n = np.zeros(size)
    for piece, count in found.collect():
        n[piece] = count
    real = np.array([not (model.is_control(i) or model.is_unknown(i)) for i in range(size)])
    ranks = np.array([-model.get_score(i) for i in range(size)])
    prior = np.where(real, 1.0 / (ranks + 2.0), 0.0)
    weight = np.where(real, n, 0.0) + PRIOR * prior / prior.sum()
    total = weight.sum() + ends + 1.0
    with np.errstate(divide="ignore"):
        return np.log(weight / total), float(np.log((ends + 1.0) / total))


def word_table(counts: DataFrame, log_probs: np.ndarray, path: str) -> DataFrame:
    """word, hash, n, lp: each word's count and log10 probability over its segmentations."""

    def run(batches):
        lattice = Lattice(path, log_probs)

        def scored(words, counts):
            lp = lattice.log_probs([w.decode("utf-8", "replace") for w in words]) / np.log(10)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([word_hash(w) for w in words], pa.int64()), pa.array(counts, pa.int64()), pa.array(lp)], ["word", "hash", "n", "lp"])

        words, held, size = [], [], 0
        for batch in batches:
            words += batch.column(0).to_pylist()
            held += batch.column(1).to_pylist()
            size += batch.column(0).nbytes
            if len(words) >= BLOCK or size >= BLOCK_BYTES:
                yield scored(words, held)
                words, held, size = [], [], 0
        if words:
            yield scored(words, held)

    return materialize(counts.select("word", "n").mapInArrow(run, "word binary, hash long, n long, lp double"), "words")


def frequent(words: DataFrame) -> int:
    """The least count that at most HEAD words reach, from a histogram of eighths of a power of two."""
    steps = words.where("n > 0").groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least"))
    total, least = 0, 2**62
    for _, held, low in sorted(map(tuple, steps.collect()), reverse=True):
        total += held
        if total > HEAD:
            break
        least = low
    return least


def document_scores(docs: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, learn, tokens, known, logs (sum of log10(count + 1)), score of every row, without the end symbol."""
    bounded_batches(docs.sparkSession)
    head_rows = words.where(F.col("n") >= frequent(words)).select("word", "n", "lp").toArrow()
    head = {w: i for i, w in enumerate(head_rows.column(0).to_pylist())}
    head_n, head_lp = (np.array(head_rows.column(i).to_pylist(), np.float64) for i in (1, 2))
    shared = docs.sparkSession.sparkContext.broadcast((head, head_n > 0, np.log10(head_n + 1), head_lp))
    # A document has one row for its frequent words (word null, its number for a hash) and one for each other word.
    fields = "row long, doc_id long, learn boolean, word binary, hash long, m long, known long, logs double, score double"

    names = ["row", "doc_id", "learn", "word", "hash", "m", "known", "logs", "score"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def packed(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    def run(batches):
        at, known, logs, lp = shared.value
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for row, doc_id, learn, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held, times = [], []
                for w, m in Counter(words_of(text)).items():
                    i = at.get(w)
                    if i is None:
                        out.append((row, doc_id, learn, w, word_hash(w), m, 0, 0.0, 0.0))
                        size += len(w)
                    else:
                        held.append(i)
                        times.append(m)
                m = np.array(times, np.float64)
                held = np.array(held, np.int64)
                out.append((row, doc_id, learn, None, row, sum(times), int(m @ known[held]), float(m @ logs[held]), float(m @ lp[held])))
                if len(out) >= BLOCK or size >= BLOCK_BYTES:
                    yield packed(out)
                    out, size = [], 0
        if out:
            yield packed(out)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), "learn", F.col(text_col).alias("text"))
    parts = rows.mapInArrow(run, fields)
    joined = parts.join(words.select("hash", "word", "n", "lp"), ["hash", "word"], "left")
    rare = F.col("n").isNotNull()
    return joined.groupBy("row", "doc_id", "learn").agg(
        F.sum("m").alias("tokens"),
        F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(F.col("known"))).alias("known"),
        F.sum(F.when(rare, F.col("m") * F.log10(F.col("n") + 1)).otherwise(F.col("logs"))).alias("logs"),
        F.sum(F.when(rare, F.col("m") * F.col("lp")).otherwise(F.col("score"))).alias("score"),
    )


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row (see the module).

    Null texts count as empty: one token, the end. Rows with a null id are scored but not learned from (held_out
    false). Repeated rows are rows of their own. Without any training row all counts are 0. Scores are log10.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    learn = F.coalesce(id_bucket(id_col, FOLDS) != HELD_OUT, F.lit(False))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), learn.alias("learn"))
    ends = docs.where("learn").count()
    counts = word_counts(docs)
    running, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    tokens, kinds = running + ends, distinct + (ends > 0)
    log_probs, end_lp = piece_log_probs(counts, ends, path)
    scores = document_scores(docs, word_table(counts, log_probs, path))
    end_log = float(np.log10(ends + 1))
    norm = float(np.log10(tokens + kinds + 1))
    return scores.select(
        "doc_id",
        F.coalesce(id_bucket("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        (F.col("tokens") + 1).alias("n_tokens"),
        (F.col("known") + int(ends > 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + end_log - (F.col("tokens") + 1) * norm).alias("base_score"),
        (F.col("score") + end_lp / float(np.log(10))).alias("score"),
    )
