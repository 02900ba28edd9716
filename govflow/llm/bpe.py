"""Byte-level BPE over rank files: encoding and decoding of whole texts.

Merges run on padded numpy matrices. Pieces are bucketed by length; in each round every row of a matrix merges its
leftmost pair of minimum rank, which a vectorised open-addressing hash table looks up, and the row is compacted.
Spark partitions the documents; a task holds one batch, a bounded cache of encoded words and the rank tables.
"""

from __future__ import annotations

import base64
import heapq
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHED_CHARS, bounded_batches, slices

DEFAULT_RANKS = "byte_bpe_multi_50k.tiktoken"
#: Unicode's White_Space, which the tokenizer's \s stands for (fixed values).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Rows of one matrix, and the piece length in bytes from which a heap replaces the matrix rounds (the result is the same).
MATRIX_ROWS, LONG_PIECE = 4096, 512
#: Encoded words that a Python worker keeps at most.
CACHE_WORDS = 400_000
NONE = np.int64(1 << 40)


class PairTable:
    """Open addressing from (left id, right id) to the merged id."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = self._key(left, right)
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.keys[slot[placed]], self.values[slot[placed]] = keys[placed], merged[placed]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)

    @staticmethod
    def _key(left, right):
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids; NONE where a pair has none or holds padding (-1)."""
        keys = self._key(left, right).ravel()
        keys[((left < 0) | (right < 0)).ravel()] = -2
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        todo = np.flatnonzero((found != keys) & (found >= 0) & (keys >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out.reshape(left.shape)


class ByteBPE:
    """A rank file with its hash table of pairs."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        rows = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.pairs = PairTable(*np.array(rows, np.int64).T)
        pattern = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
        self.pieces = regex.compile(pattern)
        # No match of the pattern runs from a non-space into a space, so a text can be cut there.
        self.words = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        self.cache: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece (none is empty)."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = np.array([rank], np.int64)
            elif len(piece) >= LONG_PIECE:
                out[i] = self._merge_long(piece)
            else:
                buckets.setdefault((len(piece) - 1).bit_length(), []).append(i)
        for rows in buckets.values():
            for at in range(0, len(rows), MATRIX_ROWS):
                part = rows[at : at + MATRIX_ROWS]
                for i, ids in zip(part, self._merge_matrix([pieces[i] for i in part]), strict=True):
                    out[i] = ids
        return out

    def _merge_matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        ids = np.where(np.arange(width)[None, :] < lengths[:, None], self.byte_ids[raw], -1)
        out: list = [None] * len(pieces)
        rows = np.arange(len(pieces))
        while len(rows):
            rank = self.pairs.get(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.full((len(rows), 1), NONE)
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), at]
            done = best == NONE
            for k in np.flatnonzero(done):
                out[rows[k]] = ids[k, : lengths[k]]
            live = ~done
            rows, ids, lengths, at, best = rows[live], ids[live], lengths[live], at[live], best[live]
            if not len(rows):
                break
            ids[np.arange(len(rows)), at] = best
            column = np.arange(ids.shape[1] - 1)[None, :]
            ids = np.take_along_axis(ids, column + (column > at[:, None]), axis=1)
            lengths = lengths - 1
            ids[column >= lengths[:, None]] = -1
            ids = ids[:, : int(lengths.max())]
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for a very long piece: a heap of (rank, position) over a linked list."""
        ids = [int(x) for x in self.byte_ids[np.frombuffer(piece, np.uint8)]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        text = [self.tokens[i] for i in ids]
        heap = [(r, i) for i in range(n - 1) if (r := self.ranks.get(text[i] + text[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or self.ranks.get(text[i] + text[j]) != rank:
                continue
            ids[i], text[i], ids[j] = rank, text[i] + text[j], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := self.ranks.get(text[i] + text[after[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := self.ranks.get(text[before[i]] + text[i])) is not None:
                heapq.heappush(heap, (r, before[i]))
        return np.array([x for x in ids if x >= 0], np.int64)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [ids for part in slices(texts) for ids in self._encode(part)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        split = [self.words.findall(t) for t in texts]
        new = list({w for words in split for w in words} - self.cache.keys())
        parts = [[p.encode() for p in self.pieces.findall(w)] for w in new]
        unique = list(dict.fromkeys(p for ps in parts for p in ps))
        coded = {p: ids.astype("<u4").tobytes() for p, ids in zip(unique, self.merge(unique), strict=True)}
        known = self.cache
        for w, ps in zip(new, parts, strict=True):
            known[w] = b"".join([coded[p] for p in ps])
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > CACHED_CHARS:
                del known[w]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """doc_id, ids: the whole text's ids as little-endian unsigned 32-bit integers (binary).

    A null or empty text has no ids (empty binary). Null and repeated ids pass through; rows are independent. Other
    columns of ``docs`` are not read. Special tokens are never made: their strings are ordinary text.
    """
    path = ranks_path or public_tokenizers.path(DEFAULT_RANKS)
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def encode(batches):
        model = load(path)
        for batch in batches:
            ids = model.encode_batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return rows.mapInArrow(encode, "doc_id long, ids binary")


def bpe_decode(encoded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id, ids and the decoded bytes. Null ids count as none; an id outside the vocabulary is an error."""
    path = ranks_path or public_tokenizers.path(DEFAULT_RANKS)

    def decode(batches):
        model = load(path)
        for batch in batches:
            out = [model.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, ids binary, decoded binary")
