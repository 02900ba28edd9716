"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

A document's tokens are cut into pieces of at most ``capacity``; full pieces are sequences of their own, all shorter
ones are packed. Shards of a bounded number of pieces evolve on islands: each island is one task's work on one shard.
Crossover injects well-filled bins of one parent into the other, removes the bins that hold a piece twice and puts
the displaced pieces back by best fit. Between epochs each island's best packing moves to the next island of its ring
(a shuffle by shard and island). The fullest bins of a shard's best packing are final; the pieces of its other bins go
on to a next round of fewer shards, until one shard has taken them all. Where a round finishes little, less filled bins
count as final too, so that the worst of all shards are packed together.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHED_CHARS, bounded_batches, materialize, slices

TOKENIZER = "word_bpe_49k.json"
CAPACITY, END = 2048, 0
#: Pieces of a shard, islands of its ring, packings of an island, epochs between migrations, offspring of an epoch.
SHARD, ISLANDS, POPULATION, EPOCHS, OFFSPRING = 3000, 2, 4, 2, 12
#: Crossover opens the bins that are less filled than one of these shares, and best-fits displaced pieces by decreasing
#: size, which it shuffles by up to one of these factors.
OPENED, SHUFFLED = (0.9, 0.99, 1.0), (0.02, 1.0)
#: A bin is final when it is filled to this share; later rounds try to fill the others better. The next share holds
#: from where a round has finished less than a tenth of its pieces.
WELL_FILLED = (0.995, 0.97, 0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.5, 0.3, 0.0)
#: Rounds that a sequence's number has room for. A round leaves at most nine tenths of the pieces or takes the next share.
ROUNDS = 512
#: Words of which a Python worker keeps the ids.
CACHE_WORDS = 250_000


#: Letters of simple texts: besides ASCII a text may hold letters of Latin-1 and Latin Extended-A, which are composed
#: already and lower-case to one letter each (but for the dotted capital I).
LETTERS = "a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u017f"
OTHER_THAN_SIMPLE = re.compile("[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]")
#: Runs of letters, and of others; from an apostrophe on the rest of a word, as the tokenizer knows 's, 't and so on.
RUNS = re.compile(f"[{LETTERS}]+|[^ \\t\\n{LETTERS}']*'[^ \\t\\n]*|[^ \\t\\n{LETTERS}']+")
WORDS = re.compile(r"[^ \t\n]+")
#: The byte-level alphabet: bytes that print stand for themselves, the others for characters from 256 on.
UNPRINTED = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
ALPHABET = {b: 256 + i for i, b in enumerate(UNPRINTED)}


class WordTokenizer:
    """Ids of whole texts by the library, kept for words that come again.

    The tokenizer drops white space, and no token runs across it or from a letter to another character. So a text's
    words, or for simple texts its runs of letters and of other characters, are encoded apart. Runs of letters need no
    normalisation and go to the tokenizer's model directly. The strings of its special tokens are these tokens, as in
    the library's plain call; they cut a text before anything else.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: np.array([i], "<u4").tobytes() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.tokenizer.encode_special_tokens = True  # what is left between them has none
        self.model = self.tokenizer.model
        self.cache: dict[str, bytes] = dict(self.special)

    def split(self, text: str) -> list[str]:
        out = []
        for part in self.parts.split(text):
            if part in self.special:
                out.append(part)
            else:
                out += WORDS.findall(part) if OTHER_THAN_SIMPLE.search(part) else RUNS.findall(part.lower())
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return [ids for part in slices(texts) for ids in self._encode(part)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        used = {w for words in split for w in words}
        if len(self.cache) > CACHE_WORDS:
            self.cache = {w: ids for w, ids in self.cache.items() if w in used} | self.special
        new = used - self.cache.keys()
        letters = re.compile(f"[{LETTERS}]+").fullmatch
        tokenize, cache = self.model.tokenize, self.cache
        others = []
        for w in new:
            if letters(w) and w == w.lower():
                bytewise = w if w.isascii() else w.encode().decode("latin-1").translate(ALPHABET)
                cache[w] = np.array([t.id for t in tokenize(bytewise)], "<u4").tobytes()
            else:
                others.append(w)
        for w, coded in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            cache[w] = np.array(coded.ids, "<u4").tobytes()
        out = [b"".join(map(cache.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > CACHED_CHARS:
                del cache[w]
        return out


@lru_cache(maxsize=2)
def load(path: str) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    return WordTokenizer(path)


PIECES = "doc_id long, piece int, start long, length long, ids binary"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of each document's pieces.

    A document is its ids and an end id; a null text counts as empty, which leaves the end id alone.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    end, step = np.array([END], "<u4").tobytes(), 4 * capacity

    def cut(batches):
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), load(path).encode_batch(batch.column(1).to_pylist()), strict=True):
                ids += end
                out += [(doc_id, i, i * capacity, len(part) // 4, part) for i in range(-(-len(ids) // step)) for part in (ids[i * step : (i + 1) * step],)]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return rows.mapInArrow(cut, PIECES)


# -- one shard's packings: a packing is a list of bins, a bin a list of positions in ``sizes`` ------------------------


def best_fit(order: list[int], sizes: list[int], capacity: int, bins: list[list[int]], free: list[int]) -> None:
    """Put the pieces of ``order`` into the fullest bins that take them; opens bins as needed."""
    room = sorted((f, b) for b, f in enumerate(free))
    for i in order:
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, b = room.pop(at)
            bins[b].append(i)
        else:
            left, b = capacity, len(bins)
            bins.append([i])
            free.append(0)
        free[b] = left - sizes[i]
        insort(room, (free[b], b))


def fresh(sizes: list[int], capacity: int, rng: random.Random, jitter: float) -> list[list[int]]:
    """Best fit in decreasing size; ``jitter`` shuffles neighbours in size for variety."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + jitter * rng.random()))
    bins: list[list[int]] = []
    best_fit(order, sizes, capacity, bins, [])
    return bins


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; among as many, fuller full bins (the mean square of the fill)."""
    fill = [sum(sizes[i] for i in b) / capacity for b in bins]
    return -len(bins), sum(f * f for f in fill) / max(1, len(bins))


def crossover(one: list[list[int]], two: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Inject well-filled bins of ``two`` into ``one``; drop the bins of ``one`` that hold any of their pieces."""
    filled = sorted(two, key=lambda b: -sum(sizes[i] for i in b))
    chosen = [b for b in filled[: max(1, len(filled) // 2)] if rng.random() < 0.5] or filled[:1]
    taken = {i for b in chosen for i in b}
    stays = [b for b in one if taken.isdisjoint(b)]
    placed = taken.union(*stays)
    bins = [list(b) for b in (*chosen, *stays)]
    # Less filled bins are opened up as well, so that best fit has pieces to choose from.
    least = capacity * rng.choice(OPENED)
    bins.sort(key=lambda b: -sum(sizes[i] for i in b))
    while len(bins) > 1 and sum(sizes[i] for i in bins[-1]) < least:
        placed.difference_update(bins.pop())
    jitter = rng.choice(SHUFFLED) * rng.random()
    displaced = sorted((i for i in range(len(sizes)) if i not in placed), key=lambda i: -sizes[i] * (1 + jitter * rng.random()))
    best_fit(displaced, sizes, capacity, bins, [capacity - sum(sizes[i] for i in b) for b in bins])
    return bins


def evolve(sizes: list[int], population: list[list[list[int]]], capacity: int, rng: random.Random) -> list[list[list[int]]]:
    """One epoch of an island; the best packing comes first."""
    score = lambda bins: fitness(bins, sizes, capacity)
    lower = -(-sum(sizes) // capacity)
    population = sorted(population, key=score, reverse=True)
    for _ in range(OFFSPRING):
        if len(population[0]) <= lower:
            break
        one, two = rng.sample(population, 2) if len(population) > 1 else (population[0], population[0])
        population.append(crossover(one, two, sizes, capacity, rng))
        population = sorted(population, key=score, reverse=True)[:POPULATION]
    return population


def _labels(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.empty(n, np.int32)
    for b, held in enumerate(bins):
        out[held] = b
    return out


def _bins(labels: np.ndarray) -> list[list[int]]:
    order = np.argsort(labels, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1)]


STATE = "shard long, island int, sizes array<int>, population array<array<int>>, migrant array<int>"


def _epoch(first: bool, capacity: int):
    def run(batches):
        for frame in batches:
            out = []
            for shard, island, sizes, population, migrant in frame.itertuples(index=False, name=None):
                sizes = [int(x) for x in sizes]
                rng = random.Random(f"{shard}/{island}/{0 if first else len(population)}")
                if first:
                    # An island begins with one plain best fit and shuffled ones.
                    held = [fresh(sizes, capacity, rng, 0.0 if k == 0 else 0.05 * (island + 1)) for k in range(POPULATION)]
                else:
                    held = [_bins(np.asarray(p)) for p in population]
                    if migrant is not None:
                        held.append(_bins(np.asarray(migrant)))
                held = evolve(sizes, held, capacity, rng)
                out.append((shard, island, sizes, [_labels(b, len(sizes)).tolist() for b in held], _labels(held[0], len(sizes)).tolist()))
            yield pd.DataFrame(out, columns=["shard", "island", "sizes", "population", "migrant"])

    return run


def _evolved(shards: DataFrame, capacity: int) -> DataFrame:
    """shard, labels: the best packing of each shard over its islands."""
    state = shards.select("shard", F.explode(F.lit(list(range(ISLANDS))).cast("array<int>")).alias("island"), "sizes", F.lit(None).cast("array<array<int>>").alias("population"), F.lit(None).cast("array<int>").alias("migrant"))
    for epoch in range(EPOCHS):
        state = state.mapInPandas(_epoch(epoch == 0, capacity), STATE)
        if epoch + 1 < EPOCHS:
            elite = state.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), "migrant")
            state = materialize(state.drop("migrant").join(elite, ["shard", "island"]).select("shard", "island", "sizes", "population", "migrant"), "packing-islands")
    best = F.element_at("population", 1)
    return state.groupBy("shard").agg(F.min_by(best, F.struct(F.array_max(best), "island")).alias("labels"))


ITEM = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>"


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to items (doc_id, piece, start, length, ids_crc32), each shorter than ``capacity`` or full.

    Repeated rows are pieces of their own. Every sequence is gapless from 0 and at most ``capacity`` long.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    items = materialize(items.select(columns), "packing-items")
    full = items.where(F.col("length") >= capacity).select(*columns, (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts, rest, round_no, level = [full], items.where(F.col("length") < capacity), 0, 0
    left = rest.count()
    while left:
        if round_no == ROUNDS:
            raise RuntimeError(f"packing took more than {ROUNDS} rounds")
        shards = -(-left // SHARD)
        # Dealt by a hash of the rows, so each shard has a like mix of sizes.
        dealt = rest.withColumn("shard", F.pmod(F.xxhash64(F.lit(round_no), *columns, F.monotonically_increasing_id()), F.lit(shards)))
        grouped = dealt.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct(columns))).alias("items"))
        grouped = materialize(grouped.withColumn("sizes", F.transform("items", lambda x: x["length"].cast("int"))), "packing-shards")
        best = _evolved(grouped.select("shard", "sizes"), capacity)
        packed = grouped.select("shard", "items").join(best, "shard").select("shard", F.explode(F.arrays_zip("items", "labels")).alias("x")).select("shard", F.col("x.labels").alias("bin"), "x.items.*")
        bins = packed.groupBy("shard", "bin").agg(F.collect_list(F.struct(columns)).alias("held"), F.sum("length").alias("filled"))
        bins = materialize(bins, "packing-bins")
        if shards == 1:
            level = len(WELL_FILLED) - 1
        before = left
        # Pieces that each share would leave open, the first (highest) share first.
        open_pieces = bins.agg(*[F.coalesce(F.sum(F.when(F.col("filled") < share * capacity, F.size("held"))), F.lit(0)) for share in WELL_FILLED]).first()
        while level + 1 < len(WELL_FILLED) and open_pieces[level] > 0.9 * before:
            level += 1
        left, enough = open_pieces[level], F.col("filled") >= WELL_FILLED[level] * capacity
        parts.append(_sequences(bins.where(enough), columns, round_no))
        rest = bins.where(~enough).select(F.explode("held").alias("x")).select("x.*")
        round_no += 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _sequences(bins: DataFrame, columns: list[str], round_no: int) -> DataFrame:
    """The pieces of final bins with their sequence and place. Numbers are odd: the round in the low bits, above it the
    bin and the shard."""
    number = ((F.col("shard") * (SHARD * 64) + F.col("bin")) * ROUNDS + round_no) * 2 + 1
    starts = F.transform("held", lambda x, i: F.struct(x.alias("x"), F.aggregate(F.slice("held", F.lit(1), i), F.lit(0).cast("long"), lambda s, y: s + y["length"]).alias("offset")))
    placed = bins.select(number.alias("sequence_id"), F.explode(starts).alias("p"))
    return placed.select(*[F.col(f"p.x.{c}").alias(c) for c in columns], "sequence_id", F.col("p.offset").alias("offset"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null ids and repeated rows are documents like others; an empty table gives none; other columns are not read.
    """
    cut = pieces(docs, id_col, text_col, capacity)
    items = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"))
    return pack(items, capacity)
