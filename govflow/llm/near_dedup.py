"""Near-duplicates by MinHash: banding, signature verification, exact verification, connected components.

1. Each text becomes a set of word shingles (64-bit hashes) and 256 minima of universal hashes: 32 band keys of four
   minima each from the first 128, and a signature of four bits from each. Equal sets are merged first, by a digest.
2. Sets that share a band key are candidates. A bucket is never expanded into its pairs: every member is compared with
   one leader, another in each band. Signatures drop the hopeless; each set keeps its four most alike leaders, which
   are confirmed on the full sets. The links are merged into components.
3. Exact rest, for buckets that still hold several components. Their members are compared with one pivot, the set P with
   the most links in the largest component at hand, and are known from then on by their differences from it: R, what
   they lack of P, and A, what they have beyond it. Two sets (R, A) and (R', A') are linked when they share at least
   (100 (|R| + |R'|) + percent (|A| + |A'|) - (100 - percent) |P|) / (100 + percent) differences. A set is linked with P
   when its own part, 100 |R| + percent |A|, is at most (100 - percent) |P|; so every pair but that of two sets linked
   with P, which are one component already, has to share a difference. Differences are put in order from rare to
   frequent, and a pair meets only in a difference that leaves both sets enough others behind it. In a group of edited
   copies that is where they share an edit; so the pairs grow with the group and not with its square. The differences
   that a pair shares are then counted, which decides exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CACHED_CHARS, bounded_batches, checked_broadcast, checked_semi_join, fresh_name, materialize
from .components import connected_components

HASHES, BANDS, ROWS = 256, 32, 4
#: Leaders that each set is confirmed against in the first round; the second round is exact whatever this is.
NEAREST = 4
WORDS_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A difference that so many sets have from one pivot counts as frequent; the others make at most this many pairs each.
FREQUENT = 32
#: Frequent differences that are broadcast at most, a few tens of MB; more of them are joined by a shuffle.
BROADCAST_FREQUENT = 500_000
#: Shingles of the sets that a task of the confirmation keeps, 8 bytes each, and differences that it hands on at a time.
HELD_SHINGLES, PART = 4_000_000, 500_000
#: Word hashes that a Python worker keeps.
CACHE_WORDS = 250_000
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SEEDS = np.random.default_rng(20240607).integers(0, 2**63, (2, HASHES), dtype=np.uint64)
FACTORS, SHIFTS = _SEEDS[0] * np.uint64(2) + np.uint64(1), _SEEDS[1]
SIGNATURE = [f"s{i}" for i in range(HASHES // 16)]
_words: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Distinct shingle hashes, ascending. Fewer than ``k`` words make one shingle, no words none."""
    words = (text or "").encode().translate(WORDS_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > CACHE_WORDS:
        _words.clear()
    long = []
    for w in words:
        if w not in _words:
            _words[w] = xxhash.xxh64_intdigest(w) - (1 << 63)
            if len(w) > CACHED_CHARS:
                long.append(w)
    hashes = np.fromiter(map(_words.__getitem__, words), np.int64, len(words)).view(np.uint64)
    for w in long:
        del _words[w]
    width = min(k, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        total = mix(total * MIX[0] + hashes[i : len(words) - width + 1 + i])
    return np.unique(total)


def minima(hashes: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(out, (FACTORS[:, None] * hashes[None, at : at + 1024] + SHIFTS[:, None]).min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least[: BANDS * ROWS].reshape(BANDS, ROWS).T:
        key = mix(key * MIX[0] + column)
    return key.view(np.int64)


def signature(least: np.ndarray) -> np.ndarray:
    """Four bits of each minimum, 16 in a 64-bit integer."""
    nibbles = mix(least) >> np.uint64(60)
    return (nibbles.reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64)


def sketch(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest of the set (null for an empty set), bands, the signature's columns."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    fields = f"doc_id long, n_shingles long, digest binary, bands array<long>, {', '.join(f'{s} long' for s in SIGNATURE)}"

    def run(batches):
        for batch in batches:
            sizes, digests, bands, signs = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, k)
                least = minima(found)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                bands.append(band_keys(least))
                signs.append(signature(least))
            flat = np.concatenate(bands) if bands else np.empty(0, np.int64)
            offsets = pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(flat))]
            table = np.array(signs, np.int64).reshape(-1, len(SIGNATURE))
            columns += [pa.array(np.ascontiguousarray(table[:, i])) for i in range(len(SIGNATURE))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "bands", *SIGNATURE])

    return rows.mapInArrow(run, fields)


def unlike(a: str, b: str) -> Column:
    """How many of the four-bit minima of two signatures differ."""
    ones = 0x1111111111111111

    def differing(s):
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        spread = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        return F.bit_count(spread.bitwiseAND(F.lit(ones)))

    out = differing(SIGNATURE[0])
    for s in SIGNATURE[1:]:
        out = out + differing(s)
    return out


def most_unlike(percent: int) -> int:
    """Differing minima that a pair at the threshold stays below, but for five standard deviations (3 in 10 million)."""
    p = (1 - percent / 100) * 15 / 16
    return math.ceil(HASHES * p + 5 * math.sqrt(HASHES * p * (1 - p)))


def similar_size(a: str, b: str, percent: int) -> Column:
    small, large = F.least(f"{a}.n_shingles", f"{b}.n_shingles"), F.greatest(f"{a}.n_shingles", f"{b}.n_shingles")
    return small * 100 >= large * percent


class HeldSets:
    """Shingle sets of the texts that came last, by id."""

    def __init__(self, k: int):
        self.k, self.held, self.size = k, {}, 0

    def of(self, i: int, text: str) -> np.ndarray:
        known = self.held.setdefault(i, [])
        for other, found in known:
            if other is text or other == text:
                return found
        found = shingles(text, self.k)
        self.size += len(found)
        if self.size > HELD_SHINGLES:
            self.held, self.size, known = {}, len(found), []
            self.held[i] = known
        known.append((text, found))
        return found


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left, right = texts.select(F.col("id").alias("u"), F.col("text").alias("a")), texts.select(F.col("id").alias("v"), F.col("text").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b")


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union; texts: id, text."""

    def run(batches):
        sets = HeldSets(k)
        for batch in batches:
            keep = []
            for u, v, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one, two = sets.of(u, a), sets.of(v, b)
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * both >= percent * (len(one) + len(two) - both) > 0)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])

    return _with_texts(pairs, texts).mapInArrow(run, "u long, v long")


def differences(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """u, v, reference, need, excess, elements of pairs of a set u and its pivot v.

    ``reference`` stands for the pivot's set (an id may have several), ``elements`` are the shingles of one of the two alone, ``need`` is 100 |R| + percent |A|, and ``excess`` how far
    that is above (100 - percent) |P|: not above 0 for sets that are linked with their pivot.
    """
    names = ["u", "v", "reference", "need", "excess", "elements"]

    def packed(rows):
        sizes = np.cumsum([0, *(len(r[-1]) for r in rows)]).astype(np.int32)
        flat = np.concatenate([r[-1] for r in rows]).view(np.int64)
        columns = [pa.array(c, pa.int64()) for c in zip(*(r[:-1] for r in rows), strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))], names)

    def run(batches):
        sets = HeldSets(k)
        for batch in batches:
            rows, size = [], 0
            for u, v, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one, pivot = sets.of(u, a), sets.of(v, b)
                apart = np.setxor1d(one, pivot, assume_unique=True)
                lacks = (len(apart) - len(one) + len(pivot)) // 2
                need = 100 * lacks + percent * (len(apart) - lacks)
                reference = xxhash.xxh64_intdigest(pivot.tobytes()) - (1 << 63)
                rows.append((u, v, reference, need, need - (100 - percent) * len(pivot), apart))
                size += len(apart)
                if size > PART:
                    yield packed(rows)
                    rows, size = [], 0
            if rows:
                yield packed(rows)

    return _with_texts(pairs, texts).mapInArrow(run, "u long, v long, reference long, need long, excess long, elements array<long>")


def _split_buckets(members: DataFrame, links: DataFrame, parts: DataFrame) -> DataFrame:
    """u, v, inside: the members of buckets that hold several components, each with the pivot of its bucket.

    The pivot is the set with the most links of the largest component at hand (by a hash among equals), so that buckets
    that hold the same sets take the same pivot. ``inside`` tells whether u is of the pivot's component.
    """
    degrees = links.select(F.col("u").alias("id")).union(links.select("v")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    hubs = parts.join(degrees, "id").groupBy("component").agg(F.max_by("id", F.struct("n", -F.col("id"))).alias("hub"), F.count(F.lit(1)).alias("size"))
    hubs = materialize(hubs, "hubs")
    placed = members.select("band", "id").join(parts, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    split = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
    open_members = materialize(placed.join(split, "band"), "open-members")
    held = open_members.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    known = held.join(checked_broadcast(hubs), "component", "left").select("band", "component", F.coalesce("hub", "component").alias("hub"), F.coalesce("size", F.lit(1)).alias("size"))
    pivots = known.groupBy("band").agg(F.max_by(F.struct("hub", "component"), F.struct("size", F.xxhash64("hub"))).alias("p"))
    chosen = open_members.join(pivots, "band").where("id <> p.hub")
    return chosen.groupBy(F.col("id").alias("u"), F.col("p.hub").alias("v")).agg(F.first(F.col("component")).alias("component"), F.first(F.col("p.component") == F.col("component")).alias("inside"))


def _rest(differing: DataFrame, percent: int) -> DataFrame:
    """Linked pairs (u, v) of sets with a common pivot; differing: row, u, reference, component, outside, need, excess, elements.

    Pairs of one component and pairs of two sets that aren't ``outside`` are left out.
    """
    q = 100 + percent
    light = differing.select("row", "u", "component", "outside", "need", "excess", F.size("elements").cast("long").alias("d"))
    single = differing.select("row", "reference", F.explode("elements").alias("element"))
    frequent = materialize(single.groupBy("reference", "element").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FREQUENT), "frequent-differences")
    ranked = single.join(checked_broadcast(frequent, BROADCAST_FREQUENT), ["reference", "element"], "left")
    order = Window.partitionBy("row").orderBy(F.coalesce("n", F.lit(0)), "element")
    ranked = ranked.withColumn("at", F.row_number().over(order) - 1).select("row", "reference", "element", "at")
    ranked = ranked.join(light, "row").withColumn("behind", (F.col("d") - F.col("at")) * q)
    # What a partner asks for besides: of one that is outside 1 at least, of any other a difference, ``percent`` or more.
    first, second = F.col("outside") & (F.col("behind") >= F.col("excess") + percent), F.col("behind") > F.col("need")
    ranked = materialize(ranked.where(first | second), "ranked-differences")
    a, b = ranked.where(first).alias("a"), ranked.where(second).alias("b")
    asked = F.col("a.excess") + F.col("b.need")
    apart = (F.col("a.component") != F.col("b.component")) & (F.least("a.behind", "b.behind") >= asked)
    met = a.join(b, (F.col("a.reference") == F.col("b.reference")) & (F.col("a.element") == F.col("b.element")) & apart)
    pairs = materialize(met.select(F.least("a.row", "b.row").alias("one"), F.greatest("a.row", "b.row").alias("two")).distinct(), "rest-pairs")
    x, y = (differing.select(F.col("row").alias(end), F.struct("u", "need", "excess", "elements").alias(side)) for end, side in (("one", "x"), ("two", "y")))
    shared = F.size(F.array_intersect("x.elements", "y.elements")) * q
    return pairs.join(x, "one").join(y, "two").where(shared >= F.col("x.excess") + F.col("y.need")).select(F.col("x.u").alias("u"), F.col("y.u").alias("v"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: one row of each component stays, that of the smallest id.

    Two texts are linked when 100 * |A and B| >= percent * |A or B| over their sets of ``k``-word shingles (words are
    split at ASCII white space, A-Z lower-cased). Null texts and texts without words have empty sets, linked with
    nothing. Rows that repeat an id are one document. Rows with a null id are linked with nothing, have a null
    component and stay. Other columns of ``docs`` are not read.
    """
    sketches = materialize(sketch(docs, k, id_col, text_col), "sketches")
    with_sets = sketches.where("doc_id is not null and digest is not null")
    # One row for each distinct set: the smallest id that has it.
    sets = with_sets.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "bands", *SIGNATURE)).alias("x"))
    sets = materialize(sets.select("digest", F.col("x.doc_id").alias("id"), "x.n_shingles", "x.bands", *[f"x.{s}" for s in SIGNATURE]), "distinct-sets")
    light = sets.select("id", "n_shingles", *SIGNATURE)

    members = sets.select(F.explode("bands").alias("band"), "id")
    leaders = members.groupBy("band").agg(F.min_by("id", F.xxhash64("id", "band")).alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(members.join(leaders.select("band", "leader"), "band"), "bucket-members")
    limit = most_unlike(percent)

    def promising(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(light.select(F.col("id").alias("u"), F.struct("n_shingles", *SIGNATURE).alias("a")), "u")
        joined = joined.join(light.select(F.col("id").alias("v"), F.struct("n_shingles", *SIGNATURE).alias("b")), "v")
        return joined.where(similar_size("a", "b", percent)).withColumn("unlike", unlike("a", "b")).where(F.col("unlike") <= limit)

    starred = members.where("id <> leader").select(F.col("id").alias("u"), F.col("leader").alias("v")).distinct()
    nearest = promising(starred).groupBy("u").agg(F.slice(F.array_sort(F.collect_list(F.struct("unlike", "v"))), 1, NEAREST).alias("x"))
    first = materialize(nearest.select("u", F.explode("x.v").alias("v")), "first-pairs")

    documents = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        ends = materialize(pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct(), "pair-ends")
        return materialize(confirm(pairs, checked_semi_join(documents, ends, "id"), k, percent), "links")

    links = confirmed(first)
    parts = connected_components(links)

    # What the first round left apart although it shares a bucket.
    open_pairs = materialize(_split_buckets(members, links, parts), "open-pairs")
    ends = materialize(open_pairs.select(F.col("u").alias("id")).union(open_pairs.select("v")).distinct(), "open-ends")
    differing = differences(open_pairs.select("u", "v"), checked_semi_join(documents, ends, "id"), k, percent).join(open_pairs, ["u", "v"])
    outside = ~F.col("inside") & (F.col("excess") > 0)
    row = F.monotonically_increasing_id().alias("row")
    differing = materialize(differing.select(row, "u", F.col("v").alias("pivot"), "reference", "component", "inside", outside.alias("outside"), "need", "excess", "elements"), "differences")
    more = differing.where("excess <= 0 and not inside").select("u", F.col("pivot").alias("v")).union(_rest(differing, percent))
    more = materialize(more, "more-links")
    if more.limit(1).count():
        parts = connected_components(links.union(more))

    by_set = sets.select("digest", "id").join(parts, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    found = sketches.select("doc_id", "n_shingles", "digest")
    linked = found.where("doc_id is not null and digest is not null").join(by_set, "digest").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = found.where("doc_id is null or digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows without an id stay, and so do texts that are null or without words unless their id goes with another row. Rows that
    repeat an id share its decision. An empty table stays empty.
    """
    name = fresh_name("keep")
    stay = near_duplicates(docs, k, percent).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_semi")
