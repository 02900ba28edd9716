"""Canonical exact digests of documents, with DataFrame and SQL functions only.

Canonical form: compatibility composition (NFKC), full case folding, composition again, runs of white space to one
space, trimmed. The digest is 128 bits wide, two chained xxhash64 values of the canonical bytes. Rows are grouped by
digest; within a bucket that holds more than one row the canonical bytes are compared, and should a bucket ever hold
different bytes, its digests are extended by the SHA-256 of the bytes.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Unicode's White_Space (fixed values).
SPACES = r"[\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def _nfkc(text: Column) -> Column:
    return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def canonical(text: Column) -> Column:
    """The canonical form; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _nfkc(text), F.lit(True))
    return F.trim(F.regexp_replace(_nfkc(folded), SPACES, " "))


def wide_digest(form: Column) -> Column:
    return F.concat(F.lpad(F.lower(F.hex(F.xxhash64(F.lit(1), form))), 16, "0"), F.lpad(F.lower(F.hex(F.xxhash64(F.lit(2), form))), 16, "0"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint: equal exactly for texts of equal canonical form, 128-bit collisions aside.

    A null text counts as empty. Rows are independent; null and repeated ids pass through; an empty table gives none.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), wide_digest(canonical(F.col(text_col))).alias("fingerprint"))


def clashes(rows: DataFrame) -> DataFrame:
    """Digests of ``rows`` (digest, form) under which different canonical bytes occur.

    Copies are first merged by the map-side aggregation, so a digest with a third of all rows sends one smallest and
    one largest form from each task.
    """
    several = rows.groupBy("digest").agg(F.min("form").alias("low"), F.max("form").alias("high"))
    return several.where("low <> high").select("digest")


def _range_number(bounds: list[int], hot: dict[int, int]) -> Column:
    """The range of a row with columns k and sub_key: how many bounds lie below k, and for hot ids the part by digest.

    The bounds are held in runs, so that a row is compared with about twice the root of their number.
    """
    many = 1 << 32
    if not bounds:
        return F.lit(0).cast("long")
    step = math.isqrt(len(bounds)) + 1
    runs = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda of: F.size(F.filter(of, lambda b: b < F.col("k"))).cast("long")
    run = below(F.lit([r[0] for r in runs])) - 1
    # The runs as one array of arrays; run -1 is before the first bound.
    nested = F.array(*[F.lit(r) for r in runs])
    number = F.when(run < 0, F.lit(0).cast("long")).otherwise(run * step + below(F.get(nested, run.cast("int")))) * many
    if not hot:
        return number
    share = F.conv(F.substring("sub_key", 1, 8), 16, 10).cast("long")
    parts = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in hot.items() for x in pair]), F.col("k"))
    return F.when(F.col("sub_key") == "", number).otherwise(number + 1 + F.floor(share * parts / many).cast("long"))


def _in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and what the next document holds (next_text, next_digest, next_sha), in ascending id.

    Null ids come first. Among repeated ids the order is by digest. After the last comes the first. Documents are dealt
    to ranges of ids between approximate quantiles, four for each shuffle partition. An id that fills several ranges, as
    null may, is dealt to as many by digest. The first keys of the ranges (as many as there are ranges) go through the
    driver, and each range gets a copy of the row that follows it, so no range needs another.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    points = docs.select(key.alias("k")).agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], max(10_000, 4 * ranges))).first()[0]
    filled = Counter(points or [])
    bounds, hot = sorted(filled), {k: n for k, n in filled.items() if n > 1}
    form = canonical(F.col(text_col))
    # The digest of a row whose id fills several ranges; else empty, and the text is not read for it.
    sub_key = F.when(F.col("k").isin(list(hot)), wide_digest(form)).otherwise("") if hot else F.lit("")
    keyed = docs.select(key.alias("k"), F.col(text_col)).select("k", sub_key.alias("sub_key"))
    of_range = _range_number(bounds, hot)
    first = sorted((r.r, *r.least) for r in keyed.groupBy(of_range.alias("r")).agg(F.min(F.struct("k", "sub_key")).alias("least")).collect())
    ahead = [(k, s, before) for (before, *_), (_, k, s) in zip([first[-1], *first[:-1]], first, strict=True)] if first else []
    copies = F.broadcast(spark.createDataFrame(ahead, "k long, sub_key string, before long"))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        key.alias("k"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        form.alias("form"),
    ).select("doc_id", "k", "text", wide_digest(F.col("form")).alias("digest"), F.unhex(F.sha2(F.col("form").cast("binary"), 256)).alias("sha"))
    rows = rows.withColumn("sub_key", F.when(F.col("k").isin(list(hot)), F.col("digest")).otherwise("") if hot else F.lit(""))
    own = F.struct(of_range.alias("r"), F.lit(False).alias("guard"))
    guard = F.struct(F.col("before").alias("r"), F.lit(True).alias("guard"))
    placed = rows.join(copies, ["k", "sub_key"], "left").withColumn("at", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, guard))))
    order = Window.partitionBy("at.r").orderBy("at.guard", "k", "digest", "text")
    ahead_of = {name: F.lead(name).over(order).alias(f"next_{name}") for name in ("text", "digest", "sha")}
    return placed.select("doc_id", "text", "digest", "sha", "at", *ahead_of.values()).where("not at.guard").drop("at")


#: Digests that occur more than once are broadcast up to this many (under 20 MB), and joined by a shuffle beyond.
BROADCAST_DIGESTS = 200_000
SALTS = 16


def _repeated_forms(docs: DataFrame, text_col: str, prints: DataFrame) -> DataFrame:
    """digest and form of the documents whose digest occurs more than once."""
    repeated = materialize(prints.groupBy("digest").count().where("count > 1").select("digest"), "repeated-digests")
    forms = docs.select(canonical(F.col(text_col)).alias("form")).select(wide_digest(F.col("form")).alias("digest"), "form")
    if repeated.count() <= BROADCAST_DIGESTS:
        return forms.join(F.broadcast(repeated), "digest", "left_semi")
    salted = forms.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    dealt = repeated.withColumn("salt", F.explode(F.lit(list(range(SALTS)))))
    merged = salted.join(dealt, ["digest", "salt"], "left_semi").groupBy("digest", "salt").agg(F.min("form").alias("low"), F.max("form").alias("high"))
    return merged.select("digest", F.explode(F.array("low", "high")).alias("form"))


def edit_study(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit, whose last quarter is the beginning of the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edit replaces the last
    floor(n_chars / 4) code points by the first as many (or all) of the next document in ascending id; after the last
    comes the first, so a single document follows itself. A digest knows equal or not: the likeness is 1.0 or 0.0. Null
    texts count as empty, null ids come first, repeated rows are rows of their own, an empty table gives none.
    """
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    ordered = _in_order(docs, id_col, text_col).withColumn("n_chars", F.char_length("text").cast("long"))
    edited = ordered.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 4) as int))"), F.col("next_text").substr(F.lit(1), quarter)))
    prints = edited.withColumn("edited_form", canonical(F.col("edited"))).select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "digest",
        "sha",
        wide_digest(F.col("edited_form")).alias("edited_digest"),
        F.unhex(F.sha2(F.col("edited_form").cast("binary"), 256)).alias("edited_sha"),
        "next_digest",
        "next_sha",
    )
    prints = materialize(prints, "fingerprints")
    clash = clashes(_repeated_forms(docs, text_col, prints))

    def settled(digest: str, sha: str):
        return F.when(F.col(f"{digest}_clash").isNotNull(), F.concat(F.col(digest), F.lit("-"), F.lower(F.hex(sha)))).otherwise(F.col(digest))

    out = prints
    if clash.limit(1).count():
        for name in ("digest", "edited_digest", "next_digest"):
            out = out.join(clash.select(F.col("digest").alias(f"{name}_key"), F.lit(1).alias(f"{name}_clash")), F.col(name) == F.col(f"{name}_key"), "left")
    else:
        out = out.select("*", *[F.lit(None).alias(f"{name}_clash") for name in ("digest", "edited_digest", "next_digest")])
    out = out.withColumns({"fingerprint": settled("digest", "sha"), "edited_fingerprint": settled("edited_digest", "edited_sha"), "next_fingerprint": settled("next_digest", "next_sha")})
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        (F.col("fingerprint") == F.col("edited_fingerprint")).cast("double").alias("near_edited"),
        (F.col("fingerprint") == F.col("next_fingerprint")).cast("double").alias("near_next"),
    )
