"""Merkle manifest of a dataset: a digest tree per group with exact ranks, one root, and a proof for each document.

Ranks come from counts, not from a sort. The ids of a group fall into small buckets; a hierarchy of digit histograms over
the buckets (each level counts the level below by one digit less) gives every bucket the number of rows before it, and
ranks within a bucket are local. Ids with many rows are ranked by the digits of their leaves in the same way.

The digits of a rank in the base of the fanout are the path to its leaf. Nodes that share a prefix of these digits form
one row of a tier (``fanout`` to the power of some levels leaves), so a tier of many levels costs one shuffle, and each
tier is thousands of times smaller than the one below. Proofs go back down the same tiers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, checked_broadcast, materialize

#: Bits of an id that a bucket leaves open, bits of a digit of the histograms, and rows of an id beyond which its rows are ranked by their leaves.
OPEN_BITS, DIGIT_BITS, MANY = 6, 11, 1024
#: Children of a node of a tier at most (a power of the fanout).
TIER = 4096
#: Rows of a repeated leaf that are numbered at a time.
RUN = 4096
STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
PATH = "array<struct<left string, right string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(values: list[Column]) -> Column:
    """Lowercase hex sha256 of the fields in their order."""
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def folded(leaf: Column, path: str) -> Column:
    """The root that a leaf (hex) and its path lead to."""
    return F.aggregate(path, leaf, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]).cast("binary"), 256))


def siblings_digest(path: str) -> Column:
    """sha256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "").cast("binary"), 256)


@dataclass
class Manifest:
    """What a manifest keeps: ``tiers`` of documents and of groups (lowest first), and one row a group in ``groups``
    (grp, size, subroot, rank). ``root`` is None for an empty table."""

    root: str | None
    tiers: list[DataFrame]
    group_tiers: list[DataFrame]
    groups: DataFrame
    fanout: int

    def proofs(self) -> DataFrame:
        """doc_id, leaf, claim, path, subroot, root of every row. ``path`` has the siblings left and right of each level,
        from the leaf up to the root; a node without siblings has empty ones."""
        top = self.groups.select(F.lit("").alias("grp"), F.lit(0).cast("long").alias("node"), F.array().cast(PATH).alias("path"), F.lit("").alias("subroot")).limit(1)
        for tier in reversed(self.group_tiers):
            top = _children(tier, top, self.fanout)
        above = self.groups.join(top.select(F.col("node").alias("rank"), "path"), "rank").select("grp", F.lit(0).cast("long").alias("node"), "path", "subroot")
        for tier in reversed(self.tiers[1:]):
            above = materialize(_children(tier, above, self.fanout), "merkle-paths")
        return _leaves(self.tiers[0], above, self.fanout).withColumn("root", F.lit(self.root))


def group_key(value: Column) -> Column:
    """A string that is never null and orders null first, then the values by their UTF-8 bytes."""
    return F.when(value.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), value.cast("string")))


def build(docs: DataFrame, leaf: Column, claim: Column | None = None, id_col: str = "doc_id", group_col: str = "lang", fanout: int = 2) -> Manifest:
    """The manifest of ``docs``: in each group, leaves ascend by id, and every ``fanout`` consecutive nodes (the last run
    may be shorter) become the sha256 of their hex digests until one is left; subroots likewise become the root.

    ``claim`` is a digest that may be null, carried along for checks against a proof. Null ids come before all others;
    rows that share an id, or have none, are in the order of their leaves, and equal leaves are leaves of their own.
    A null group is a group, the first one. An empty table has no root and no proofs. Only the columns named and those
    in ``leaf`` and ``claim`` are read.
    """
    if fanout < 2:
        raise ValueError("a node needs two children at least")
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), group_key(F.col(group_col)).alias("grp"), F.unhex(leaf).alias("leaf"), (F.unhex(claim) if claim is not None else F.lit(None).cast("binary")).alias("claim"))
    rows = rows.select(F.col("id").isNotNull().cast("int").alias("known"), F.coalesce("id", F.lit(0)).alias("id"), "grp", "leaf", "claim")
    ranked, sizes = _ranked(materialize(rows, "merkle-leaves"))
    sized = ranked.join(checked_broadcast(sizes), "grp")
    kid = F.struct("rank", F.col("leaf").alias("hash"), F.when(F.col("known") == 1, F.col("id")).alias("id"), "claim")
    tiers = _tiers(sized.select("grp", "size", "rank", kid.alias("kid")), fanout)
    subroots = tiers[-1].select("grp", F.col("root").alias("subroot"))
    groups = materialize(_ordered(subroots).join(checked_broadcast(sizes), "grp"), "merkle-groups")
    number = groups.count()
    kid = F.struct("rank", F.unhex("subroot").alias("hash"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("claim"))
    group_tiers = _tiers(groups.select(F.lit("").alias("grp"), F.lit(number).cast("long").alias("size"), "rank", kid.alias("kid")), fanout)
    root = group_tiers[-1].select("root").first()
    return Manifest(root[0] if root else None, tiers, group_tiers, groups, fanout)


def _bucket(known: str, id_: str) -> Column:
    return F.when(F.col(known) == 1, F.shiftright(F.col(id_), OPEN_BITS)).otherwise(F.lit(0))


def _starts(buckets: DataFrame) -> DataFrame:
    """grp, known, bucket, start: rows of the group before each bucket, of a histogram (grp, known, bucket, n).

    Level by level, a histogram by one digit less. Each window holds the values of one digit.
    """
    least, most = buckets.where("known = 1").agg(F.min("bucket"), F.max("bucket")).first()
    levels, shift = [buckets.select("grp", "known", F.col("bucket").alias("p"), "n")], 0
    while least is not None and (most >> shift) - (least >> shift) > 1:  # -1 and 0 stay apart at any shift
        shift += DIGIT_BITS
        levels.append(materialize(levels[-1].groupBy("grp", "known", F.shiftright("p", DIGIT_BITS).alias("p")).agg(F.sum("n").alias("n")), "merkle-histogram"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = levels.pop().select("grp", "known", "p", before(Window.partitionBy("grp").orderBy("known", "p")).alias("start"))
    for level in reversed(levels):
        parent = F.shiftright("p", DIGIT_BITS)
        inner = level.withColumn("parent", parent).withColumn("before", before(Window.partitionBy("grp", "known", "parent").orderBy("p")))
        found = inner.join(found.withColumnRenamed("p", "parent"), ["grp", "known", "parent"]).select("grp", "known", "p", (F.col("start") + F.col("before")).alias("start"))
    return found.withColumnRenamed("p", "bucket")


def _ranked(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leaves with their rank in their group (from 0), and the size of each group."""
    hot = materialize(leaves.groupBy("grp", "known", "id").agg(F.count(F.lit(1)).alias("w")).where(F.col("w") > MANY), "merkle-hot")
    light = leaves.withColumn("w", F.lit(1).cast("long"))
    some_hot = bool(hot.limit(1).count())
    if some_hot:  # each id with many rows is one row of weight
        keys = ["grp", "known", "id"]
        light = light.join(checked_broadcast(hot.select(keys)), keys, "left_anti")
        light = light.unionByName(hot.withColumns({"leaf": F.lit(None).cast("binary"), "claim": F.lit(None).cast("binary")}))
    light = light.withColumn("bucket", _bucket("known", "id"))
    buckets = materialize(light.groupBy("grp", "known", "bucket").agg(F.sum("w").alias("n")), "merkle-buckets")
    sizes = materialize(buckets.groupBy("grp").agg(F.sum("n").alias("size")), "merkle-sizes")
    within = Window.partitionBy("grp", "known", "bucket").orderBy("id", "leaf")
    inner = light.withColumn("before", F.coalesce(F.sum("w").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = inner.join(_starts(buckets), ["grp", "known", "bucket"]).withColumn("rank", F.col("start") + F.col("before"))
    fields = ["grp", "known", "id", "leaf", "claim", "rank"]
    if not some_hot:
        return placed.select(fields), sizes
    placed = materialize(placed.select(*fields, "w"), "merkle-ranks")
    return placed.where("leaf is not null").select(fields).unionByName(_ranked_by_leaf(leaves, placed.where("leaf is null")).select(fields)), sizes


def _ranked_by_leaf(leaves: DataFrame, hot: DataFrame) -> DataFrame:
    """The leaves of ids with many rows (grp, known, id, rank of the first): digits of the leaf take the place of the id's."""
    keys = ["grp", "known", "id"]
    mine = leaves.join(checked_broadcast(hot.select(keys)), keys, "left_semi")
    distinct = mine.groupBy(*keys, "leaf", "claim").agg(F.count(F.lit(1)).alias("w")).withColumn("digit", F.substring(F.hex("leaf"), 1, 4))
    distinct = materialize(distinct, "merkle-distinct")
    before = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    digits = distinct.groupBy(*keys, "digit").agg(F.sum("w").alias("n")).withColumn("start", before(Window.partitionBy(keys).orderBy("digit"), "n")).drop("n")
    inner = distinct.withColumn("inside", before(Window.partitionBy(*keys, "digit").orderBy("leaf", "claim"), "w")).join(digits, [*keys, "digit"])
    first = inner.join(checked_broadcast(hot.select(*keys, F.col("rank").alias("first"))), keys).withColumn("begin", F.col("first") + F.col("start") + F.col("inside"))
    # Runs of equal leaves are numbered in parts, so that no task makes all copies of one.
    parts = first.withColumn("part", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("w") - 1, F.lit(RUN).cast("long")))).withColumn("end", F.least(F.col("part") + RUN, F.col("begin") + F.col("w")))
    parts = parts.repartition(F.col("grp"), F.col("part"))
    return parts.withColumn("rank", F.explode(F.sequence("part", F.col("end") - 1)))


def _ordered(groups: DataFrame) -> DataFrame:
    """``groups`` with their rank by grp: the number in its range, and the rows of the ranges before."""
    placed = groups.repartitionByRange("grp").sortWithinPartitions("grp").withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()})
    placed = materialize(placed, "merkle-order")
    parts, total = [], 0
    for part, n, least in sorted(map(tuple, placed.groupBy("part").agg(F.count(F.lit(1)), F.min("seq")).collect())):
        parts.append((part, total - least))
        total += n
    shift = groups.sparkSession.createDataFrame(parts, "part int, shift long")  # a row for each partition
    return placed.join(F.broadcast(shift), "part").select("grp", "subroot", (F.col("seq") + F.col("shift")).alias("rank"))


def _steps(fanout: int) -> int:
    steps = 1
    while fanout ** (steps + 1) <= TIER:
        steps += 1
    return steps


def _depth(size: int, fanout: int) -> int:
    depth = 0
    while size > 1:
        size, depth = -(-size // fanout), depth + 1
    return depth


def _raised(hashes: list[str], size: int, fanout: int, steps: int) -> list[list[str]]:
    """The levels of one node of a tier, from its children up; ``size`` counts the children of all nodes of the group."""
    levels = [hashes]
    for _ in range(min(steps, _depth(size, fanout))):
        below = levels[-1]
        levels.append([hashlib.sha256("".join(below[i : i + fanout]).encode()).hexdigest() for i in range(0, len(below), fanout)])
    return levels


def _tiers(rows: DataFrame, fanout: int) -> list[DataFrame]:
    """Tables (grp, node, size, kids, root), lowest tier first, up to the one where each group has a single node."""
    steps, out = _steps(fanout), []
    width = fanout**steps

    def run(batches):
        for batch in batches:
            roots = []
            for size, kids in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                roots.append(_raised([h.hex() for h in kids.values.field(1).to_pylist()], size, fanout, steps)[-1][0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], ["grp", "node", "size", "kids", "root"])

    while True:
        nodes = rows.groupBy("grp", F.expr(f"rank div {width}").alias("node"), "size").agg(F.array_sort(F.collect_list("kid")).alias("kids"))
        kind = dict(nodes.dtypes)["kids"]
        tier = materialize(nodes.mapInArrow(run, f"grp string, node long, size long, kids {kind}, root string"), "merkle-tier")
        out.append(tier)
        if not tier.where(F.col("node") > 0).limit(1).count():
            return out
        kid = F.struct(F.col("node").alias("rank"), F.unhex("root").alias("hash"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("claim"))
        rows = tier.select("grp", F.expr(f"(size + {width - 1}) div {width}").alias("size"), F.col("node").alias("rank"), kid.alias("kid"))


def _paths(hashes: list[str], size: int, fanout: int, steps: int, above: list[dict]) -> Iterator[list[tuple[str, str]]]:
    """The path of each child of a node: within the node, then from it upwards."""
    levels = _raised(hashes, size, fanout, steps)[:-1]
    rest = [(step["left"], step["right"]) for step in above]
    for i in range(len(hashes)):
        path = []
        for level in levels:
            first = i - i % fanout
            path.append(("".join(level[first:i]), "".join(level[i + 1 : first + fanout])))
            i //= fanout
        yield path + rest


def _path_array(paths: list[list[tuple[str, str]]]) -> pa.Array:
    offsets = [0]
    for path in paths:
        offsets.append(offsets[-1] + len(path))
    left, right = (pa.array([step[i] for path in paths for step in path], pa.string()) for i in (0, 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([left, right], fields=list(STEP)))


def _joined(tier: DataFrame, above: DataFrame) -> DataFrame:
    return tier.join(above, ["grp", "node"]).select("grp", "size", "kids", "path", "subroot")


def _children(tier: DataFrame, above: DataFrame, fanout: int) -> DataFrame:
    """grp, node, path, subroot of the children of a tier's nodes, which are the nodes of the tier below."""
    steps = _steps(fanout)

    def run(batches):
        for batch in batches:
            for grp, size, kids, path, subroot in zip(*batch.columns, strict=True):
                ranks, hashes = kids.values.field(0), [h.hex() for h in kids.values.field(1).to_pylist()]
                paths = _path_array(list(_paths(hashes, size.as_py(), fanout, steps, path.as_py())))
                n = len(hashes)
                yield pa.RecordBatch.from_arrays([pa.array([grp.as_py()] * n, pa.string()), ranks.cast(pa.int64()), paths, pa.array([subroot.as_py()] * n, pa.string())], ["grp", "node", "path", "subroot"])

    return _joined(tier, above).mapInArrow(run, f"grp string, node long, path {PATH}, subroot string")


#: Documents whose paths a task holds at a time.
PART = 512


def _leaves(tier: DataFrame, above: DataFrame, fanout: int) -> DataFrame:
    tier_steps = _steps(fanout)

    def run(batches):
        for batch in batches:
            for _, size, kids, path, subroot in zip(*batch.columns, strict=True):
                _, digests, ids, claims = (kids.values.field(i) for i in range(4))
                hashes = [h.hex() for h in digests.to_pylist()]
                claimed = [None if c is None else c.hex() for c in claims.to_pylist()]
                paths, sub = _paths(hashes, size.as_py(), fanout, tier_steps, path.as_py()), subroot.as_py()
                for at in range(0, len(hashes), PART):
                    n = min(PART, len(hashes) - at)
                    steps = _path_array([next(paths) for _ in range(n)])
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(at, n).cast(pa.int64()), pa.array(hashes[at : at + n], pa.string()), pa.array(claimed[at : at + n], pa.string()), steps, pa.array([sub] * n, pa.string())], ["doc_id", "leaf", "claim", "path", "subroot"]
                    )

    return _joined(tier, above).mapInArrow(run, f"doc_id long, leaf string, claim string, path {PATH}, subroot string")


def document_leaf(docs: DataFrame, added: int = 0) -> Column:
    """The leaf of a row of documents, with ``added`` added to n_chars (a null stays)."""
    n_chars = (F.col("n_chars").cast("decimal(20,0)") + added).cast("string") if added else F.col("n_chars")
    return digest([F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), n_chars, F.col("text")])


def checked_proofs(docs: DataFrame, tampered_modulus: int = 7, fanout: int = 2) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of documents (see ``build``).

    Rows with crc32(doc_id) divisible by ``tampered_modulus`` claim a leaf with one added to n_chars; what its path leads to
    then differs from the root. Rows with a null doc_id or a null n_chars claim their own leaf.
    """
    tampered = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % tampered_modulus == 0
    claim = F.when(tampered & F.col("n_chars").isNotNull(), document_leaf(docs, 1))
    rows = build(docs, document_leaf(docs), claim, fanout=fanout).proofs()
    rows = rows.withColumn("folded_root", folded(F.coalesce("claim", "leaf"), "path"))
    return rows.select("doc_id", "leaf", "subroot", "root", siblings_digest("path").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
