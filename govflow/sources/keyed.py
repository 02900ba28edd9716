"""A table with a key whose changes rewrite only the buckets they touch.

Rows are dealt to buckets by a hash of the key, each a folder. A change reads the buckets of its keys, writes new folders
for those whose rows really change, and commits a manifest that names the new folders and, for all other buckets, the old
ones. Nothing changes until the manifest is there, and the same change again finds nothing to do.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from govflow.operators.durable import durable

from .versions import Conflict, Folder

BUCKETS = 64


def _fresh(kind: str) -> str:
    return f"{kind}_{uuid.uuid4().hex}"


@dataclass
class Change:
    """What a change did: the version it made (the old one if nothing changed), and the buckets that were rewritten."""

    version: int
    rewritten: list[int]


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    @staticmethod
    def create(rows: DataFrame, path: str, key: str, version: str | None = None, buckets: int = BUCKETS) -> KeyedStore:
        """A new store of ``rows``: for each key the row of the largest ``version`` (any of them without a version column)."""
        store = KeyedStore(rows.sparkSession, path)
        number, manifest = store.folder.latest()
        if manifest:
            raise Conflict(f"{path} holds a store already")
        manifest = {"schema": rows.schema.jsonValue(), "key": key, "version": version, "count": buckets, "buckets": {}}
        store._write(newest(rows, key, version), manifest, number, range(buckets))
        return store

    def _bucket(self, manifest: dict) -> Column:
        return F.pmod(F.xxhash64(F.col(manifest["key"])), F.lit(manifest["count"])).cast("int")

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        named = {int(b): p for b, p in manifest["buckets"].items()}
        paths = [f"{self.folder.path}/{named[b]}" for b in sorted(named) if buckets is None or b in buckets]
        schema = StructType.fromJson(manifest["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, manifest: dict, number: int, buckets) -> int:
        """Write ``rows``, all of the given buckets, and commit them as the next version."""
        at, name = _fresh("bucket"), f"data-{uuid.uuid4().hex}"
        dealt = rows.withColumn(at, self._bucket(manifest))
        dealt.repartition(at).write.partitionBy(at).parquet(f"{self.folder.path}/{name}")
        there = {int(n.split("=")[1]): f"{name}/{n}" for n in self.folder.names(name) if n.startswith(f"{at}=")}
        kept = {b: p for b, p in manifest["buckets"].items() if int(b) not in set(buckets)}
        self.folder.commit(number + 1, manifest | {"buckets": kept | {str(b): p for b, p in there.items()}})
        return number + 1

    def read(self) -> DataFrame:
        """The newest version."""
        return self._rows(self.folder.latest()[1])

    def get(self, keys: DataFrame) -> DataFrame:
        """Rows of the given keys (a column of the key's name), read from their buckets only."""
        _, manifest = self.folder.latest()
        wanted = durable(keys.select(manifest["key"]).distinct(), "asked-keys")
        touched = sorted(r[0] for r in wanted.select(self._bucket(manifest)).distinct().collect())
        return self._rows(manifest, touched).join(wanted, manifest["key"], "left_semi")

    def upsert(self, changes: DataFrame) -> Change:
        """Put rows with the store's columns: a row replaces that of its key unless its version is smaller (or null where
        that one's isn't). Rows that are there already change nothing."""
        number, manifest = self.folder.latest()
        key, version, names = manifest["key"], manifest["version"], [f["name"] for f in manifest["schema"]["fields"]]
        # Read again for each step, so written once.
        new = durable(newest(changes.select(names), key, version), "changes")
        touched = sorted(r[0] for r in new.select(self._bucket(manifest)).distinct().collect())
        old = self._rows(manifest, touched)
        old_row, new_row = _fresh("old"), _fresh("new")
        pairs = new.select(F.struct(*names).alias(new_row)).join(old.select(F.struct(*names).alias(old_row)), F.col(f"{new_row}.{key}").eqNullSafe(F.col(f"{old_row}.{key}")), "left")
        beats = F.lit(True)
        if version:
            mine, theirs = F.col(f"{new_row}.{version}"), F.col(f"{old_row}.{version}")
            beats = F.col(old_row).isNull() | F.when(mine.isNull(), theirs.isNull()).otherwise(theirs.isNull() | (mine >= theirs))
        effective = pairs.where(beats & ~F.col(new_row).eqNullSafe(F.col(old_row))).select(f"{new_row}.*")
        effective = durable(effective, "effective")
        return self._changed(number, manifest, effective.select(key), lambda rows: rows.unionByName(effective))

    def delete(self, ids: DataFrame) -> Change:
        """Remove the rows of the given keys; a null key is never removed, and keys that aren't there change nothing."""
        number, manifest = self.folder.latest()
        gone = durable(self.get(ids.where(F.col(manifest["key"]).isNotNull())).select(manifest["key"]), "deleted-keys")
        return self._changed(number, manifest, gone, lambda rows: rows)

    def _changed(self, number: int, manifest: dict, keys: DataFrame, more) -> Change:
        """Rewrite the buckets of ``keys`` without their rows, and with what ``more`` adds."""
        rewritten = sorted(r[0] for r in keys.select(self._bucket(manifest)).distinct().collect())
        if not rewritten:
            return Change(number, [])
        old, other = self._rows(manifest, rewritten), _fresh("key")
        kept = old.join(keys.select(F.col(manifest["key"]).alias(other)), F.col(manifest["key"]).eqNullSafe(F.col(other)), "left_anti")
        return Change(self._write(more(kept), manifest, number, rewritten), rewritten)


def newest(rows: DataFrame, key: str, version: str | None) -> DataFrame:
    """One row for each key, null being one: that of the largest version. Of equal versions the largest row in the order of
    all columns, as text, stays, so the choice doesn't depend on how rows are dealt out."""
    place = _fresh("place")
    order = ([F.desc_nulls_last(version)] if version else []) + [F.desc_nulls_last(F.to_json(F.struct(*rows.columns)))]
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(place) == 1).drop(place)
