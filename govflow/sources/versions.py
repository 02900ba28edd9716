"""Versions of a store: numbered manifests that appear at once, or not at all.

A store is a folder with data folders of unique names and a folder of manifests. Data is written first; then a manifest
that names it is renamed to the next number, which fails if that number is taken. Readers follow the manifest of the
largest number, so they see whole versions only, and of two writers that started from one version the later fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

MANIFESTS = "_versions"


class Conflict(RuntimeError):
    """Another writer has committed meanwhile; what was written is not part of the store."""


class Folder:
    """A store's folder, through Hadoop's file system interface."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._hadoop = spark, path.rstrip("/"), spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, name: str = ""):
        where = self._hadoop.Path(f"{self.path}/{name}" if name else self.path)
        return where, where.getFileSystem(self._conf)

    def names(self, folder: str = "") -> list[str]:
        where, fs = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def remove(self, name: str) -> None:
        where, fs = self._at(name)
        fs.delete(where, True)

    def latest(self) -> tuple[int, dict | None]:
        """Number and content of the newest manifest; 0 and None for a folder without any."""
        numbers = [int(n) for n in self.names(MANIFESTS) if n.isdigit()]
        return (max(numbers), self.manifest(max(numbers))) if numbers else (0, None)

    def manifest(self, number: int) -> dict:
        where, fs = self._at(f"{MANIFESTS}/{number:012d}")
        stream = fs.open(where)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def commit(self, number: int, manifest: dict) -> None:
        """Make ``manifest`` the version ``number``, all or nothing; Conflict if that version is there."""
        draft, fs = self._at(f"{MANIFESTS}/_draft-{uuid.uuid4().hex}")
        target, _ = self._at(f"{MANIFESTS}/{number:012d}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        stream.close()
        rename = getattr(self._hadoop, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context = self._hadoop.FileContext.getFileContext(fs.getUri(), self._conf)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(target), options)
        except Exception as error:
            fs.delete(draft, False)
            if fs.exists(target):
                raise Conflict(f"version {number} of {self.path} was written by another writer") from error
            raise

    def replace(self, write: Callable[[str], None]) -> int:
        """Write a whole new version with ``write`` (which gets the path of a new data folder), and its number."""
        number, _ = self.latest()
        name = f"data-{uuid.uuid4().hex}"
        write(f"{self.path}/{name}")
        self.commit(number + 1, {"data": name})
        return number + 1

    def data(self) -> str | None:
        """The path of the newest whole version."""
        _, manifest = self.latest()
        return f"{self.path}/{manifest['data']}" if manifest else None

    def tidy(self, keep: int = 1) -> list[str]:
        """Remove manifests but the newest ``keep``, and data that none of these names; the names of what went.

        Writers that are under way lose their data, so this has to run alone.
        """
        numbers = [int(n) for n in self.names(MANIFESTS) if n.isdigit()]
        held, used = numbers[-keep:], set()
        for number in held:
            manifest = self.manifest(number)
            used |= {manifest["data"]} if "data" in manifest else {p.split("/")[0] for p in manifest["buckets"].values()}
        gone = [n for n in self.names() if n.startswith("data-") and n not in used]
        gone += [f"{MANIFESTS}/{n}" for n in self.names(MANIFESTS) if not (n.isdigit() and int(n) in held)]
        for name in gone:
            self.remove(name)
        return gone
