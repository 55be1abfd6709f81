"""A versioned log of the columns that an entity's raw files have brought.

A version is a file of its own, named by its number and created exclusively, so two writers can't make the same one: the
later reads what the earlier added and tries again. A column is never dropped, so every version's columns are a prefix of
the next one's; rows that were written under an older version read as null in newer columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Column:
    """A column that came with files: its name, the type it first had, and the run that brought it."""

    name: str
    kind: str
    run_id: str


class SchemaLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str = ""):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        fs, at = self._at()
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def columns(self, version: int | None = None) -> list[Column]:
        """The columns of a version (the newest), in the order in which they came; none before the first version."""
        found = self.versions()
        if version is None and not found:
            return []
        if version is not None and version not in found:
            raise LookupError(f"{self.path} has no version {version}")
        fs, at = self._at(f"{found[-1] if version is None else version:08d}.json")
        stream = fs.open(at)
        try:
            text = bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
        return [Column(**c) for c in json.loads(text)]

    def evolve(self, new: Iterable[Column]) -> list[Column]:
        """The columns after adding those that aren't known by name; a new version only if there are any."""
        wanted = list(new)
        while True:
            found, known = self.versions(), self.columns()
            names = {c.name for c in known}
            more = [c for k, c in enumerate(wanted) if c.name not in names and c.name not in {w.name for w in wanted[:k]}]
            if not more:
                return known
            fs, at = self._at(f"{found[-1] + 1 if found else 0:08d}.json")
            try:
                stream = fs.create(at, False)
            except Exception:
                if fs.exists(at):  # another writer made this version: add to what it added
                    continue
                raise
            stream.write(bytearray(json.dumps([vars(c) for c in [*known, *more]]).encode()))
            stream.close()
            return [*known, *more]
