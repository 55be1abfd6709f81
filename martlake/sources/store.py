"""A versioned table store on Parquet: snapshots, time travel, restore, history and maintenance.

A table is a folder: ``data/<id>/part-*.parquet`` and ``_versions/<n>.json``. A version lists the data folders, or single
files of them, that it's made of, the schema, column comments, the clustering columns and how it came about. A commit writes new data folders, then
creates the next version file, which fails if another writer was first (the data folder then stays unused). Readers
take the highest version; nothing is changed in place, so a version can be read while the next is written, and a table
may be rewritten from itself. Upserts, deletes, updates and replaced ranges look for the files that hold affected rows
(the clustering column's ranges let the scan skip most) and rewrite those alone. Files are reached through Hadoop's file system, so the root may be in any store that Spark
reads; the store must create files exclusively.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlake.operators import upsert as _upsert
from martlake.operators.differences import differing_rows


class ConflictError(RuntimeError):
    """Another writer committed the version first."""


class Store:
    """Tables by layer below a root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, layer: str, name: str) -> Table:
        return Table(self.spark, f"{self.root}/{layer}/{name}")

    def tables(self, layer: str) -> list[str]:
        return sorted(n for n in _list(self.spark, f"{self.root}/{layer}") if self.table(layer, n).exists())

    def create_layers(self, *layers: str) -> None:
        for x in layers:
            _fs(self.spark, f"{self.root}/{x}").mkdirs(_path(self.spark, f"{self.root}/{x}"))


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _list(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path), _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


#: Columns that a table's files are ordered by: one, or several in z-order.
Layout = str | Sequence[str] | None


def _names(layout: Layout) -> list[str]:
    return [] if not layout else [layout] if isinstance(layout, str) else list(layout)


def _number(df: DataFrame, name: str) -> Column:
    """A number that keeps a column's order: of text, its first seven bytes."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_seconds(c.cast("timestamp")).cast("double")
    return F.conv(F.rpad(F.substring(F.hex(F.encode(c.cast("string"), "utf-8")), 1, 14), 14, "0"), 16, 10).cast("double")


def _reached(value: Column, bounds: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= value))


def z_address(df: DataFrame, names: Sequence[str], bits: int = 8) -> Column:
    """A row's place on the z-curve over the columns: the bits of its places among each column's quantiles, interleaved.
    Quantiles make places even whatever the values; null comes first. The bounds are one row of 2**bits numbers a column."""
    if len(names) * bits > 62:
        raise ValueError(f"{len(names)} columns of {bits} bits don't fit into a place on the curve")
    shares = F.array(*(F.lit(k / (1 << bits)) for k in range(1, 1 << bits)))
    found = df.agg(*(F.percentile_approx(_number(df, c), shares, 10_000).alias(f"q{k}") for k, c in enumerate(names))).first()
    address = F.lit(0).cast("long")
    for k, (c, bounds) in enumerate(zip(names, found, strict=True)):
        if not bounds:  # nothing but nulls
            continue
        value = _number(df, c)
        place = F.when(value.isNull(), 0).otherwise(_reached(value, sorted(set(bounds))))
        for bit in range(bits):
            address = address + F.shiftleft(F.shiftright(place, bit).bitwiseAND(F.lit(1)).cast("long"), bit * len(names) + k)
    return address


class Table:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    # versions

    def _versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in _list(self.spark, f"{self.path}/_versions") if n.endswith(".json") and n[:-5].isdigit())

    def exists(self) -> bool:
        return bool(self._versions())

    def version(self) -> int:
        found = self._versions()
        if not found:
            raise LookupError(f"there is no table at {self.path}")
        return found[-1]

    def _entry(self, version: int | None = None) -> dict:
        n = self.version() if version is None else version
        if version is not None and n not in self._versions():
            raise LookupError(f"{self.path} has no version {n}")
        at = f"{self.path}/_versions/{n:08d}.json"
        stream = _fs(self.spark, at).open(_path(self.spark, at))
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _commit(self, entry: dict, operation: str, base: int, **details) -> int:
        n = base + 1
        entry = entry | {"version": n, "operation": operation, "timestamp": time.time(), "details": details}
        at = f"{self.path}/_versions/{n:08d}.json"
        try:
            stream = _fs(self.spark, at).create(_path(self.spark, at), False)
        except Exception as e:
            if _fs(self.spark, at).exists(_path(self.spark, at)):
                raise ConflictError(f"version {n} of {self.path} was committed by another writer") from e
            raise
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        return n

    def _write(self, df: DataFrame, cluster_by: Layout = None, files: int | None = None) -> str:
        folder, names = f"data/{uuid.uuid4().hex}", _names(cluster_by)
        if names:
            own, order = df.columns, names[0]
            if len(names) > 1:
                order = max([*own, "z"], key=len) + "_"
                df = df.withColumn(order, z_address(df, names))
            df = (df.repartitionByRange(files, order) if files else df.repartitionByRange(order)).sortWithinPartitions(order).select(*(F.col(f"`{c}`") for c in own))
        elif files:
            df = df.coalesce(files)
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    # reading

    def schema(self, version: int | None = None) -> T.StructType:
        return T.StructType.fromJson(self._entry(version)["schema"])

    def read(self, version: int | None = None) -> DataFrame:
        e = self._entry(version)
        return self._frame(e["folders"], T.StructType.fromJson(e["schema"]))

    def _frame(self, paths: list[str], schema: T.StructType) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in paths))

    def _files(self, entry: dict) -> list[str]:
        """The version's files below the table's folder."""
        out = []
        for f in entry["folders"]:
            at = f"{self.path}/{f}"
            names = [s.getPath().getName() for s in _fs(self.spark, at).listStatus(_path(self.spark, at))]
            out += [f] if f.endswith(".parquet") else [f"{f}/{n}" for n in names if n.endswith(".parquet")]
        return out

    def history(self) -> DataFrame:
        """One row for each version, the newest first."""
        rows = []
        for n in reversed(self._versions()):
            e = self._entry(n)
            rows.append((n, datetime.fromtimestamp(e["timestamp"], timezone.utc).replace(tzinfo=None), e["operation"], json.dumps(e["details"], sort_keys=True)))
        return self.spark.createDataFrame(rows, "version long, timestamp timestamp, operation string, details string")

    def detail(self) -> DataFrame:
        """Files, bytes and layout of the newest version."""
        e, files, size = self._entry(), 0, 0
        for f in e["folders"]:
            at = f"{self.path}/{f}"
            for s in _fs(self.spark, at).listStatus(_path(self.spark, at)):
                if s.getPath().getName().endswith(".parquet"):
                    files, size = files + 1, size + s.getLen()
        return self.spark.createDataFrame([(self.path, e["version"], files, size, _names(e.get("cluster")))], "location string, version long, num_files long, size_bytes long, clustering_columns array<string>")

    # writing

    def create(self, schema: T.StructType) -> int:
        """An empty table if there is none."""
        return self.version() if self.exists() else self._commit({"folders": [], "schema": json.loads(schema.json()), "cluster": None}, "CREATE", -1)

    def _base(self) -> tuple[dict, int]:
        return (e := self._entry(), e["version"]) if self.exists() else ({"folders": [], "schema": None, "cluster": None}, -1)

    def overwrite(self, df: DataFrame, operation: str = "OVERWRITE", cluster_by: Layout = None, comments: Mapping[str, str] | None = None, **details) -> int:
        """The rows of ``df`` as the new content, with its schema. ``df`` may read this table."""
        e, base = self._base()
        cluster = _names(cluster_by) or [c for c in _names(e["cluster"]) if c in df.columns]
        kept = {f["name"]: f["metadata"] for f in (e["schema"] or {"fields": []})["fields"]}
        fields = [T.StructField(f.name, f.dataType, True, {**kept.get(f.name, {}), **f.metadata, **({"comment": comments[f.name]} if comments and f.name in comments else {})}) for f in df.schema]
        return self._commit({"folders": [self._write(df, cluster)], "schema": json.loads(T.StructType(fields).json()), "cluster": cluster}, operation, base, **details)

    def append(self, df: DataFrame, merge_schema: bool = False, batch_id: int | None = None) -> int:
        """Add rows. New columns need ``merge_schema``; older rows have null there. A batch id that was appended before is
        passed over, which makes a retried micro-batch harmless."""
        e, base = self._base()
        if batch_id is not None and batch_id in e.get("batches", []):
            return base
        old = T.StructType.fromJson(e["schema"]) if e["schema"] else T.StructType([])
        known = {f.name: f.dataType for f in old}
        more = [T.StructField(f.name, f.dataType, True, f.metadata) for f in df.schema if f.name not in known]
        if more and known and not merge_schema:
            raise ValueError(f"new columns {[f.name for f in more]}; pass merge_schema=True to add them")
        if wrong := [f.name for f in df.schema if f.name in known and f.dataType != known[f.name]]:
            raise ValueError(f"columns {wrong} have other types in the table")
        schema = T.StructType([*old, *more])
        whole = df.select(*(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
        batches = [*e.get("batches", []), *([batch_id] if batch_id is not None else [])]
        return self._commit({**e, "folders": [*e["folders"], self._write(whole)], "schema": json.loads(schema.json()), "batches": batches}, "APPEND", base)

    def _rewrite(self, affected: Callable[[DataFrame], DataFrame], change: Callable[[DataFrame], DataFrame], operation: str, inserts: bool = False, **details) -> int:
        """A version in which only files with affected rows are replaced, by their changed rows; the others are kept. The
        names of affected files pass through the driver."""
        e, base = self._base()
        schema = T.StructType.fromJson(e["schema"])
        found: set[str] = set()
        if e["folders"]:
            rows = self._frame(e["folders"], schema).withColumn("__file", F.col("_metadata.file_path"))
            found = {"/".join(r[0].split("/")[-3:]) for r in affected(rows).select("__file").distinct().collect()}
        files = self._files(e)
        touched = [f for f in files if f in found]
        kept = [f for f in files if f not in found]
        parts = kept
        if touched or inserts:
            new = change(self._frame(touched, schema))
            parts = [*kept, self._write(new.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in schema)), e["cluster"])]
        return self._commit({**e, "folders": parts}, operation, base, files_kept=len(kept), files_rewritten=len(touched), **details)

    def replace_where(self, df: DataFrame, condition: str) -> int:
        """Replace the rows that meet a condition by those of ``df``, all of which must meet it."""
        own = df.select(self.schema().names)
        return self._rewrite(lambda rows: rows.where(condition), lambda old: _upsert.replace_where(old, own, condition), "REPLACE WHERE", True, condition=condition)

    def upsert(self, source: DataFrame, key: str | list[str], order_by: str) -> int:
        return self._rewrite(lambda rows: _with_keys(rows, source, key), lambda old: _upsert.upsert(old, source, key, order_by), "UPSERT", True)

    def delete(self, condition: str) -> int:
        return self._rewrite(lambda rows: rows.where(condition), lambda old: old.where(~F.coalesce(F.expr(condition), F.lit(False))), "DELETE", condition=condition)

    def delete_keys(self, rejected: DataFrame, key: str | list[str]) -> int:
        return self._rewrite(lambda rows: _with_keys(rows, rejected, key), lambda old: _upsert.retract(old, rejected, key), "DELETE")

    def update(self, condition: str, values: dict[str, str]) -> int:
        return self._rewrite(lambda rows: rows.where(condition), lambda old: _upsert.update_where(old, condition, values), "UPDATE", condition=condition)

    def insert(self, rows: list[tuple]) -> int:
        return self.append(self.spark.createDataFrame(rows, self.schema()))

    def restore(self, version: int) -> int:
        """A new version with the content of an old one, and its batches: what was appended since may be appended again."""
        old = self._entry(version)
        return self._commit({k: old[k] for k in ("folders", "schema", "cluster", "batches") if k in old}, "RESTORE", self.version(), to=version)

    def optimize(self, cluster_by: Layout = None, files: int | None = None, target_bytes: int = 128 << 20) -> int:
        """Rewrite into few files, ordered by a column (or along a z-curve over several), so that the ranges in the files'
        footers let readers skip them."""
        e, base = self._base()
        cluster = _names(cluster_by) or _names(e["cluster"])
        n = files or max(1, -(-self.detail().first().size_bytes // target_bytes))
        return self._commit({**e, "folders": [self._write(self.read(), cluster, n)], "cluster": cluster}, "OPTIMIZE", base, files=n)

    def comment(self, comments: Mapping[str, str]) -> int:
        e, base = self._base()
        for f in e["schema"]["fields"]:
            if f["name"] in comments:
                f["metadata"] = {**f["metadata"], "comment": comments[f["name"]]}
        return self._commit(e, "COMMENT", base)

    def drop(self) -> None:
        _fs(self.spark, self.path).delete(_path(self.spark, self.path), True)


def _with_keys(rows: DataFrame, source: DataFrame, key: str | list[str]) -> DataFrame:
    """The rows whose key the source has; null is a key like any other."""
    keys = [key] if isinstance(key, str) else list(key)
    wanted = source.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(wanted[f"__{k}"])
    return rows.join(wanted, same, "left_semi")


def version_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value differs between two versions; keys of one side alone have no difference and are left out. Only
    ranges of keys that digests show to differ are joined."""
    before, after, _ = differing_rows(old, new, key, [value])
    joined = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key, "full_outer")
    return joined.withColumn("difference", F.col("after") - F.col("before")).where("difference <> 0").orderBy(key)
