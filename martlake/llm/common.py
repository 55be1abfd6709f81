"""Session helpers shared by the text operators."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch may hold on its way to a Python worker.
ARROW_ROWS, ARROW_BYTES = 2000, 8 << 20

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only on one machine (tests, a laptop), where the session names none, a local temporary folder is taken, and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="martlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it's deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, as the path may be in a store that only Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives a lost executor."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        path = df.staged_at
        drop_path(df.sparkSession, path)
        _staged[:] = [x for x in _staged if x[1] != path]


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``make()`` written as by :func:`staged`; what was written on the way to it is deleted."""
    before = len(_staged)
    out = staged(make(), name)
    for spark, path in _staged[before:]:
        if path != out.staged_at:
            drop_path(spark, path)
    _staged[before:] = [x for x in _staged[before:] if x[1] == out.staged_at]
    return out


@atexit.register
def _drop_staged() -> None:
    for spark, path in _staged:
        try:
            drop_path(spark, path)
        except Exception:  # the session may have ended before
            return


def bounded_batches(spark: SparkSession) -> None:
    """Bound what a Python worker is handed at once, in rows and bytes, and let workers on this machine import the
    package from where the driver has it (on other machines it's installed or shipped)."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, env.get("PYTHONPATH")]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def tidy(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A partition function that hands freed memory back to the system at its end: idle workers stay small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` of a function from one batch to one batch."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return df.mapInArrow(tidy(run), schema)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Batches sorted by ``key``, joined and cut so that no group is split; of about ``rows`` rows, more for one group."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        whole = pa.concat_batches(held)
        keys = whole.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
        if cut:
            yield whole.slice(0, cut)
        held, size = [whole.slice(cut)], whole.num_rows - cut
    if size:
        yield pa.concat_batches(held)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them (in whatever case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def task_for_each_file(spark: SparkSession) -> Iterator[None]:
    """While this holds, a small staged table is read by about as many tasks as wrote it, instead of by few that take many
    files: for tables whose rows are few bytes but much work."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(shuffle_partitions(spark)))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def documents_of(docs: DataFrame, *more: str) -> DataFrame:
    """Only the id, the text and named further columns, so that clashing extra columns can't interfere."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The batch's texts, null as empty."""
    return pc.fill_null(batch.column(column), "")


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with row numbers from 1 in the given order: ranges of the order are numbered side by side.

    Each row's place within its range is written; the ranges before are added from a table of a row for each range.
    Rows that the order doesn't tell apart are told apart by where they were read, so they spread over ranges too.
    """
    tie, place = fresh(df, "__tie", "__place")
    total = [*order, F.col(tie)]
    ranged = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(df.sparkSession), *total).sortWithinPartitions(*total)
    written = staged(ranged.withColumn(place, F.monotonically_increasing_id()).drop(tie), "numbered")
    span, row = F.shiftright(place, 33), F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = written.groupBy(span.alias("__span")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__span", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return written.join(F.broadcast(starts), span == F.col("__span")).withColumn(name, F.col("__start") + row + 1).drop("__span", "__start", place)
