"""Tables that are written on the way to a result, below the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a local one only where one machine is all there is."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="martlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def temporary(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, which is deleted when the driver's Python ends, or by :func:`clear`."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def fixed(df: DataFrame) -> DataFrame:
    """``df`` written and read back: what's read twice is then the same both times, also after an executor was lost."""
    path = temporary(df.sparkSession, "fixed")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def clear() -> None:
    """Delete what :func:`temporary` has named; results that read it are void then."""
    while _written:
        spark, path = _written.pop()
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended before
            return
