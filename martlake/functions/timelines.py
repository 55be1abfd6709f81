"""Time lines of keys, cut where one key has too many rows for a task.

A key with more than its share of the rows is *hot*. Its time line is cut at quantiles of its own times into slices, which
are worked on side by side; what a slice needs of the ones before or after it is carried in from a table of a row for
each slice. Keys that aren't hot are one slice, and nothing is carried.

The hot keys and their cuts are found by one aggregation (counts by key, reduced before the shuffle) and, only where
there are hot keys, a second one (a sketch of the times of each). There are at most ``parts`` hot keys and ``2 * parts``
slices of them, which is what passes through the driver and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is hot with more rows than this and more than a partition's share; slices of a key at most.
HOT_ROWS, MOST_SLICES = 100_000, 1024
#: Quantiles of a sketch, from which a key's cuts are taken.
_SHARES = 1024


def hot_cuts(df: DataFrame, key: str, time: str) -> DataFrame | None:
    """__cut_key, __cuts: the hot keys and the times (microseconds, in order) that their time lines are cut at; None if
    no key is hot. Rows without key or time don't count. What the optimiser takes for smaller than ``HOT_ROWS`` rows of 32
    bytes isn't counted."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 32 * HOT_ROWS:
        return None
    spark, parts = df.sparkSession, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    timed = df.select(F.col(key).alias("k"), F.unix_micros(F.col(time).cast("timestamp")).alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    counts = timed.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    share = F.greatest(F.lit(HOT_ROWS), F.ceil(F.col("total") / parts))
    hot = counts.crossJoin(F.broadcast(total)).where(F.col("n") > share).select("k", F.least(F.lit(MOST_SLICES), F.ceil(F.col("n") / share)).cast("int").alias("slices")).collect()
    if not hot:
        return None
    wanted = spark.createDataFrame([tuple(r) for r in hot], T.StructType([T.StructField("k", df.schema[key].dataType), T.StructField("slices", T.IntegerType())]))
    shares = F.array(*(F.lit(j / _SHARES) for j in range(1, _SHARES)))
    found = timed.join(F.broadcast(wanted), "k").groupBy("k").agg(F.first("slices").alias("slices"), F.percentile_approx("t", shares, 10_000).alias("q"))
    cuts = F.transform(F.sequence(F.lit(1), F.col("slices") - 1), lambda j: F.element_at("q", F.greatest(F.lit(1), F.floor(j * F.lit(_SHARES) / F.col("slices")).cast("int"))))
    rows = found.select("k", cuts.alias("cuts")).collect()  # at most 2 * parts cuts
    kind = T.StructType([T.StructField("__cut_key", df.schema[key].dataType), T.StructField("__cuts", T.ArrayType(T.LongType()))])
    return spark.createDataFrame([tuple(r) for r in rows], kind)


def with_slices(df: DataFrame, cuts: DataFrame, key: str, time: str, spread: bool = False) -> DataFrame:
    """``df`` with ``__slice``: the cuts before the row's time (0 for keys that aren't hot).

    Where several cuts are at one time, as many rows have it, ``spread`` deals rows of that time over the slices between.
    That suits rows that only look back; what they look for is in the first of these slices or before.
    """
    joined = df.join(F.broadcast(cuts), F.col(key) == F.col("__cut_key"), "left")
    t = F.unix_micros(F.col(time).cast("timestamp"))
    below = F.size(F.filter("__cuts", lambda c: c < t))
    place = below
    if spread:
        place = below + F.pmod(F.monotonically_increasing_id(), F.size(F.filter("__cuts", lambda c: c <= t)) - below + 1).cast("int")
    return joined.withColumn("__slice", F.when(F.col("__cuts").isNotNull() & t.isNotNull(), place).otherwise(F.lit(0))).drop("__cut_key", "__cuts")


def carried(ends: DataFrame, cuts: DataFrame, key: str, value: str, backwards: bool = False) -> DataFrame:
    """key, __slice and ``value`` for every slice of the hot keys: that of the nearest slice before it (or after it) of
    which ``ends`` has one; null where none has."""
    slices = cuts.select(F.col("__cut_key").alias(key), F.explode(F.sequence(F.lit(0), F.size("__cuts"))).alias("__slice"))
    known = slices.join(ends.select(key, "__slice", value), [key, "__slice"], "left")
    order = Window.partitionBy(key).orderBy(F.desc("__slice") if backwards else F.asc("__slice")).rowsBetween(Window.unboundedPreceding, -1)
    return known.select(key, "__slice", F.last(value, ignorenulls=True).over(order).alias(value))


def of_hot(df: DataFrame, cuts: DataFrame, key: str) -> DataFrame:
    """The rows of hot keys."""
    return df.join(F.broadcast(cuts.select(F.col("__cut_key").alias(key))), key, "left_semi")


def when_present(value: Column) -> Column:
    """A struct that holds a value, so that a null value can be carried like any other."""
    return F.struct(value.alias("is"))
