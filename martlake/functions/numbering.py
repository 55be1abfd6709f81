"""Global row numbers, ntile and percent_rank without a task that sees all rows.

Spark runs a window without partitions in one task. For row numbers, rows are dealt out by ranges of the order, numbered
inside their range, and shifted by the rows of the ranges before, of which there's a small table. Where a few ranks or
tiles are all that's wanted, :mod:`martlake.functions.order_statistics` finds them without a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlake.functions.order_statistics import By, prefix_sums
from martlake.functions.staging import fixed

#: Pieces that the rows of scores are dealt into for each partition when they meet their ranks.
PIECES = 16


def with_row_number(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with a row number from 1 in the given order, which should be total."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    # which rows share a range must not change between the two reads below
    ranged = fixed(ranged.withColumns({"__range": F.shiftright("__id", 33), "__row": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__id"))
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sizes.select("__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    return ranged.join(F.broadcast(starts), "__range").withColumn(name, F.col("__start") + F.col("__row") + 1).drop("__range", "__row", "__start")


def _with_total(df: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("__total"))))  # one row


def ntile(df: DataFrame, tiles: int, name: str, *order: Column) -> DataFrame:
    """``df`` with SQL's ntile over all rows: the first tiles have one row more if the rows don't divide evenly."""
    whole = _with_total(with_row_number(df, "__n", *order))
    k, size, larger = F.col("__n") - 1, F.floor(F.col("__total") / tiles), F.col("__total") % tiles
    rest = F.floor((k - larger * (size + 1)) / F.nullif(size, F.lit(0)))
    tile = F.when(k < larger * (size + 1), F.floor(k / (size + 1))).otherwise(larger + rest) + 1
    return whole.withColumn(name, tile.cast("int")).drop("__n", "__total")


def hot_values(counts: DataFrame, parts: int) -> DataFrame:
    """value, pieces: of values with their rows ``n``, those with more than a piece's share, at most ``PIECES * parts``."""
    share = counts.agg(F.greatest(F.lit(1), F.sum("n") / (PIECES * parts)).alias("share"))  # one row
    return counts.crossJoin(F.broadcast(share)).where("n > share").select("value", F.ceil(F.col("n") / F.col("share")).cast("int").alias("pieces"))


def percent_rank(df: DataFrame, name: str, value: str, descending: bool = False) -> DataFrame:
    """``df`` with SQL's percent_rank of a column over all rows: ties share the rank of their first.

    Rows are stored once, as they're read twice, but not sorted: they're counted by value, ranks are prefix sums over the distinct values, and rows meet the rank
    of their value by a join. The rows of a value with many ties are dealt into pieces, each with a copy of the rank, so
    no task gets all of them.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = fixed(df)
    counts = fixed(df.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n").alias("__total"))  # one row
    ranks = prefix_sums(counts, By("value", descending), ["n"]).crossJoin(F.broadcast(total))
    rank = F.when(F.col("__total") > 1, F.col("before_n") / (F.col("__total") - 1)).otherwise(0.0)
    hot = hot_values(counts, parts)
    copies = ranks.join(F.broadcast(hot.withColumnRenamed("value", "__hot")), F.col("value").eqNullSafe(F.col("__hot")), "left")
    copies = copies.select(F.col("value").alias("__value"), rank.alias(name), F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)).alias("__copy"))
    dealt = df.join(F.broadcast(hot.select(F.col("value").alias("__hot"), "pieces")), F.col(value).eqNullSafe(F.col("__hot")), "left")
    dealt = dealt.withColumn("__piece", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("pieces")), F.lit(0)).cast("int")).drop("__hot", "pieces")
    return dealt.join(copies, F.col(value).eqNullSafe(F.col("__value")) & (F.col("__piece") == F.col("__copy"))).drop("__value", "__copy", "__piece")
