"""Exact distinct counts that are stored by day and merged.

Values get dense ids in the order in which they arrive, from a dictionary table that only grows. A day's values are a
bitmap for each combination of dimensions, in buckets of 32,768 ids: 4 KB for each bucket that the day touches, and since
values of one day arrive together, these are few. The distinct count of any union of days and dimensions is the number of
bits in the union of bitmaps, so months, weeks and channels need no events. Adding the same events again changes nothing;
days that are rebuilt are replaced, and only their events are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlake.functions.numbering import with_row_number
from martlake.sources.store import Store, Table


def new_ids(values: DataFrame, known: DataFrame | None, order: str | None = None) -> DataFrame:
    """value, id: ids for the distinct values (not null) that ``known`` lacks, following its greatest; in the order of
    the least ``order`` of a value, so that what comes together has ids that are close."""
    first = F.min(order) if order else F.lit(0)
    fresh = values.where("value IS NOT NULL").groupBy("value").agg(first.alias("__first"))
    start = 0
    if known is not None:
        fresh = fresh.join(known.select("value"), "value", "left_anti")
        start = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return with_row_number(fresh, "id", F.col("__first"), F.col("value")).select("value", (F.col("id") + start).cast("long").alias("id"))


def bitmaps(rows: DataFrame, by: Sequence[str], id: str = "id") -> DataFrame:
    """The columns ``by``, bucket, bits: bitmaps of the ids (from 1) of rows; null ids make an empty bitmap in bucket 0,
    so combinations without any value are known too."""
    placed = rows.select(*by, F.coalesce(F.bitmap_bucket_number(id), F.lit(0)).alias("bucket"), F.bitmap_bit_position(id).alias("at"))
    return placed.groupBy(*by, "bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def united(maps: DataFrame, by: Sequence[Column | str]) -> DataFrame:
    """The columns ``by``, bucket, bits: bitmaps united over everything else."""
    return maps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def counted(maps: DataFrame, by: Sequence[str], name: str, where: Column | None = None) -> DataFrame:
    """The distinct values in united bitmaps, by the columns ``by``; ``where`` tells which bitmaps count (others make 0)."""
    own = maps if where is None else maps.withColumn("bits", F.when(where, F.col("bits")))
    whole = united(own, by)
    return whole.groupBy(*by).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias(name))


class DistinctCounts:
    """The bitmaps of one kind of value, and the dictionary of its ids, as two tables of a store.

    Events have the columns ``date``, the dimensions, and ``value``.
    """

    def __init__(self, store: Store, layer: str, name: str, dimensions: Sequence[str]):
        self.dimensions = list(dimensions)
        self.ids: Table = store.table(layer, f"{name}_ids")
        self.maps: Table = store.table(layer, f"{name}_bitmaps")

    def _mapped(self, events: DataFrame) -> DataFrame:
        """The events' bitmaps; new values are added to the dictionary first."""
        known = self.ids.read() if self.ids.exists() else None
        fresh = new_ids(events, known, "date")
        self.ids.append(fresh)
        named = events.join(self.ids.read(), "value", "left")
        return bitmaps(named, ["date", *self.dimensions])

    def add(self, events: DataFrame) -> None:
        """Unite the events with what is stored of their days."""
        new = self._mapped(events)
        if not self.maps.exists():
            self.maps.overwrite(new, cluster_by="date")
            return
        span = new.agg(F.min("date"), F.max("date")).first()
        if span[0] is None:
            return
        within = f"date BETWEEN DATE'{span[0]}' AND DATE'{span[1]}'"
        self.maps.replace_where(united(self.maps.read().where(within).unionByName(new), ["date", *self.dimensions]), within)

    def rebuild(self, events: DataFrame, first, last) -> None:
        """Replace the days from the first to the last by these events, all of which are of these days."""
        self.maps.replace_where(self._mapped(events), f"date BETWEEN DATE'{first}' AND DATE'{last}'")

    def read(self) -> DataFrame:
        return self.maps.read()
