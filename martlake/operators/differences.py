"""Where two tables differ, found by sums over ranges of a key.

Both sides are reduced to signed sums by range: the new side's less the old side's. A range whose sums are all zero holds
no difference; the others are cut into smaller ranges, until few rows or one key are left in each. Only these ranges are
read again and joined, and as they're plain bounds on the key, files that are ordered by it are skipped elsewhere.

Sums of 64-bit hashes of whole rows (and the number of rows) tell whether a range's rows are the same, in whatever order;
two different ranges look alike once in 2^64. Sums of amounts tell whether the amounts add up.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlake.functions.order_statistics import By, place_among, sample

#: Ranges that a differing range is cut into, rows (of both sides) of a range that isn't cut any more, ranges at most.
CUTS, FEW, MOST = 32, 1000, 64


@dataclass(frozen=True)
class Span:
    """A range of keys, both ends included, and the rows of both sides in it."""

    first: object
    last: object
    rows: int

    def holds(self, key: str) -> Column:
        return F.col(key).between(F.lit(self.first), F.lit(self.last))


def in_spans(df: DataFrame, key: str, spans: Sequence[Span]) -> DataFrame:
    """The rows in the ranges; none if there are none. Of more than ``MOST`` ranges neighbours are taken together, with
    what is between them."""
    each = -(-len(spans) // MOST)
    wider = [Span(own[0].first, own[-1].last, 0) for k in range(0, len(spans), each or 1) if (own := spans[k : k + each])]
    return df.where(reduce(lambda a, b: a | b, (s.holds(key) for s in wider))) if spans else df.where(F.lit(False))


def differing_spans(old: DataFrame, new: DataFrame, key: str, measures: Sequence[str]) -> list[Span]:
    """The ranges of keys (not null) in which the sums of the measures differ between the two sides.

    Ranges are never wider than they were found to be, and nothing that differs is outside of them: once there are more
    than ``MOST``, they're left as wide as they are.
    """
    sides = [side.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), *((sign * F.coalesce(F.col(m), F.lit(0))).alias(f"m{i}") for i, m in enumerate(measures))) for side, sign in ((old, -1), (new, 1))]
    both = sides[0].unionByName(sides[1])
    sums = [F.sum(f"m{i}").alias(f"m{i}") for i in range(len(measures))]

    def unequal(rows: DataFrame, place: Column) -> list[Span]:
        found = rows.groupBy(place.alias("place")).agg(*sums, F.count(F.lit(1)).alias("n"), F.min("k").alias("first"), F.max("k").alias("last"))
        differs = reduce(lambda a, b: a | b, (F.col(f"m{i}") != 0 for i in range(len(measures))))
        return [Span(r["first"], r["last"], r["n"]) for r in found.where(differs).orderBy("first").collect()]  # a row for each range

    spans = unequal(both, F.lit(0))
    while len(spans) <= MOST and (wide := [s for s in spans if s.rows > FEW and s.first != s.last]):
        rows = in_spans(both, "k", wide)
        pivots = sample(rows, [By("k")], CUTS * len(wide))
        # neighbours that both differ stay apart if they were, as a range ends between any two of them
        ends = sorted({(s.last,) for s in wide} | set(pivots))
        smaller = unequal(rows, place_among([By("k")], ends, rows.schema))
        if len(smaller) == len(wide) and [(s.first, s.last) for s in smaller] == [(s.first, s.last) for s in wide]:
            break
        spans = sorted([s for s in spans if s not in wide] + smaller, key=lambda s: s.first)
    return spans


def row_measures(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with measures of whole rows: a hash of the columns, as a number whose sums don't overflow, and one a row."""
    return df.withColumns({"__hash": F.xxhash64(*columns).cast("decimal(20,0)"), "__one": F.lit(1).cast("long")})


def differing_rows(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame, list[Span]]:
    """Both sides' rows in the ranges of keys where they aren't the same, and the ranges. Rows without key aren't compared."""
    own = [key, *columns]
    spans = differing_spans(row_measures(old.select(*own), own), row_measures(new.select(*own), own), key, ["__hash", "__one"])
    return in_spans(old, key, spans), in_spans(new, key, spans), spans


def unreconciled_days(daily: DataFrame, orders: DataFrame) -> DataFrame:
    """date, gold, silver, difference: the days whose net revenue isn't the sum of the day's revenue orders. Orders are
    added up by ranges of days first; only those of ranges that don't add up are grouped by day."""
    from martlake.operators.marts import revenue_orders

    sold = revenue_orders(orders).select(F.to_date("order_date").alias("date"), F.col("total_amount").alias("amount"))
    gold = daily.select("date", F.col("net_revenue").alias("amount"))
    spans = differing_spans(gold, sold, "date", ["amount"])
    of_day = lambda df, name: in_spans(df, "date", spans).groupBy("date").agg(F.sum("amount").alias(name))
    both = of_day(gold, "gold").join(of_day(sold, "silver"), "date", "full_outer")
    gap = F.coalesce("gold", F.lit(0)) - F.coalesce("silver", F.lit(0))
    return both.withColumn("difference", gap).where("difference <> 0").orderBy("date")
