"""Exact order statistics, tiles and weighted prefix sums without sorting all rows.

**Selection.** The keys at given ranks are found by several pivots at once. Pivots are a bounded sample of the rows that
are still in question, in the order of a hash; one aggregation counts the rows at each pivot and between neighbouring
ones, so each pivot's ranks are known exactly, and each wanted rank is at a pivot or strictly between two. That repeats
between these, and once few rows are left in between they're read. Every pass leaves about a thirtieth of the rows, and
none of a key that was a pivot, however many rows have it; what's shuffled is two rows for each pivot and task. All
orders that are wanted share each counting pass.

Tiles and bands are then comparisons of each row with a few bounds: no exchange, no window.

**Prefix sums.** Values are grouped first, so ties are one row; a sample of the distinct values cuts them into ranges of
about equal numbers of values, which are summed up side by side and shifted by the ranges before.

The order is that of Spark's sort: null first if ascending and last if descending, NaN above all numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pivots of a pass for each span of rows in question, rows of a span that are read at last, and ranges of prefix sums.
PIVOTS, FEW, RANGES = 32, 2048, 128


@dataclass(frozen=True)
class By:
    """A column of a sort key."""

    column: str
    descending: bool = False

    def order(self) -> Column:
        return F.col(self.column).desc() if self.descending else F.col(self.column).asc()


Key = tuple  # the values of the key's columns


def _literal(value: object, kind: T.DataType) -> str:
    """A value as SQL. Conditions on many keys are built as text, which is one call to the JVM instead of many."""
    if value is None:
        return f"CAST(NULL AS {kind.simpleString()})"
    if isinstance(value, str):
        return f"CAST(X'{value.encode().hex()}' AS STRING)"
    if isinstance(value, datetime):
        whole = value.replace(microsecond=0) if value.tzinfo else value.replace(microsecond=0).astimezone()
        if isinstance(kind, T.TimestampNTZType):
            return f"TIMESTAMP_NTZ'{value.isoformat(' ')}'"
        return f"timestamp_micros({int(whole.timestamp()) * 1_000_000 + value.microsecond})"
    if isinstance(value, date):
        return f"DATE'{value.isoformat()}'"
    return f"CAST('{value}' AS {kind.simpleString()})"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _compared(by: Sequence[By], key: Sequence[str], pivot: Sequence[str]) -> tuple[str, str]:
    """As SQL: whether a key comes before another one, and whether it's the same."""
    before, equal = "false", "true"
    for k, a, b in reversed(list(zip(by, key, pivot, strict=True))):
        low, high = (b, a) if k.descending else (a, b)
        less = f"CASE WHEN {low} IS NULL THEN {high} IS NOT NULL ELSE coalesce({low} < {high}, false) END"
        before, equal = f"({less} OR ({a} <=> {b} AND {before}))", f"({a} <=> {b} AND {equal})"
    return before, equal


def _to_pivot(by: Sequence[By], pivot: Key, schema: T.StructType) -> tuple[str, str]:
    """As SQL: whether a row's key comes before the pivot, and whether it's the same."""
    return _compared(by, [_quoted(k.column) for k in by], [_literal(v, schema[k.column].dataType) for k, v in zip(by, pivot, strict=True)])


def place_among(by: Sequence[By], pivots: Sequence[Key], schema: T.StructType) -> Column:
    """A row's place among pivots, which are in order: 2k + 1 if its key is that of pivots[k], else twice the number of
    pivots before it. The pivots are one constant, so the plan stays small."""
    if not pivots:
        return F.lit(0)
    rows = ", ".join("named_struct(" + ", ".join(f"'c{i}', {_literal(v, schema[k.column].dataType)}" for i, (k, v) in enumerate(zip(by, p, strict=True))) + ")" for p in pivots)
    before, equal = _compared(by, [f"__pivot.c{i}" for i in range(len(by))], [_quoted(k.column) for k in by])
    return F.expr(f"aggregate(array({rows}), 0, (__place, __pivot) -> __place + CASE WHEN {before} THEN 2 WHEN {equal} THEN 1 ELSE 0 END)")


def in_order(keys: Iterable[Key], by: Sequence[By]) -> list[Key]:
    """Keys in Spark's order: null least, NaN greatest, text by its bytes."""
    out = list(keys)
    for i, k in reversed(list(enumerate(by))):
        out.sort(key=lambda x: (x[i] is not None, x[i] != x[i], 0 if x[i] is None or x[i] != x[i] else x[i]), reverse=k.descending)  # noqa: B023
    return out


def _distinct(keys: Sequence[Key]) -> list[Key]:
    same = lambda a, b: all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))
    return [x for k, x in enumerate(keys) if not k or not same(keys[k - 1], x)]


def sample(df: DataFrame, by: Sequence[By], rows: int) -> list[Key]:
    """The distinct keys of at most so many rows, those of least hash, in order."""
    columns = [k.column for k in by]
    drawn = df.select(*columns).orderBy(F.xxhash64(*columns), *columns).limit(rows).collect()
    return _distinct(in_order(map(tuple, drawn), by))


@dataclass(frozen=True)
class _Span:
    """The rows strictly between two keys (None: no bound): ``below`` rows come before them, ``upto`` with them."""

    low: Key | None
    high: Key | None
    below: int
    upto: int

    def holds(self, by: Sequence[By], schema: T.StructType) -> str:
        out = []
        if self.low is not None:
            before, equal = _to_pivot(by, self.low, schema)
            out.append(f"NOT {before} AND NOT {equal}")
        if self.high is not None:
            out.append(_to_pivot(by, self.high, schema)[0])
        return " AND ".join(out) or "true"


class _Search:
    """One order's state: the span that each wanted rank lies in, and the keys that were found."""

    def __init__(self, by: Sequence[By], ranks: Sequence[int], total: int):
        self.by = by
        self.open = {r: _Span(None, None, 0, total) for r in set(ranks) if 1 <= r <= total}
        self.found: dict[int, Key] = {}

    def spans(self, few: bool = False) -> list[_Span]:
        """The spans in question, in order; they don't overlap, as every rank saw all pivots."""
        own = {s.below: s for s in self.open.values() if not few or s.upto - s.below <= FEW}
        return [own[k] for k in sorted(own)]

    def inside(self, schema: T.StructType, few: bool = False) -> Column:
        return F.expr(" OR ".join(f"({s.holds(self.by, schema)})" for s in self.spans(few)) or "false")

    def narrow(self, pivots: Sequence[Key], sizes: Mapping[int, int]) -> None:
        """Take in pivots and the number of rows at each place among them."""
        for rank, span in list(self.open.items()):
            seen = 0
            for k, pivot in enumerate(pivots):
                before = seen + sizes.get(2 * k, 0)
                seen = before + sizes.get(2 * k + 1, 0)
                if before < rank <= seen:
                    self.found[rank] = pivot
                    del self.open[rank]
                    break
                if seen < rank and seen > span.below:
                    span = _Span(pivot, span.high, seen, span.upto)
                elif before >= rank and before < span.upto:
                    span = _Span(span.low, pivot, span.below, before)
            else:
                self.open[rank] = span

    def take(self, keys: Sequence[Key]) -> None:
        """Take in all keys of the spans of few rows, and find the ranks among them."""
        start, ordered = 0, in_order(keys, self.by)
        for span in self.spans(few=True):
            own = ordered[start : start + span.upto - span.below]
            start += len(own)
            for rank in [r for r, s in self.open.items() if s == span]:
                self.found[rank] = own[rank - span.below - 1]
                del self.open[rank]


def select_ranks(df: DataFrame, orders: Mapping[str, Sequence[By]], ranks: Callable[[int], Sequence[int]]) -> tuple[int, dict[str, dict[int, Key]]]:
    """The number of rows, and for each order the keys at the ranks (from 1) that ``ranks`` wants of so many rows; ranks
    beyond them are left out.

    The columns of the keys are held (in memory, beyond that on the executors' disks) while this runs, so that ``df``
    is computed once for it; if an executor is lost its part is computed again.
    """
    columns = sorted({k.column for by in orders.values() for k in by})
    held = df.select(*columns).persist()
    try:
        total, schema = held.count(), held.schema
        searches = {name: _Search(by, ranks(total), total) for name, by in orders.items()}
        while True:
            near = [s for s in searches.values() if s.spans(few=True)]
            if near:  # one read for all orders: a flag for each says whether the row is in its spans
                flags = [s.inside(schema, few=True).alias(f"__in{k}") for k, s in enumerate(near)]
                read = held.select("*", *flags).where(" OR ".join(f"__in{k}" for k in range(len(near)))).collect()
                for k, s in enumerate(near):
                    s.take([tuple(r[x.column] for x in s.by) for r in read if r[f"__in{k}"]])
            wide = [s for s in searches.values() if s.open]
            if not wide:
                return total, {name: s.found for name, s in searches.items()}
            if all(x == _Span(None, None, 0, total) for s in wide for x in s.spans()):  # the first pass: one sample for all
                drawn = held.orderBy(F.xxhash64(*columns), *columns).limit(PIVOTS).collect()
                pivots = [_distinct(in_order([tuple(r[x.column] for x in s.by) for r in drawn], s.by)) for s in wide]
            else:
                pivots = [sample(held.where(s.inside(schema)), s.by, PIVOTS * len(s.spans())) for s in wide]
            places = [F.struct(F.lit(k).alias("order"), place_among(s.by, p, schema).alias("place")) for k, (s, p) in enumerate(zip(wide, pivots, strict=True))]
            counted = held.select(F.explode(F.array(*places)).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()  # two rows for each pivot
            before = [dict(s.open) for s in wide]
            for k, (s, p) in enumerate(zip(wide, pivots, strict=True)):
                s.narrow(p, {r.p.place: r.n for r in counted if r.p.order == k})
            if before == [s.open for s in wide]:
                raise RuntimeError("no pass narrows the search; are the keys' columns the same each time they're computed?")
    finally:
        held.unpersist()


def tile_ends(total: int, tiles: int) -> list[int]:
    """The ranks of the last rows of all tiles but the last: SQL's ntile, whose first tiles have one row more."""
    size, larger = divmod(total, tiles)
    return [j * size + min(j, larger) for j in range(1, tiles)]


def with_tiles(df: DataFrame, tiles: int, orders: Mapping[str, Sequence[By]]) -> DataFrame:
    """``df`` with SQL's ntile over all rows in each order, as int columns of the orders' names.

    Orders should be total; rows that one doesn't tell apart share a tile. ``df`` is computed once more for the result.
    """
    total, found = select_ranks(df, orders, lambda n: tile_ends(n, tiles))

    def tile(name: str, by: Sequence[By]) -> Column:
        return within([found[name][e] for e in tile_ends(total, tiles) if e in found[name]], by, range(1, tiles), tiles, df.schema).cast("int")

    return df.withColumns({name: tile(name, by) for name, by in orders.items()})


def within(ends: Sequence[Key], by: Sequence[By], names: Sequence, last, schema: T.StructType) -> Column:
    """The name of the first of some bands, which end with these keys, that a row's key is in; ``last`` beyond all."""
    own = [F.when(F.expr(" OR ".join(_to_pivot(by, e, schema))), F.lit(name)) for e, name in zip(ends, names, strict=False)]
    return F.coalesce(*own, F.lit(last))


def prefix_sums(counts: DataFrame, by: By, sums: Sequence[str]) -> DataFrame:
    """``counts``, which has each value of a column once, with ``before_x`` for each named column x: its sum over the
    values that come before. ``counts`` is read twice, so it should be stored."""
    ranged = counts.withColumn("__range", place_among([by], sample(counts, [by], RANGES), counts.schema))
    before = Window.partitionBy("__range").orderBy(by.order()).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("__range").agg(*(F.sum(x).alias(f"__{x}") for x in sums))
    of_ranges = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = ranges.select("__range", *(F.coalesce(F.sum(f"__{x}").over(of_ranges), F.lit(0)).alias(f"__{x}") for x in sums))
    whole = ranged.join(F.broadcast(starts), "__range")
    return whole.withColumns({f"before_{x}": F.col(f"__{x}") + F.coalesce(F.sum(x).over(before), F.lit(0)) for x in sums}).drop("__range", *(f"__{x}" for x in sums))
