"""Hard negatives by one-dimensional distance keys.

Inner products become distances: every vector x gets one more coordinate, sqrt(M - x.x) with M the greatest x.x, so all
have length sqrt(M), and a query q gets 0: d(x, q)^2 = M + q.q - 2 x.q. Each row's key is (nearest pivot, distance to
it); the index is the rows sorted by that key, packed into blocks of ``BLOCK_ROWS`` rows, consecutive blocks of one
pivot forming an interval of the key.

A query scans intervals in the order of the least distance that their rows can have: by the triangle inequality (the
annulus around the pivot) and by the planes between pivots. Each round scans eight times as many intervals as the one
before, and only those that may still hold a row for the answer; a query is certified, and scans no more, once the
distance of its last wanted row is below what the remaining intervals allow. All scores are exact integers.

Queries are packed for each interval that they scan and joined to its blocks, so that work is dealt out by interval and
a product of two matrices gives the scores. The number of intervals is bounded (``INTERVALS``): they grow with the table,
so that what packs hold in all grows with the queries, not with queries times blocks. Joins of queries and results are
sort-merge joins by a hint, as Spark takes the size of a file for that of its rows and would broadcast them.
On vectors without any structure bounds don't exclude much, and nearly all intervals are scanned, still exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlake.llm.common import bounded_batches, map_batches, shuffle_partitions, staged, tidy

#: Pivots are the means of a clustering of a bounded sample of about so many rows.
PIVOTS, SAMPLE, ROUNDS = 32, 4096, 5
#: Rows of a block (at most UID_STEP, by which rows are named); intervals that the index has at most, besides one for each pivot and for each partition (of which there are no more).
BLOCK_ROWS, UID_STEP, INTERVALS = 4096, 4096, 128
#: Queries that are scored against a block at a time, and those for which intervals are chosen at a time.
TILE, ROUTED = 512, 256
#: Bytes of packs that are handed over at a time, about.
PACK_BYTES = 8 << 20
#: Intervals of the first round; each further round takes so many times as many.
GROWTH = 8

_LEAST, _MOST = -(1 << 62), 1 << 62
_KEYED = "pivot int, distance double, vec_id long, label long, vector binary"
_BLOCKS = "interval long, block long, pivot int, low double, high double, n int, vec_ids array<long>, labels binary, vectors binary"
_QUERIES = "uid long, vec_id long, label long, vector binary"
_PACKS = "interval long, uids binary, q_labels binary, q_vectors binary, floors binary, caps binary"
_BEST = "uid long, slot int, score long, vec_id long, other long"


@dataclass(frozen=True)
class Shape:
    """What all rows have in common: number, dimensions, greatest square of a length, and the type that holds a component."""

    rows: int
    dims: int
    longest: int
    dtype: str

    @property
    def exact(self) -> type:
        """The type in which products of rows are exact: no partial sum exceeds the greatest square."""
        return np.float32 if self.longest <= 1 << 24 else np.float64


def _matrix(column: pa.Array, scale: float, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of a column of lists, padded with zeros, and which rows are whole: not null, all components finite."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    present = np.asarray(column.is_valid())
    sizes = np.where(present, np.nan_to_num(np.asarray(pc.list_value_length(column).to_numpy(zero_copy_only=False), np.float64)), 0).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
    width = int(sizes.max(initial=0)) if dims is None else dims
    out = np.zeros((n, width))
    row = np.repeat(np.arange(n), sizes)
    with np.errstate(over="ignore", invalid="ignore"):
        out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(scale * values)
        whole = present & np.isfinite(out).all(axis=1)
    return out, whole


def measure(rows: DataFrame, scale: float) -> Shape:
    """The shape of the rows that take part. A ValueError if scores of theirs may not be exact (squares beyond 2^53)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, whole = _matrix(batch.column("vector"), scale)
        x = x[whole]
        with np.errstate(over="ignore"):
            square = float((x * x).sum(axis=1).max(initial=0.0))
        return pa.RecordBatch.from_pylist([{"n": int(whole.sum()), "dims": x.shape[1], "square": square, "size": float(np.abs(x).max(initial=0.0))}])

    parts = map_batches(rows.select("vector"), run, "n long, dims long, square double, size double")
    n, dims, square, size = parts.agg(F.sum("n"), F.max("dims"), F.max("square"), F.max("size")).first()
    if (square or 0.0) > 1 << 53:
        raise ValueError("components are too large: inner products wouldn't be exact")
    return Shape(n or 0, dims or 0, int(square or 0), "<i2" if (size or 0) < 1 << 15 else "<i4")


def _augmented(x: np.ndarray, longest: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(0.0, longest - (x * x).sum(axis=1)))[:, None]], axis=1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T)))


def fit_pivots(rows: DataFrame, shape: Shape, scale: float) -> np.ndarray:
    """Means of a clustering of the augmented vectors of a sample, chosen by hash, of about ``SAMPLE`` rows."""
    share = min(1.0, SAMPLE / max(shape.rows, 1))
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 20)) <= int(share * (1 << 20))).select("vector").limit(2 * SAMPLE)
    table = drawn.toArrow()
    x, whole = _matrix(table.column("vector"), scale, shape.dims)
    x = np.unique(_augmented(x[whole], shape.longest), axis=0)
    if not len(x):
        return np.zeros((1, shape.dims + 1))
    means = x[np.linspace(0, len(x) - 1, min(PIVOTS, len(x))).astype(int)]
    for _ in range(ROUNDS):
        near = _distances(x, means).argmin(axis=1)
        means = np.stack([x[near == k].mean(axis=0) if (near == k).any() else means[k] for k in range(len(means))])
    return means


def build_index(rows: DataFrame, shape: Shape, pivots: np.ndarray, scale: float) -> DataFrame:
    """The blocks of the index, sorted by (pivot, distance), written."""
    bounded_batches(rows.sparkSession)
    dtype, per_interval = np.dtype(shape.dtype), max(1, -(-shape.rows // (BLOCK_ROWS * INTERVALS)))

    def key(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, whole = _matrix(batch.column("vector"), scale, shape.dims)
        x, kept = x[whole], batch.filter(pa.array(whole))
        d = _distances(_augmented(x, shape.longest), pivots)
        near = d.argmin(axis=1)
        packed = [v.tobytes() for v in x.astype(dtype)]
        columns = [pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near]), kept.column("vec_id"), kept.column("label"), pa.array(packed, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["pivot", "distance", "vec_id", "label", "vector"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, count, last, used, interval = TaskContext.get().partitionId() << 24, 0, None, 0, 0
        held: list[pa.RecordBatch] = []

        def block(rows: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal count, last, used, interval
            pivot, distance = rows.column("pivot")[0].as_py(), rows.column("distance")
            if pivot != last or used == per_interval:
                interval, used = base + count, 0
            last, used, count = pivot, used + 1, count + 1
            order = pc.sort_indices(rows, [("vec_id", "ascending")], null_placement="at_end")  # equal scores go by column
            rows = rows.take(order)
            row = {
                "interval": interval, "block": base + count - 1, "pivot": pivot, "low": pc.min(distance).as_py(), "high": pc.max(distance).as_py(), "n": rows.num_rows,
                "vec_ids": rows.column("vec_id").to_pylist(), "labels": rows.column("label").to_numpy().astype("<i8").tobytes(), "vectors": b"".join(rows.column("vector").to_pylist()),
            }
            return pa.RecordBatch.from_pylist([row], _BLOCK_ARROW)

        for batch in batches:
            if not batch.num_rows:
                continue
            held = [pa.concat_batches([*held, batch])]
            while held:
                whole = held[0]
                same = int(np.searchsorted(whole.column("pivot").to_numpy(), whole.column("pivot")[0].as_py(), side="right"))
                if same < BLOCK_ROWS and same == whole.num_rows:
                    break  # more of this pivot may come
                cut = min(same, BLOCK_ROWS)
                yield block(whole.slice(0, cut))
                held = [whole.slice(cut)] if cut < whole.num_rows else []
        if held:
            yield block(held[0])

    keyed = map_batches(rows.select("vec_id", "label", "vector"), key, _KEYED)
    order = ["pivot", "distance", "vec_id"]
    ranged = keyed.repartitionByRange(min(shuffle_partitions(rows.sparkSession), INTERVALS), *order).sortWithinPartitions(*order)
    return staged(ranged.mapInArrow(tidy(pack), _BLOCKS), "distance-index")


_BLOCK_ARROW = pa.schema([
    ("interval", pa.int64()), ("block", pa.int64()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int32()),
    ("vec_ids", pa.list_(pa.int64())), ("labels", pa.binary()), ("vectors", pa.binary()),
])


def rows_of(index: DataFrame, shape: Shape, every: int) -> DataFrame:
    """uid, vec_id, label, vector of the indexed rows whose id is divisible by ``every``, written."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        width = np.dtype(shape.dtype).itemsize * shape.dims
        for r in batch.to_pylist():
            labels = np.frombuffer(r["labels"], "<i8")
            out += [(r["block"] * UID_STEP + k, v, int(labels[k]), r["vectors"][k * width : (k + 1) * width]) for k, v in enumerate(r["vec_ids"]) if v is not None and v % every == 0]
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True)], ["uid", "vec_id", "label", "vector"])

    return staged(map_batches(index.select("block", "vec_ids", "labels", "vectors"), run, _QUERIES), "queries")


@dataclass(frozen=True)
class Directory:
    """The intervals of an index: their pivots and bounds of the distance; the pivots and the distances between them."""

    interval: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    pivots: np.ndarray
    longest: float

    @classmethod
    def of(cls, index: DataFrame, pivots: np.ndarray, shape: Shape) -> Directory:
        found = index.groupBy("interval").agg(F.first("pivot"), F.min("low"), F.max("high")).toArrow()  # at most twice INTERVALS and some
        columns = [found.column(k).to_numpy() for k in range(4)]
        order = np.argsort(columns[0])
        return cls(*(c[order] for c in columns), pivots, float(shape.longest))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query and interval: least distance (to order by), and bounds below and above of a row's score."""
        d = _distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), self.pivots)
        between = _distances(self.pivots, self.pivots)
        with np.errstate(divide="ignore", invalid="ignore"):
            # a row of pivot p is on p's side of the plane between p and any other pivot c
            planes = (d[:, :, None] ** 2 - d[:, None, :] ** 2) / (2 * between)
        plane = np.where(between > 0, planes, 0.0).max(axis=2)
        own = d[:, self.pivot]
        least = np.maximum.reduce([own - self.high, self.low - own, plane[:, self.pivot], np.zeros_like(own)])
        return least, *self._scores(q, own, least, self.high)

    def _scores(self, q: np.ndarray, own: np.ndarray, least: np.ndarray, high: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
        whole = self.longest + (q * q).sum(axis=1)[:, None]
        slack = 1e-6 * whole + 1e-3
        return (whole - (own + high) ** 2) / 2 - slack, (whole - least**2) / 2 + slack

    def asks(self, q: np.ndarray, floors: np.ndarray, caps: np.ndarray, pivot: int, low: float, high: float) -> np.ndarray:
        """Which queries a block may hold a row for, by the annulus around its pivot, which is thinner than its interval's."""
        own = _distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), self.pivots[pivot][None])
        worst, best = self._scores(q, own, np.maximum(np.maximum(own - high, low - own), 0.0), high)
        return ((best >= floors) & (worst <= caps)).any(axis=1)


def route(queries: DataFrame, directory: Directory, shape: Shape, first: int, last: int) -> DataFrame:
    """Packs of the queries that must scan an interval, of those from the first to the last in order of distance."""
    dtype = np.dtype(shape.dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: list[dict] = []
        size = 0
        for part in (batch.slice(at, ROUTED) for batch in batches for at in range(0, batch.num_rows, ROUTED)):
            n = part.num_rows
            q = np.frombuffer(b"".join(part.column("vector").to_pylist()), dtype).reshape(n, -1)
            floors, caps = (np.array(part.column(c).to_pylist(), np.int64).reshape(n, -1) for c in ("floors", "caps"))
            least, worst, best = directory.bounds(q.astype(np.float64))
            place = np.argsort(least, axis=1, kind="stable")[:, first:last]
            wanted = np.zeros(least.shape, bool)
            np.put_along_axis(wanted, place, True, axis=1)
            open_ = np.zeros(least.shape, bool)
            for j in range(floors.shape[1]):  # few: one for each positive
                open_ |= (best >= floors[:, j, None]) & (worst <= caps[:, j, None])
            uids, labels = (part.column(c).to_numpy() for c in ("uid", "label"))
            wanted &= open_
            for s in np.nonzero(wanted.any(axis=0))[0]:
                w = wanted[:, s]
                arrays = (uids[w], labels[w], q[w], floors[w], caps[w])
                packs.append(dict(zip(_PACK_NAMES, [int(directory.interval[s]), *(np.ascontiguousarray(x).tobytes() for x in arrays)], strict=True)))
                size += sum(x.nbytes for x in arrays)
                if size >= PACK_BYTES:
                    yield pa.RecordBatch.from_pylist(packs, _PACK_ARROW)
                    packs, size = [], 0
        yield pa.RecordBatch.from_pylist(packs, _PACK_ARROW)

    bounded_batches(queries.sparkSession)
    return queries.select("uid", "label", "vector", "floors", "caps").mapInArrow(tidy(run), _PACKS)


_PACK_NAMES = ["interval", "uids", "q_labels", "q_vectors", "floors", "caps"]
_PACK_ARROW = pa.schema([("interval", pa.int64()), *((c, pa.binary()) for c in _PACK_NAMES[1:])])


def _best_of(pack: dict, directory: Directory, dtype: np.dtype, exact: type, k: int, same_label: bool, tile: int) -> Iterator[list[np.ndarray]]:
    """uid, slot, score, column of the best rows of a block, at most ``k`` for each query of a pack and slot of the query.

    The pack's floors, an array, rise to the last of ``k`` rows that a slot got: lesser rows of further blocks don't count.
    """
    uids, q_labels = np.frombuffer(pack["uids"], "<i8"), np.frombuffer(pack["q_labels"], "<i8")
    n, labels = len(uids), np.frombuffer(pack["labels"], "<i8")
    q, x = (np.frombuffer(pack[c], dtype).reshape(m, -1).astype(exact) for c, m in (("q_vectors", n), ("vectors", len(labels))))
    floors, caps = pack["floors"], np.frombuffer(pack["caps"], "<i8").reshape(n, -1)
    asks = np.flatnonzero(directory.asks(q.astype(np.float64), floors, caps, pack["pivot"], pack["low"], pack["high"]))
    uids, q_labels, q, floors, caps = (x[asks] for x in (uids, q_labels, q, floors, caps))
    for at in range(0, len(uids), tile):
        part = slice(at, at + tile)
        scores = q[part] @ x.T
        f, c = floors[part], caps[part]
        wanted = (q_labels[part, None] == labels) == same_label
        wanted &= scores >= f.min(axis=1, keepdims=True).astype(exact)
        wanted &= scores <= c.max(axis=1, keepdims=True).astype(exact)
        own = uids[part] - pack["block"] * UID_STEP  # a row isn't its own neighbour
        mine = np.nonzero((own >= 0) & (own < len(labels)))[0]
        wanted[mine, own[mine]] = False
        row, column = np.nonzero(wanted)
        score = scores[row, column].astype(np.int64)
        order = np.lexsort((column, -score, row))
        row, column, score = row[order], column[order], score[order]
        for j in range(f.shape[1]):
            fits = (score >= f[row, j]) & (score <= c[row, j])
            r = row[fits]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            top = place < k
            if top.any():
                full = place == k - 1
                pack["floors"][asks[part][r[full]], j] = score[fits][full]
                yield [uids[part][r[top]], np.full(top.sum(), j), score[fits][top], column[fits][top]]


def scan_blocks(packs: DataFrame, index: DataFrame, directory: Directory, shape: Shape, k: int, same_label: bool) -> DataFrame:
    """Candidates from the blocks of the intervals that the packs ask for: uid, slot, score, vec_id, other (the row's uid)."""
    dtype, exact = np.dtype(shape.dtype), shape.exact

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uids, floors = b"", np.zeros((0, 1), np.int64)
        for batch in batches:
            out: list[list[pa.Array]] = []
            for i in range(batch.num_rows):
                pack = {c: batch.column(c)[i].as_py() for c in ("uids", "q_labels", "q_vectors", "floors", "caps", "labels", "vectors", "block", "pivot", "low", "high")}
                if pack["uids"] != uids:  # else the next block of an interval
                    uids, floors = pack["uids"], np.frombuffer(pack["floors"], "<i8").reshape(len(pack["uids"]) // 8, -1).copy()
                pack["floors"], ids = floors, batch.column("vec_ids")[i].values
                for uid, slot, score, column in _best_of(pack, directory, dtype, exact, k, same_label, TILE):
                    out.append([pa.array(uid), pa.array(slot, pa.int32()), pa.array(score), ids.take(pa.array(column)), pa.array(pack["block"] * UID_STEP + column)])
            columns = [pa.concat_arrays(c) for c in zip(*out, strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "slot", "score", "vec_id", "other"])

    bounded_batches(index.sparkSession)
    blocks = index.select("interval", "block", "pivot", "low", "high", "vec_ids", "labels", "vectors")
    return packs.join(blocks.hint("merge"), "interval").mapInArrow(tidy(run), _BEST)


def search(index: DataFrame, queries: DataFrame, directory: Directory, shape: Shape, k: int, same_label: bool) -> DataFrame:
    """The first ``k`` rows for each query and slot: uid, slot, score, vec_id, other; exact.

    ``queries`` has uid, label, vector, and arrays ``floors`` and ``caps``: a slot takes rows of the query's label (or
    of other labels) with a score from its floor to its cap; higher scores come first, ties by smaller vec_id.
    """
    rank = Window.partitionBy("uid", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "other")
    best, first, last = None, 0, 1
    while first < len(directory.interval) or best is None:
        asked = queries
        if best is not None:
            full = best.groupBy("uid", "slot").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
            reached = full.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("slot", "kth"))).alias("reached"))  # few slots
            floor = F.transform("floors", lambda x, j: F.greatest(x, F.coalesce(F.try_element_at("reached", j), x)))
            asked = queries.join(reached.hint("merge"), "uid", "left").withColumn("floors", floor)
        found = scan_blocks(route(asked, directory, shape, first, last), index, directory, shape, k, same_label)
        both = found if best is None else found.unionByName(best)
        best = staged(both.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= k).drop("n"), "nearest")
        first, last = last, last * (GROWTH + 1)
    return best


def mine(
    rows: DataFrame, anchors_every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0
) -> DataFrame:
    """Hard negatives of anchors: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label and vector. A component counts as floor(scale * x), a score is the inner product of two
    rows. Anchors are the rows whose id is divisible by ``anchors_every``; an anchor's positives are the ``positives``
    other rows of its label of highest score. For each of them, the first ``negatives`` rows of other labels are
    returned whose score is from ``low`` to ``high`` per cent of the positive's. Ties go to the smaller id, null last.

    Rows with a null label, a null vector or a null or non-finite component take no part. Rows with a null id aren't
    anchors. Repeated rows and ids are rows of their own. Shorter vectors count as filled up with zeros. An empty table
    gives an empty result; other columns don't matter. Components so large that an inner product may exceed 2^53 are an
    error.
    """
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    rows = rows.where("label IS NOT NULL AND vector IS NOT NULL")
    shape = measure(rows, scale)
    pivots = fit_pivots(rows, shape, scale)
    index = build_index(rows, shape, pivots, scale)
    directory = Directory.of(index, pivots, shape)
    anchors = rows_of(index, shape, anchors_every)

    def one(value: int) -> Column:
        return F.array(F.lit(value).cast("long"))

    open_slot = {"floors": one(_LEAST), "caps": one(_MOST)}
    near = search(index, anchors.withColumns(open_slot), directory, shape, positives, True)
    order = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "other")
    chosen = staged(near.select("uid", (F.row_number().over(order) - 1).alias("slot"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")), "positives")

    # low * p <= 100 * n <= high * p has no solution below zero; slots that an anchor lacks take nothing
    p = F.col("positive_score")
    span = F.struct("slot", F.ceil(low * p.cast("decimal(20,0)") / 100).cast("long").alias("floor"), F.floor(high * p.cast("decimal(20,0)") / 100).cast("long").alias("cap"))
    spans = chosen.where(p >= 0).groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("slot", span))).alias("spans"))
    slots = F.array(*(F.lit(j) for j in range(positives)))
    floors = F.transform(slots, lambda j: F.coalesce(F.try_element_at("spans", j)["floor"], F.lit(_MOST)))
    caps = F.transform(slots, lambda j: F.coalesce(F.try_element_at("spans", j)["cap"], F.lit(_LEAST)))
    asked = staged(anchors.join(spans.hint("merge"), "uid").select("uid", "label", "vector", floors.alias("floors"), caps.alias("caps")), "spans")
    hard = search(index, asked, directory, shape, negatives, False)
    ranked = hard.withColumn("rank", F.row_number().over(Window.partitionBy("uid", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "other")))
    named = anchors.select("uid", F.col("vec_id").alias("anchor_id"))
    return (
        ranked.join(chosen.hint("merge"), ["uid", "slot"]).join(named.hint("merge"), "uid")
        .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
