"""Exact substring deduplication over fixed-block anchors.

Any window of W words holds a whole block of B = (W + 1) // 2 words that begins at a multiple of B in its own document.
So each document's non-overlapping blocks are the reference index, and every rolling run of B words of every document
is a probe: a window that is repeated has its own block met by a probe of the copy, at whatever offset. Blocks that are
met anchor the windows around them, and these windows are extended to the exact repeats by comparing digests of all W
words; a digest that two starts share marks both.

Both comparisons are dealt out by hash. A worker first settles within its batch what it can: of equal probes one goes
out, marked as seen twice, so that a passage shared by a third of all documents costs its reducer one entry for each
batch. Entries that need no answer carry no key. Answers come back as (document key, position) and are joined to the
documents, which are shuffled once by their key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlake.llm.chunked import Words, spread
from martlake.llm.common import bounded_batches, shuffle_partitions, tidy

#: Words of a window.
WINDOW = 35
#: Documents whose words are worked on at a time; what bounds a worker's memory besides a batch's bytes.
PART_DOCS = 500

_BYTE = np.random.default_rng(35).integers(1, 1 << 64, 256, np.uint64, endpoint=False) | np.uint64(1)
_INNER, _OUTER = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


# Hashes of words and runs of words -----------------------------------------------------------------------------------


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The powers of a base modulo 2**64, from the zeroth, at least ``n``."""
    if len(_powers.get(base, ())) < n:
        size = 1 << max(n, 1024).bit_length()
        _powers[base] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]))
    return _powers[base]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_INNER)
    return x ^ (x >> np.uint64(32))


def hash_words(words: Words) -> np.ndarray:
    """64-bit hashes of byte strings."""
    place = np.arange(int(words.length.sum())) - np.repeat(np.cumsum(words.length) - words.length, words.length)
    value = _BYTE[words.data[spread(words.begin, words.length)]] * _power(_INNER, int(words.length.max(initial=0)) + 1)[place]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(value)])
    end = np.cumsum(words.length)
    return _mixed(sums[end] - sums[end - words.length])


def split_words(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """The distinct words (runs of anything but ASCII white space) of a batch, the number of each word, and the bounds
    of each text's words. White space at either end of a text makes no word, but the empty word may be among the
    distinct ones."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    words, number = Words.of(coded.dictionary), coded.indices.to_numpy().astype(np.int64)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    real = words.length[number] > 0
    kept = np.concatenate([[0], np.cumsum(real)])
    return words, number[real], kept[offsets - offsets[0]]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words and the bounds of each text's words."""
    words, number, bounds = split_words(texts)
    return hash_words(words)[number], bounds


def run_hashes(words: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """The hash of the ``length`` words from each place on (across texts too)."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = _OUTER + 2 * salt
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * _power(base, len(words))[: len(words)])])
    return _mixed((sums[length:] - sums[:-length]) * _power(pow(base, -1, 1 << 64), n)[:n])


# Packed entries ------------------------------------------------------------------------------------------------------


def _pack(array: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    import zstandard

    raw = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), array.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _sorted_pack(array: np.ndarray) -> bytes:
    """An array whose order doesn't matter: its sorted differences."""
    array = np.sort(array)
    return _pack(np.diff(array, prepend=array.dtype.type(0)))


def _sorted_unpack(data: bytes, kind: str) -> np.ndarray:
    return np.cumsum(_unpack(data, kind), dtype=kind)


#: once, twice: hashes without a key, seen once or more often in a batch. asking: hashes of single places, with their
#: key and position (and, of windows, how many follow each other). known: places that the batch has settled.
_FIELDS = ("once", "twice", "asking", "k1", "k2", "at", "n", "known_k1", "known_k2", "known_at", "known_n")
_ENTRIES = "dest int, " + ", ".join(f"{x} binary" for x in _FIELDS)
_KINDS = {"k1": "<i8", "k2": "<i4", "at": "<u4", "n": "<u4", "known_k1": "<i8", "known_k2": "<i4", "known_at": "<u4", "known_n": "<u4"}


def _by_dest(dest: np.ndarray, n: int, *arrays: np.ndarray) -> list[list[np.ndarray]]:
    """The arrays of each destination."""
    order = np.argsort(dest, kind="stable")
    cuts = np.searchsorted(dest[order], np.arange(1, n))
    return list(zip(*(np.split(a[order], cuts) for a in arrays), strict=True))


def _entries(labels: np.ndarray, kind: str, once, twice, asking, known) -> pa.RecordBatch:
    """A row for each destination. once, twice: (dest, hash); asking: (dest of run, k1, k2, at, n, hashes of all runs,
    dest of each hash); known: (dest, k1, k2, at, n)."""
    r = len(labels)
    d1, d2, d3, d4 = _by_dest(once[0], r, once[1]), _by_dest(twice[0], r, twice[1]), _by_dest(asking[0], r, *asking[1:5]), _by_dest(known[0], r, *known[1:])
    hashes = _by_dest(asking[6], r, asking[5])
    rows = []
    for k in range(r):
        if not any(len(x) for x in (*d1[k], *d2[k], *d3[k], *d4[k])):
            continue
        packed = [_sorted_pack(d1[k][0].astype(kind)), _sorted_pack(d2[k][0].astype(kind)), _pack(hashes[k][0].astype(kind))]
        packed += [_pack(x.astype(_KINDS[f])) for x, f in zip((*d3[k], *d4[k]), _FIELDS[3:], strict=True)]
        rows.append((int(labels[k]), *packed))
    columns = list(zip(*rows, strict=True)) or [()] * (1 + len(_FIELDS))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["dest", *_FIELDS])


def _settled(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes occur again in the batch, and one place of each of these."""
    order = np.argsort(hashes, kind="stable")
    s = hashes[order]
    same = s[1:] == s[:-1]
    again = np.zeros(len(s), bool)
    again[1:] |= same
    again[:-1] |= same
    first = again.copy()
    first[1:] &= ~same
    out = np.zeros(len(s), bool)
    out[order] = again
    return out, order[first]


_PLACES = "k1 long, k2 int, at long, n long"


def _answers(kind: str):
    """Runs of places whose hashes are elsewhere too, from the entries of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[dict]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                rows.setdefault(r["dest"], []).append(r)
        for dest in list(rows):
            own = rows.pop(dest)
            join = lambda f, own=own: np.concatenate([_unpack(r[f], _KINDS[f]) for r in own])
            once = np.concatenate([_sorted_unpack(r["once"], kind) for r in own])
            twice = np.concatenate([_sorted_unpack(r["twice"], kind) for r in own])
            asking = np.concatenate([_unpack(r["asking"], kind) for r in own])
            k1, k2, at, n = (join(f) for f in ("k1", "k2", "at", "n"))
            values, counts = np.unique(np.concatenate([once, twice, twice, asking]), return_counts=True)
            del once, twice
            hit = counts[np.searchsorted(values, asking)] > 1 if len(asking) else np.zeros(0, bool)
            owner, begin, count = _runs(hit, n)
            out = [np.concatenate([k1[owner], join("known_k1")]), np.concatenate([k2[owner], join("known_k2")])]
            out += [np.concatenate([at[owner] + begin, join("known_at")]).astype(np.int64), np.concatenate([count, join("known_n")]).astype(np.int64)]
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], ["k1", "k2", "at", "n"])

    return run


def _runs(hit: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of hits inside runs of ``n`` places each: the run of places, the offset in it, and how many."""
    n = n.astype(np.int64)
    first = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(n)), n)
    edge = np.ones(len(hit), bool)
    edge[1:] = (hit[1:] != hit[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(edge)
    size = np.diff(np.append(start, len(hit)))
    keep = hit[start] if len(start) else np.zeros(0, bool)
    start, size = start[keep], size[keep]
    return owner[start], start - first[owner[start]], size


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, PART_DOCS):
            yield batch.slice(k, PART_DOCS)


# The two rounds ------------------------------------------------------------------------------------------------------


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("k1").to_numpy(), batch.column("k2").to_numpy()


def _probe(window: int, labels: np.ndarray):
    """Round one: blocks ask, all other rolling runs of a block's length answer."""
    block, r = (window + 1) // 2, len(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            words, bounds = word_hashes(batch.column("text"))
            sizes = np.diff(bounds)
            long = np.flatnonzero(sizes >= window)
            if not len(long):
                continue
            hashes = run_hashes(words, block)
            starts = spread(bounds[long], sizes[long] - block + 1)
            doc = np.repeat(long, sizes[long] - block + 1)
            place = starts - bounds[doc]
            hashes = hashes[starts]
            again, rep = _settled(hashes)
            dest = (hashes >> np.uint64(40)).astype(np.int64) % r
            low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            ask = place % block == 0
            k1, k2 = _keys(batch)
            quiet, single, known = np.flatnonzero(~ask & ~again), np.flatnonzero(ask & ~again), np.flatnonzero(ask & again)
            one = np.ones(len(single), np.int64)
            yield _entries(
                labels, "<u4", (dest[quiet], low[quiet]), (dest[rep], low[rep]),
                (dest[single], k1[doc[single]], k2[doc[single]], place[single], one, low[single], dest[single]),
                ((k1[doc[known]].view(np.uint64) % np.uint64(r)).astype(np.int64), k1[doc[known]], k2[doc[known]], place[known], np.ones(len(known), np.int64)),
            )

    return run


def _least_of(values: np.ndarray, n: int) -> np.ndarray:
    """The least of the ``n`` values from each place on, by doubling."""
    size, out = 1, values
    while size * 2 <= n:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = n - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _extend(window: int, labels: np.ndarray):
    """Round two: the windows around blocks that were met ask. A window is dealt out by the least hash of a run of
    words inside it, which it shares with most of its neighbours, so that neighbours travel together."""
    block, r = (window + 1) // 2, len(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            words, bounds = word_hashes(batch.column("text"))
            sizes = np.diff(bounds)
            met = batch.column("met")
            doc = np.repeat(np.arange(len(sizes)), pc.list_value_length(met).to_numpy())
            at = met.flatten().to_numpy()
            low, high = np.maximum(at - block + 1, 0), np.minimum(at, sizes[doc] - window)
            reach = np.maximum(high - low + 1, 0)
            starts = np.unique(spread(bounds[doc] + low, reach))
            if not len(starts):
                continue
            doc = np.searchsorted(bounds, starts, "right") - 1
            place = starts - bounds[doc]
            hashes = run_hashes(words, window, 1)[starts]
            least = _least_of(run_hashes(words, block), window - block + 1)[starts]
            dest = (least % np.uint64(r)).astype(np.int64)
            again, rep = _settled(hashes)
            k1, k2 = _keys(batch)
            # runs of neighbouring windows of one document, one destination and one kind
            edge = np.ones(len(starts), bool)
            edge[1:] = (starts[1:] != starts[:-1] + 1) | (doc[1:] != doc[:-1]) | (dest[1:] != dest[:-1]) | (again[1:] != again[:-1])
            first = np.flatnonzero(edge)
            n = np.diff(np.append(first, len(starts)))
            ask, known = first[~again[first]], first[again[first]]
            single = np.flatnonzero(~again)
            none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            yield _entries(
                labels, "<u8", none, (dest[rep], hashes[rep]),
                (dest[ask], k1[doc[ask]], k2[doc[ask]], place[ask], n[~again[first]], hashes[single], dest[single]),
                ((k1[doc[known]].view(np.uint64) % np.uint64(r)).astype(np.int64), k1[doc[known]], k2[doc[known]], place[known], n[again[first]]),
            )

    return run


def _labels(spark, n: int) -> np.ndarray:
    """One number for each of ``n`` hash partitions, that is dealt there."""
    ids = spark.range(64 * n + 64).select(F.col("id").cast("int").alias("i")).withColumn("p", F.pmod(F.hash("i"), F.lit(n)))
    rows = ids.groupBy("p").agg(F.min("i").alias("i")).collect()  # one row for each partition
    return np.array([r.i for r in rows], np.int64)


def _spans(window: int, runs: list[dict] | None, n: int) -> np.ndarray:
    """Which of ``n`` words the repeated windows cover."""
    edges = np.zeros(n + 1, np.int64)
    for x in runs or ():
        edges[x["at"]] += 1
        edges[x["at"] + x["n"] - 1 + window] -= 1
    return np.cumsum(edges[:-1]) > 0


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, kept = [], [], []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                sizes.append(len(words))
                if runs:
                    cover = _spans(window, runs, len(words))
                    words = [w for w, c in zip(words, cover.tolist()) if not c]
                gone.append(sizes[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "text"]
            )

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, text (the kept words, joined by one blank).

    Words are runs of anything but ASCII white space, unchanged; a null text has none. Each word is removed that is
    covered by a window of ``window`` consecutive words whose sequence also starts elsewhere, in the same document or
    another. Windows are judged on the input. Repeated rows are copies of each other like any two equal texts, whether
    their ids are equal, different or null. An empty table gives an empty result. Windows are told apart by 64-bit
    digests besides the bits that deal them out.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    r = shuffle_partitions(spark)
    labels = _labels(spark, r)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    keyed = plain.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2"))

    blocks = keyed.mapInArrow(tidy(_probe(window, labels)), _ENTRIES).repartition(r, "dest").mapInArrow(tidy(_answers("<u4")), _PLACES)
    met = blocks.groupBy("k1", "k2").agg(F.collect_set("at").alias("met"))
    anchored = keyed.join(met.hint("shuffle_hash"), ["k1", "k2"]).select("doc_id", "text", "k1", "k2", "met")  # with doc_id: both joins then read one exchange
    windows = anchored.mapInArrow(tidy(_extend(window, labels)), _ENTRIES).repartition(r, "dest").mapInArrow(tidy(_answers("<u8")), _PLACES)
    runs = windows.groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "n")).alias("runs"))
    found = keyed.join(runs.hint("shuffle_hash"), ["k1", "k2"], "left").select("doc_id", "text", "runs")
    return found.mapInArrow(tidy(_remove(window)), "doc_id long, n_words long, n_removed long, text string")
