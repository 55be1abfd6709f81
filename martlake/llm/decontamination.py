"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, probed by every window of the corpus."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlake.llm.common import bounded_batches, documents_of, fresh, staged, tidy

#: Consecutive words of a window.
WINDOW = 13
#: A document is contaminated if it has a hit and this many times its hit words reach its words.
SHARE = 20
#: UTF-8 bytes of benchmark text that one broadcast is built from; a larger benchmark is scanned in shards, one after the
#: other. A window takes 60 bytes of the built set, so that a shard has 80 MB at six bytes a word (240 MB at two).
SHARD_BYTES = 8 << 20

#: A-Z to a-z; what isn't a letter or digit of ASCII, or above ASCII, becomes a blank.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words_of(text: str | None) -> list[bytes]:
    """The normalised words, as UTF-8; none of a null text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass
class Windows:
    """The distinct windows of one length, by hash."""

    hashes: np.ndarray
    words: np.ndarray  # int32 [window, word]
    first: np.ndarray  # where the items of each window begin, and the end
    items: np.ndarray

    def of(self, window: int) -> list[int]:
        return self.items[self.first[window] : self.first[window + 1]].tolist()


@dataclass
class NGrams:
    """The windows of a benchmark: a vocabulary, and for each window length a sorted hash set."""

    vocabulary: dict[bytes, int]
    codes: np.ndarray  # a 64-bit code of each word id; 0 is any other word
    sets: dict[int, Windows]
    _powers: list = field(default_factory=list)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if not self._powers or len(self._powers[0]) < n:
            size = 1 << max(n, 1024).bit_length()
            self._powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, x)])) for x in (_BASE, _INVERSE)]
        return self._powers[0], self._powers[1]

    def windows(self, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of ``length`` words that the vocabulary has all words of."""
        n = len(ids) - length + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        up, down = self.powers(len(ids))
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        at = np.flatnonzero(known[length:] - known[:-length] == length)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.codes[ids] * up[: len(ids)])])
        return at, (sums[at + length] - sums[at]) * down[at]


def ngrams(items: list[tuple[int | None, str | None]], window: int = WINDOW) -> NGrams:
    """The n-gram sets of benchmark items. An item with fewer words than the window, but some, is one window."""
    vocabulary: dict[bytes, int] = {}
    rows: dict[int, list[tuple[int | None, np.ndarray]]] = {}
    for item, text in items:
        ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)], np.int32)
        if len(ids):
            length = min(window, len(ids))
            rows.setdefault(length, []).append((item, np.lib.stride_tricks.sliding_window_view(ids, length)))
    found = NGrams(vocabulary, np.random.default_rng(13).integers(1, 1 << 63, len(vocabulary) + 1, np.uint64), {})
    for length, own in rows.items():
        table, place = np.unique(np.concatenate([x for _, x in own]), axis=0, return_inverse=True)
        known = np.repeat([i is not None for i, _ in own], [len(x) for _, x in own])
        named = np.repeat(np.array([i or 0 for i, _ in own], np.int64), [len(x) for _, x in own])
        hashes = (found.codes[table] * found.powers(length)[0][:length]).sum(1, dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        pairs = np.unique(np.stack([rank[place.ravel()[known]], named[known]], axis=1), axis=0)
        found.sets[length] = Windows(hashes[order], table[order], np.searchsorted(pairs[:, 0], np.arange(len(order) + 1)), pairs[:, 1])
    return found


def scan(grams: NGrams, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], list[int]]]:
    """For each text: its number of words, its hit spans (first word, word after the last) and the items that occur."""
    get, ids, sizes = grams.vocabulary.get, [], []
    for t in texts:
        words = words_of(t)
        sizes.append(len(words))
        ids += [get(w, 0) for w in words]
        ids.append(0)  # no window crosses to the next text
    codes = np.array(ids, np.int64)
    starts = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + 1)])
    edges, items = np.zeros(len(codes) + 1, np.int64), [set() for _ in texts]
    for length, own in grams.sets.items():
        hashes, table = own.hashes, own.words
        at, probe = grams.windows(codes, length)
        slot = np.searchsorted(hashes, probe)
        slot[slot == len(hashes)] = 0
        at, probe, slot = at[hashes[slot] == probe], probe[hashes[slot] == probe], slot[hashes[slot] == probe]
        while len(at):  # equal hashes are verified one after the other, so a collision can neither add nor lose a hit
            true = (codes[at[:, None] + np.arange(length)] == table[slot]).all(1)
            np.add.at(edges, at[true], 1)
            np.add.at(edges, at[true] + length, -1)
            seen = np.unique(np.stack([np.searchsorted(starts, at[true], "right") - 1, slot[true]]), axis=1)
            for doc, window in seen.T.tolist():
                items[doc].update(own.of(window))
            slot = slot + 1
            more = ~true & (slot < len(hashes))
            more &= hashes[np.minimum(slot, len(hashes) - 1)] == probe
            at, probe, slot = at[more], probe[more], slot[more]
    inside = np.concatenate([[0], (np.cumsum(edges[:-1]) > 0).astype(np.int8), [0]])
    turns = np.flatnonzero(np.diff(inside))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for b, e in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
        doc = int(np.searchsorted(starts, b, "right")) - 1
        spans[doc].append((b - int(starts[doc]), e - int(starts[doc])))
    return [(n, s, sorted(i)) for n, s, i in zip(sizes, spans, items, strict=True)]


def _row(n_words: int, spans: list[tuple[int, int]], items: list[int]) -> tuple:
    n_hit = sum(e - b for b, e in spans)
    listed = ",".join(sorted(map(str, items)))
    return n_words, n_hit, len(items), hashlib.sha256(listed.encode()).hexdigest(), n_hit > 0 and SHARE * n_hit >= n_words


def _shards(benchmark: DataFrame, shard_bytes: int) -> list[DataFrame]:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-size // shard_bytes))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items for k in range(n)]


def _broadcast(items: DataFrame, window: int):
    return items.sparkSession.sparkContext.broadcast(ngrams([(r.item_id, r.text) for r in items.collect()], window))


_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())


def _results(ids: pa.Array, found: list[tuple[int, list[tuple[int, int]], list[int]]]) -> pa.RecordBatch:
    columns = list(zip(*(_row(*x) for x in found))) or [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, _KINDS))], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are those of :func:`words_of`; a word is hit if it lies in an occurrence of a benchmark window. Null texts
    have no words and are clean. Items with a null id hit but aren't listed; benchmark rows of one id are one item. An
    empty benchmark leaves all clean. Repeated rows give repeated rows.

    The n-gram set is broadcast after its size is measured. A benchmark beyond ``shard_bytes`` is scanned in shards of
    about that size, one after the other; the hits of all shards are united for each text.
    """
    bounded_batches(docs.sparkSession)
    plain = documents_of(docs)
    shards = _shards(benchmark, shard_bytes)
    if len(shards) > 1:
        return _united(plain, shards, window).mapInArrow(tidy(_result_of_hits), f"doc_id long, {_RESULT}")
    grams = _broadcast(shards[0], window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _results(batch.column("doc_id"), scan(grams.value, batch.column("text").to_pylist()))

    return plain.mapInArrow(tidy(run), f"doc_id long, {_RESULT}")


def _result_of_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [len(words_of(t)) for t in batch.column("text").to_pylist()]
        hits = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())
        yield _results(batch.column("doc_id"), [(n, _merged(s), sorted({i for x in i or [] for i in x})) for n, (s, i) in zip(sizes, hits)])


def _merged(spans: list[list[int]] | None) -> list[tuple[int, int]]:
    """Overlapping and touching spans, each a flat list of (first word, word after the last), as one each."""
    out: list[list[int]] = []
    for b, e in sorted((b, e) for x in spans or [] for b, e in zip(x[::2], x[1::2])):
        if out and b <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([b, e])
    return [(b, e) for b, e in out]


def _united(docs: DataFrame, shards: list[DataFrame], window: int) -> DataFrame:
    """``docs`` with the columns spans and items: the hits of every shard in the row's text; null where there are none.

    Shards are broadcast and scanned one after the other; only texts with hits are written, under two digests of the
    text, so that equal texts share their hits and rows need no ids. Shards find their hits in the same words.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = [F.xxhash64(text), F.hash(text, F.lit(1))]
    keyed = docs.select(text.alias("text"), keys[0].alias("a"), keys[1].alias("b"))
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    parts = None
    for shard in shards:
        grams = _broadcast(shard, window)

        def run(batches: Iterator[pa.RecordBatch], grams=grams) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = scan(grams.value, batch.column("text").to_pylist())
                hit = [k for k, x in enumerate(found) if x[1]]
                rows = batch.select(["a", "b"]).take(pa.array(hit, pa.int64()))
                spans, items = [[y for x in found[k][1] for y in x] for k in hit], [found[k][2] for k in hit]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(spans, kinds[2]), pa.array(items, kinds[3])], ["a", "b", "spans", "items"])

        own = staged(keyed.mapInArrow(tidy(run), "a long, b int, spans array<long>, items array<long>").dropDuplicates(["a", "b"]), "hits")
        grams.destroy()
        parts = own if parts is None else parts.union(own)
    a, b, c, d = fresh(docs, "text_a", "text_b", "hit_a", "hit_b")
    hits = parts.groupBy(F.col("a").alias(c), F.col("b").alias(d)).agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    return docs.withColumns({a: keys[0], b: keys[1]}).join(hits, (F.col(a) == F.col(c)) & (F.col(b) == F.col(d)), "left").drop(a, b, c, d)


#: A word in the original text, before A-Z are lower-cased, for cutting spans; the same words as those of words_of.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _without(batch: pa.RecordBatch, spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    """The batch with the spans of words cut out of its texts."""
    texts, place = batch.column("text").to_pylist(), batch.schema.get_field_index("text")
    for k, own in enumerate(spans):
        if own:
            at = [m.span() for m in _WORD.finditer(texts[k])]
            for b, e in reversed(own):
                texts[k] = texts[k][: at[b][0]] + texts[k][at[e - 1][1] :]
    return batch.set_column(place, batch.schema.field("text"), pa.array(texts, batch.schema.field("text").type))


def _left(batch: pa.RecordBatch, found: list[tuple[int, list[tuple[int, int]], list[int]]], remove: str) -> pa.RecordBatch:
    if remove == "spans":
        return _without(batch, [x[1] for x in found])
    return batch.filter(pa.array([not _row(*x)[-1] for x in found], pa.bool_()))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with all its columns, without its contaminated documents (``remove="documents"``) or with every hit
    span cut out of the texts (``remove="spans"``). Other documents are unchanged; null texts stay null.

    Each row is judged by its own text, whatever its id or the number of shards; all spans are found before any is cut.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be documents or spans, not {remove!r}")
    bounded_batches(docs.sparkSession)
    shards = _shards(benchmark, shard_bytes)
    if len(shards) > 1:
        names = dict(zip(("spans", "items"), fresh(docs, "hit_spans", "hit_items")))
        renamed = docs.select([F.col(f"`{c}`").alias(f"{names.get(c.lower(), '')}_{c}" if c.lower() in names else c) for c in docs.columns])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = [len(words_of(t)) for t in batch.column("text").to_pylist()]
                found = [(n, _merged(s), []) for n, s in zip(sizes, batch.column("spans").to_pylist())]
                yield _left(batch.select(list(range(batch.num_columns - 2))), found, remove)

        return _united(renamed, shards, window).mapInArrow(tidy(cut), renamed.schema).toDF(*docs.columns)
    grams = _broadcast(shards[0], window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _left(batch, scan(grams.value, batch.column("text").to_pylist()), remove)

    return docs.mapInArrow(tidy(run), docs.schema)
