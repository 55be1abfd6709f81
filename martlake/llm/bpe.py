"""Byte-level BPE encoding and decoding with a lexicon of frequent words in a minimal acyclic transducer."""

from __future__ import annotations

import hashlib
import mmap
import os
import tempfile
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlake.llm import chunked
from martlake.llm.common import bounded_batches, documents_of, map_batches, staged, texts, tidy
from martlake.llm.merges import byte_symbols

#: Words in the lexicon at most: a bound on what is collected, compiled and sent to the executors (a few MB).
LEXICON_WORDS = 1 << 16
#: Occurrences that make a word frequent.
LEAST_COUNT = 8


# The transducer ------------------------------------------------------------------------------------------------------


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The file of a minimal acyclic transducer from byte strings to id sequences.

    Words are added in byte order; each finished suffix is replaced by an equal state registered before, so equal
    suffixes are shared. An edge's output is the number of words that sort before those through it, so the outputs
    along a path add up to a word's rank, which selects its ids. Layout (little-endian): a header of six 32-bit counts,
    then sorted 32-bit edge keys (state * 256 + byte), their targets and their outputs, the final flag of each state,
    offsets of the ids of each rank, ids.
    """
    entries = sorted({k: v for k, v in entries}.items())
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []

    def freeze(final: bool, edges: list[tuple[int, int]]) -> int:
        key = (final, tuple(edges))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, [], -1]]  # [final, edges, the byte that led here] of the last word's open states

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            final, edges, byte = path.pop()
            path[-1][1].append((byte, freeze(final, edges)))

    last = b""
    for word, _ in entries:
        same = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        close(same)
        path.extend([False, [], b] for b in word[same:])
        path[-1][0] = True
        last = word
    close(0)
    root = freeze(path[0][0], path[0][1])

    count = [0] * len(states)  # words below a state; targets always come before their sources
    keys, targets, outputs = [], [], []
    for s, (final, edges) in enumerate(states):
        n = int(final)
        for byte, target in sorted(edges):
            keys.append(s << 8 | byte)
            targets.append(target)
            outputs.append(n)
            n += count[target]
        count[s] = n
    ids = [i for _, v in entries for i in v]
    offsets = np.cumsum([0, *(len(v) for _, v in entries)])
    head = np.array([len(states), len(keys), len(entries), len(ids), root, 0], "<u4")
    flags = np.array([f for f, _ in states], np.uint8)
    return b"".join(np.asarray(x, k).tobytes() for x, k in ((head, "<u4"), (keys, "<u4"), (targets, "<u4"), (outputs, "<u4"), (offsets, "<u4"), (ids, "<u4"), (flags, "u1")))


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, data: bytes):
        # a file in memory where the system has them, else one without a name: nothing stays when the worker ends
        with os.fdopen(os.memfd_create("lexicon"), "w+b") if hasattr(os, "memfd_create") else tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n_states, n_edges, n_words, n_ids, self.root, _ = np.frombuffer(self.map, "<u4", 6).tolist()
        at = 24

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(self.map, kind, n, at)
            at += out.nbytes
            return out

        self.keys, self.targets, self.outputs = (take(n_edges, "<u4") for _ in range(3))
        self.offsets, self.ids, self.final = take(n_words + 1, "<u4"), take(n_ids, "<u4"), take(n_states, "u1")

    def find(self, words: chunked.Words) -> np.ndarray:
        """The rank of each word, or -1; all words advance a byte at a time."""
        n = len(words)
        state, rank, alive = np.full(n, self.root, np.int64), np.zeros(n, np.int64), np.full(n, bool(len(self.keys)))
        order = np.argsort(-words.length, kind="stable")
        longest = words.length[order]
        for k in range(int(longest[0]) if n else 0):
            order = order[: np.searchsorted(-words.length[order], -k, "left")]
            order = order[alive[order]]
            if not len(order):
                break
            key = state[order] << 8 | words.data[words.begin[order] + k]
            edge = np.searchsorted(self.keys, key.astype(np.uint32))
            hit = self.keys[np.minimum(edge, len(self.keys) - 1)] == key
            alive[order[~hit]] = False
            order, edge = order[hit], edge[hit]
            state[order] = self.targets[edge]
            rank[order] += self.outputs[edge]
        return np.where(alive & (self.final[state] == 1), rank, -1)


# Encoding and decoding -----------------------------------------------------------------------------------------------


class LexiconEncoder(chunked.TextEncoder):
    """Looks words up in the lexicon; words that it lacks are merged exactly, by :mod:`martlake.llm.merges`."""

    def __init__(self, path: str, lexicon: Lexicon):
        super().__init__(path, "byte_level")
        self.lexicon = lexicon

    def chunk_ids(self, words: chunked.Words) -> tuple[np.ndarray, np.ndarray]:
        rank = self.lexicon.find(words)
        known, unseen = np.flatnonzero(rank >= 0), np.flatnonzero(rank < 0)
        merged, n_merged = super().chunk_ids(words.take(unseen))
        begin = self.lexicon.offsets[rank[known]].astype(np.int64)
        n = np.zeros(len(words), np.int64)
        n[known], n[unseen] = self.lexicon.offsets[rank[known] + 1] - begin, n_merged
        at = np.cumsum(n) - n
        ids = np.empty(int(n.sum()), np.int32)
        ids[chunked.spread(at[known], n[known])] = self.lexicon.ids[chunked.spread(begin, n[known])]
        ids[chunked.spread(at[unseen], n[unseen])] = merged
        return ids, n


def byte_table(tokenizer) -> list[bytes]:
    """The bytes of each id."""
    of = {c: b for b, c in enumerate(byte_symbols())}
    table = [b""] * (max(tokenizer.get_vocab(with_added_tokens=True).values()) + 1)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        table[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    return table


_lexicons: dict[str, Lexicon] = {}


@lru_cache(maxsize=2)
def _codec(path: str, digest: str) -> tuple[LexiconEncoder, list[bytes]]:
    return LexiconEncoder(path, _lexicons[digest]), byte_table(chunked.load(path))


def _codec_of(path: str, digest: str, lexicon) -> tuple[LexiconEncoder, list[bytes]]:
    if digest not in _lexicons:
        _lexicons.clear()
        _lexicons[digest] = Lexicon(lexicon.value)
    return _codec(path, digest)


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunked.TextEncoder(path, "byte_level")
        for batch in batches:
            _, words, number, _ = encoder._chunks(texts(batch))
            n = np.bincount(number, minlength=len(words))
            used = np.flatnonzero((n > 0) & (words.length > 0))
            kept = words.take(used)
            offsets = pa.py_buffer(np.append(kept.begin, len(kept.data)).astype(np.int32).tobytes())
            word = pa.Array.from_buffers(pa.string(), len(used), [None, offsets, pa.py_buffer(kept.data.tobytes())])
            yield pa.RecordBatch.from_arrays([word, pa.array(n[used], pa.int64())], ["word", "n"])

    return run


def frequent_words(docs: DataFrame, tokenizer_path: str, limit: int = LEXICON_WORDS, least: int = LEAST_COUNT) -> list[str]:
    """Words of all texts that occur ``least`` times or more: the most frequent, ``limit`` at most.

    The counts are whole. The cut is made on classes of about equal counts (an eighth of a power of two), from a
    histogram of these, so no task or driver sorts all words and what is collected is never above the limit.
    """
    bounded_batches(docs.sparkSession)
    counts = documents_of(docs).select("text").mapInArrow(tidy(_count(tokenizer_path)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    kept = staged(counts.where(F.col("n") >= least).withColumn("class", F.floor(F.log2("n") * 8).cast("int")), "words")
    cut, total = None, 0
    for r in sorted(kept.groupBy("class").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["class"]):
        total += r["n"]
        if total > limit:
            break
        cut = r["class"]
    return [] if cut is None else [r.word for r in kept.where(F.col("class") >= cut).select("word").collect()]


def build_lexicon(docs: DataFrame, tokenizer_path: str, limit: int = LEXICON_WORDS) -> bytes:
    words = frequent_words(docs, tokenizer_path, limit)
    encoded = chunked.load(tokenizer_path).encode_batch_fast(words, add_special_tokens=False)  # at most the limit
    return compile_lexicon((w.encode(), e.ids) for w, e in zip(words, encoded, strict=True))


def _with_lexicon(docs: DataFrame, tokenizer_path: str, limit: int):
    lexicon = build_lexicon(docs, tokenizer_path, limit)
    return hashlib.sha256(lexicon + tokenizer_path.encode()).hexdigest(), docs.sparkSession.sparkContext.broadcast(lexicon)


def decode(table: list[bytes], ids: bytes) -> str:
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _slices(ids: bytes, bounds: np.ndarray) -> list[bytes]:
    at = (bounds * 4).tolist()
    return [ids[b:e] for b, e in zip(at, at[1:])]


def encode_documents(docs: DataFrame, tokenizer_path: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit).

    A null text is empty and has no ids; nothing is added, cut or padded; special strings are the library's default.
    Texts outside the plain alphabet of :mod:`martlake.llm.chunked` go to the library as a whole. An empty table gives
    an empty result, repeated rows give repeated rows.
    """
    digest, lexicon = _with_lexicon(docs, tokenizer_path, lexicon_words)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder, _ = _codec_of(tokenizer_path, digest, lexicon)
        ids, bounds = encoder.encode(texts(batch))
        values = _slices(ids.astype("<u4").tobytes(), bounds)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(values, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return map_batches(documents_of(docs), run, "doc_id long, n_tokens long, ids binary")


def encode_and_decode(docs: DataFrame, tokenizer_path: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """Like :func:`encode_documents`, with the text that is decoded from the ids: doc_id, n_tokens, ids, text."""
    digest, lexicon = _with_lexicon(docs, tokenizer_path, lexicon_words)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder, table = _codec_of(tokenizer_path, digest, lexicon)
        ids, bounds = encoder.encode(texts(batch))
        values = _slices(ids.astype("<u4").tobytes(), bounds)
        columns = [batch.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(values, pa.binary()), pa.array([decode(table, x) for x in values], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "text"])

    return map_batches(documents_of(docs), run, "doc_id long, n_tokens long, ids binary, text string")


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give an empty text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = _table(tokenizer_path)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([decode(table, x or b"") for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select(F.col("doc_id").cast("long"), "ids"), run, "doc_id long, text string")


@lru_cache(maxsize=2)
def _table(path: str) -> list[bytes]:
    return byte_table(chunked.load(path))


def round_trip(docs: DataFrame, tokenizer_path: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """Digests of ids and of the decoded text, in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    digest, lexicon = _with_lexicon(docs, tokenizer_path, lexicon_words)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder, table = _codec_of(tokenizer_path, digest, lexicon)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        ids, bounds = encoder.encode(texts(batch))
        values = _slices(ids.astype("<u4").tobytes(), bounds)
        columns = [batch.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(map(sha, values), pa.string()), pa.array([sha(decode(table, x).encode()) for x in values], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(documents_of(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
