"""Language-model scoring by logistic mixing of hashed-context bit predictors.

A token's bytes, and a blank that ends it, are predicted bit by bit. Six contexts inside the token (its position, its
last one to four bytes, its whole beginning) are hashed, with the bits of the byte so far, into tables that hold how
often a 0 and a 1 followed; the tables of the longest contexts grow with the distinct training tokens, up to a bound. A
pair of counts is mapped to a probability that was learnt for such pairs; the six are combined in the logistic domain by
weights that a gate selects (the bit's place and the longest context that was seen), and a last map refines the result.
The end of a document is the empty token. Everything is a proper distribution: the probabilities of all token sequences
add up to one.

Documents come in classes (values of a column, such as the language): every context is hashed with the class, so each
class has predictors of its own in the same tables, and a document's probability is the Bayesian mixture over classes,
which adapts to the document from token to token without being told its class.

Contexts across tokens predict a bit for each phrase of some 16 tokens, whether what followed the last three tokens
before, in this document or in others, comes again (:mod:`martlake.llm.phrases`). If it does, its tokens cost nothing
more; if not, they're spelled.

All that's learnt comes from all training tokens, each predicted by the counts without itself. Counts are sums, so tasks
add them up side by side, and contexts across tokens are joined by their hashes. The byte predictors' maps, those of
large counts as well, follow from the exact sums before these are stored by classes. Given the maps, the weights of a gate are a logistic regression, whose one optimum Newton's method
finds from sums over all tokens; the last map is learnt from the sums at the optimum. Given the class, a token's spelling depends on the token alone, so each distinct token is scored once, and shared
beginnings of tokens once; the most frequent tokens reach the documents by broadcast and the others by a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlake.llm import phrases
from martlake.llm.chunked import Words, spread
from martlake.llm.common import bounded_batches, release, shuffle_partitions, staged, task_for_each_file, tidy
from martlake.llm.substrings import _power, hash_words, split_words

#: Bits of the tables: token position, last one, two, three and four bytes, whole beginning. The last two are the least
#: sizes: these tables double until there are TOKEN_SLOTS slots for each distinct training token, up to MOST_BITS, which
#: bounds what is broadcast (two bytes for each slot of all tables: 70 MB).
TABLE_BITS, MOST_BITS, TOKEN_SLOTS = (12, 16, 18, 20, 22, 22), 24, 2
#: Draws of training tokens that the weights' start is learnt on; the optimum over all tokens doesn't depend on it.
DRAWS = 1 << 17
#: The weights are found when another step would lower the cost of all training tokens by less than this share.
SETTLED, ROUNDS = 1e-5, 30
#: Observations that the first maps count for: a token's occurrences come in bursts, which make rare evidence look surer.
PRIOR = 1000
#: Tokens that are broadcast with their scores, at most; the rest is joined.
HEAD_TOKENS = 1 << 19
#: Classes at most, and the share of training documents that makes one; the others are a class together.
CLASSES, CLASS_SHARE = 8, 0.01
#: Distinct tokens of a counting task, and slots of a block of counts on their way to be added up.
TASK_TOKENS, BLOCK_SLOTS = 500_000, 1 << 18
#: Distinct tokens that a task works on at once; neighbours share beginnings.
BATCH_TOKENS = 16_000

EXACT, GROWTH = 16, 1.3  # counts below EXACT are kept as they are, others by classes that grow so
LEVELS = EXACT + 96
END = 0x20
_N = len(TABLE_BITS)
_RATE, _BUCKETS, _LIMIT = 0.1, 24, 12.0
_FIRST_WEIGHT, _STEP = 0.25, 0.4
#: Gates: the longest context that was seen if the token's whole beginning wasn't, else how often that was.
_SEEN = np.array([2, 4, 8, 16, 32])
_GATES = 8 * (_N + len(_SEEN))
#: The gate of pairs of the longest context (zeros + 256 * ones), zero if it wasn't seen.
_LONGEST_GATES = np.add.outer(np.arange(256), np.arange(256)).reshape(-1)
_LONGEST_GATES = np.where(_LONGEST_GATES > 0, _N - 1 + np.searchsorted(_SEEN, _LONGEST_GATES, "right"), 0).astype(np.uint8)


def table_bits(tokens: int) -> tuple[int, ...]:
    """The tables' bits for a number of distinct training tokens."""
    wanted = max(TOKEN_SLOTS * tokens - 1, 0).bit_length()
    return TABLE_BITS[:-2] + tuple(max(b, min(wanted, MOST_BITS)) for b in TABLE_BITS[-2:])


def _offsets(bits: tuple[int, ...]) -> np.ndarray:
    """Where each table begins, and the end of all."""
    return np.concatenate([[0], np.cumsum([1 << b for b in bits])])


def _levels(n: np.ndarray) -> np.ndarray:
    """Classes of counts."""
    high = EXACT + np.floor(np.log(np.maximum(n, EXACT) / EXACT) / np.log(GROWTH))
    return np.where(n < EXACT, n, np.minimum(high, LEVELS - 1)).astype(np.uint8)


def _level_values() -> np.ndarray:
    k = np.arange(LEVELS)
    return np.where(k < EXACT, k, EXACT * GROWTH ** (k - EXACT + 0.5))


# Symbols and slots ---------------------------------------------------------------------------------------------------


def symbols(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens, each followed by the end sign; the token of each, and its place; hashes of its contexts
    [context, n], without the class."""
    length = words.length + 1
    start = np.cumsum(length) - length
    data = np.full(int(length.sum()), END, np.uint8)
    data[spread(start, words.length)] = words.data[spread(words.begin, words.length)]
    token = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(data)) - start[token]
    context = np.zeros((_N, len(data)), np.uint32)
    context[0] = np.minimum(place, 30)
    recent = np.zeros(len(data), np.uint32)
    for k in range(1, 5):
        recent[k:] |= np.where(place[k:] >= k, data[:-k], 0).astype(np.uint32) << np.uint32(8 * (k - 1))
        context[k] = recent
    base = 0xD1B54A32D192ED03
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data + np.uint64(1)) * _power(base, len(data))[: len(data)])])
    whole = (sums[:-1] - sums[start[token]]) * _power(pow(base, -1, 1 << 64), len(data))[start[token]]
    context[5] = ((whole ^ place.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)
    for k in range(_N):
        context[k] = (context[k] + np.uint32(k * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
        context[k] ^= context[k] >> np.uint32(15)
    return data, token, place, context


def _of_class(context: np.ndarray, kind) -> np.ndarray:
    """Contexts within a class (one for all symbols, or of each)."""
    x = (context + np.asarray(kind, np.uint32) * np.uint32(0x61C88647)) * np.uint32(0x7FEB352D)
    return x ^ (x >> np.uint32(16))


def slots_of(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Slots in a table of 2**bits of contexts together with the bits of the byte so far."""
    return _slots(context, node * np.uint32(0x85EBCA6B), bits)


def _slots(context: np.ndarray, nodes: np.ndarray, bits: int) -> np.ndarray:
    """The slots, of multiplied nodes that all tables share."""
    x = context + nodes
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0x27D4EB2F)
    x >>= np.uint32(32 - bits)
    return x


def _parts(words: Words, size: int = 40_000) -> Iterator[tuple[int, Words]]:
    """The tokens in parts of bounded size."""
    for k in range(0, len(words), size):
        yield k, words.take(np.arange(k, min(k + size, len(words))))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about BATCH_TOKENS rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= BATCH_TOKENS:
            yield pa.concat_batches(held)
            held = []
    if sum(x.num_rows for x in held):
        yield pa.concat_batches(held)


def _occurrences(words: Words, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The symbols of tokens with their occurrences [class, token], and the contexts within the class. Symbols after a
    beginning that neighbours share come once, with all their occurrences."""
    for kind, weight in enumerate(weights):
        used = np.flatnonzero(weight)
        for at, part in _parts(words.take(used)):
            data, token, place, context = symbols(part)
            own, where = np.unique(_first_of_beginning(data, token, place), return_inverse=True)
            n = np.bincount(where, weight[used[at : at + len(part)]][token], len(own))
            yield data[own], n, _of_class(context[:, own], kind)


# Counting ------------------------------------------------------------------------------------------------------------


def add_counts(tables: np.ndarray, words: Words, weights: np.ndarray, bits: tuple[int, ...] = TABLE_BITS) -> None:
    """Add tokens with their occurrences [class, token] to the counts [bit, slot of all tables]."""
    flat, offsets = tables.reshape(-1), _offsets(bits)
    for data, n, context in _occurrences(words, weights):
        node, n = np.ones(len(data), np.uint32), n.astype(np.float32)
        for b in range(7, -1, -1):
            bit = (data >> b) & 1
            for k in range(_N):
                np.add.at(flat, slots_of(context[k], node, bits[k]) + (bit * offsets[-1] + offsets[k]), n)
            node = node << np.uint32(1) | bit


def _counts(batch) -> np.ndarray:
    """The occurrences [class, token] of a batch or table with columns c0, c1 and so on."""
    return np.stack([batch.column(f"c{k}").to_numpy() for k in range(sum(x[0] == "c" for x in batch.schema.names))])


def _pack_counts(block: np.ndarray) -> bytes:
    """Counts as compressed byte planes of whole numbers, of which all but the lowest are mostly zero."""
    import zstandard

    planes = np.ascontiguousarray(np.rint(block).astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack_counts(data: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).reshape(2, -1)


def _count_tables(bits: tuple[int, ...]):
    size = int(_offsets(bits)[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        for batch in _joined(batches):
            if tables is None:
                tables = np.zeros((2, size), np.float32)
            add_counts(tables, Words.of(batch.column("token")), _counts(batch).astype(np.float32), bits)
        if tables is None:
            return
        for k in range(0, size, BLOCK_SLOTS):
            block = tables[:, k : k + BLOCK_SLOTS]
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK_SLOTS], pa.int32()), pa.array([_pack_counts(block)], pa.binary())], ["block", "counts"])

    return run


def evidence_of(counts: np.ndarray) -> np.ndarray:
    """What followed each pair of classes of counts [bit, class of zeros, class of ones], of the counts [bit, slot] of a table.

    An occurrence is predicted by its slot's counts without itself. So a slot with z zeros and o ones is z zeros that
    came after (z - 1, o), and o ones that came after (z, o - 1), whatever the size of z and o.
    """
    zeros, ones = counts
    out = np.zeros((2, LEVELS * LEVELS))
    for bit, before, n in ((0, (zeros - 1, ones), zeros), (1, (zeros, ones - 1), ones)):
        used = n > 0
        pair = _levels(before[0][used]).astype(np.int64) * LEVELS + _levels(before[1][used])
        out[bit] += np.bincount(pair, n[used], LEVELS * LEVELS)
    return out.reshape(2, LEVELS, LEVELS)


def _add_blocks(bits: tuple[int, ...]):
    offsets = _offsets(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                block = _unpack_counts(r["counts"])
                if r["block"] not in sums:
                    sums[r["block"]] = np.zeros(block.shape)
                sums[r["block"]] += block
        evidence = np.zeros((_N, 2, LEVELS, LEVELS))
        for k, x in sums.items():
            inside = np.clip(offsets - k * BLOCK_SLOTS, 0, x.shape[1])
            for table, (begin, end) in enumerate(zip(inside, inside[1:], strict=False)):
                if begin < end:
                    evidence[table] += evidence_of(x[:, begin:end])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pack(_levels(x).tobytes())], pa.binary())], ["block", "counts"])
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([pack(evidence.tobytes())], pa.binary())], ["block", "counts"])

    return run


def count_tables(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray, tuple[int, ...]]:
    """Of tokens (token, c0, c1, ...) with their occurrences: classes of the counts [bit, slot], two bytes for each slot;
    what followed each pair of classes [context, bit, class of zeros, class of ones]; the tables' bits.

    Tasks add up tables of their own; the tables are added block by block. A task's sums are 32-bit floats: of a count
    beyond 2^24 its TASK_TOKENS additions lose 1.5 % at most, in a class of counts that's 30 % wide.
    """
    import zstandard

    distinct = tokens.count()
    bits = table_bits(distinct)
    size = int(_offsets(bits)[-1])
    blocks = tokens.coalesce(max(1, -(-distinct // TASK_TOKENS))).mapInArrow(tidy(_count_tables(bits)), "block int, counts binary")
    summed = blocks.repartition(min(shuffle_partitions(tokens.sparkSession), size // BLOCK_SLOTS + 1), "block").mapInArrow(tidy(_add_blocks(bits)), "block int, counts binary")
    # both counts of a slot are neighbours in memory
    out, evidence = np.zeros((size, 2), np.uint8).T, np.zeros((_N, 2, LEVELS, LEVELS))
    for r in summed.collect():  # the tables' size
        raw = zstandard.ZstdDecompressor().decompress(r["counts"])
        if r["block"] < 0:
            evidence += np.frombuffer(raw).reshape(evidence.shape)
        else:
            levels = np.frombuffer(raw, np.uint8).reshape(2, -1)
            out[:, r["block"] * BLOCK_SLOTS :][:, : levels.shape[1]] = levels
    return out, evidence, bits


# The model -----------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    counts: np.ndarray | None  # uint8 [bit, slot]: classes of counts (None: elsewhere)
    maps: np.ndarray  # float32 [context, class of zeros, class of ones]: log odds of a one
    weights: np.ndarray  # float32 [gate, context + 1]
    refine: np.ndarray  # float32 [gate, bucket]: log odds of a one
    bits: tuple[int, ...] = TABLE_BITS

    @cached_property
    def pairs(self) -> np.ndarray:
        """The classes of a slot's counts side by side, zeros + 256 * ones, so that both are one access to memory."""
        return np.ascontiguousarray(self.counts.T).view("<u2")[:, 0]

    @cached_property
    def odds_of_pairs(self) -> np.ndarray:
        """The maps by pairs [context, zeros + 256 * ones]."""
        out = np.zeros((_N, 256, 256), np.float32)
        out[:, :LEVELS, :LEVELS] = self.maps.transpose(0, 2, 1)
        return out.reshape(_N, -1)


def _odds(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _first_maps() -> np.ndarray:
    """Before anything is learnt: the estimate with 0.4 added to both counts."""
    n = _level_values()
    one = _odds((n[None, :] + 0.4) / (n[:, None] + n[None, :] + 0.8))
    return np.repeat(one[None], _N, 0).astype(np.float32)


def _first_refine() -> np.ndarray:
    return np.repeat(np.linspace(-_LIMIT, _LIMIT, _BUCKETS + 1)[None], _GATES, 0).astype(np.float32)


def _inputs(model: Model, context: np.ndarray, node: np.ndarray, b: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Classes of both counts for each context, as zeros + 256 * ones, and the gate. without: bits whose own occurrence is
    taken off."""
    pairs, table, offsets = np.empty((_N, len(node)), np.uint16), model.pairs, _offsets(model.bits)
    gate, nodes = np.zeros(len(node), np.uint8), node * np.uint32(0x85EBCA6B)
    if without is not None:
        shift = (without << 3).astype(np.uint16)
        unit = np.uint16(1) << shift
    for k in range(_N):
        pair = pairs[k]
        np.take(table[offsets[k] : offsets[k + 1]], _slots(context[k], nodes, model.bits[k]), out=pair, mode="clip")  # all are inside
        if without is not None:
            own = ((pair >> shift) & np.uint16(255)) - np.uint16(1)  # none wraps around
            pair -= unit * (own < np.uint16(EXACT - 1))
        np.maximum(gate, (pair > 0).view(np.uint8) * np.uint8(k) if k < _N - 1 else _LONGEST_GATES.take(pair, mode="clip"), out=gate)
    return pairs, gate.astype(np.intp) * 8 + b


def _buckets(mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower bucket of mixed log odds and the share of the upper."""
    x = (np.clip(mixed, -_LIMIT, _LIMIT) + _LIMIT) * (_BUCKETS / (2 * _LIMIT))
    low = np.minimum(x.astype(np.int64), _BUCKETS - 1)
    return low, x - low


def _refined(model: Model, gate: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The refined log odds, with the lower bucket and the share of the upper."""
    low, share = _buckets(mixed)
    at, refine = gate * (_BUCKETS + 1) + low, model.refine.reshape(-1)
    lower = refine.take(at, mode="clip")
    at += 1
    return lower + (refine.take(at, mode="clip") - lower) * share, low, share


def _predict(model: Model, pairs: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and mixed log odds."""
    given, odds = np.empty((_N + 1, len(gate)), np.float32), model.odds_of_pairs
    for k in range(_N):
        np.take(odds[k], pairs[k], out=given[k], mode="clip")
    given[_N] = 0.3
    mixed, weights = np.zeros(len(gate), np.float32), np.ascontiguousarray(model.weights.T)
    for k in range(_N + 1):
        mixed += given[k] * weights[k].take(gate, mode="clip")
    return given, mixed


def log_probabilities(model: Model, words: Words, classes: int = 1) -> np.ndarray:
    """The natural logarithm of each token's probability, its end included, in each class [class, token].

    Tokens that are in byte order share the work for common beginnings; others only take longer.
    """
    out = np.zeros((classes, len(words)))
    for at, part in _parts(words):
        data, token, place, context = symbols(part)
        first = _first_of_beginning(data, token, place)
        own, where = np.unique(first, return_inverse=True)
        data, context = data[own], context[:, own]
        for kind in range(classes):
            salted = _of_class(context, kind)
            node, inverse = np.ones(len(data), np.uint32), np.ones(len(data))  # of eight bits' probabilities: at most (1 + e^12)^8
            for b in range(7, -1, -1):
                bit = (data >> b) & 1
                pairs, gate = _inputs(model, salted, node, b)
                _, mixed = _predict(model, pairs, gate)
                refined, _, _ = _refined(model, gate, mixed)
                odds = (np.clip(mixed, -_LIMIT, _LIMIT) + refined) / 2
                inverse *= 1 + np.exp(odds * (1 - 2.0 * bit))
                node = node << np.uint32(1) | bit
            out[kind, at : at + len(part)] = np.bincount(token, -np.log(inverse)[where], len(part))
    return out


def _first_of_beginning(data: np.ndarray, token: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each symbol the first of the neighbouring tokens' symbols with the same beginning, itself included."""
    start = np.flatnonzero(place == 0)
    before = np.where(token > 0, start[np.maximum(token - 1, 0)] + place, 0)
    inside = (token > 0) & (before < start[token])
    same = inside & (data[np.where(inside, before, 0)] == data)
    # equal up to here: the count of equal symbols since the token's start is the place itself
    run = np.concatenate([[0], np.cumsum(same)])
    shared = same & (run[1:] - run[start[token]] == place + 1)
    order = np.argsort(place, kind="stable")
    new = ~shared[order]
    return order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))][np.argsort(order, kind="stable")]


def learnt_maps(evidence: np.ndarray) -> np.ndarray:
    """The maps, from what followed pairs of classes [context, bit, class of zeros, class of ones] over all training tokens."""
    maps = _first_maps()
    first = 1 / (1 + np.exp(-maps.astype(np.float64)))
    return _odds((evidence[:, 1] + PRIOR * first) / (evidence.sum(1) + PRIOR)).astype(np.float32)


def learn(counts: np.ndarray, maps: np.ndarray, words: Words, draws: np.ndarray, batch: int = 256, bits: tuple[int, ...] = TABLE_BITS) -> Model:
    """A model with these maps, and a start of the weights: online on drawn tokens [class, token], each without its own occurrence."""
    model = Model(counts, maps, np.full((_GATES, _N + 1), _FIRST_WEIGHT, np.float32), _first_refine(), bits)
    kinds, picked = np.nonzero(draws)
    order = np.random.default_rng(10).permutation(np.repeat(np.arange(len(kinds)), draws[kinds, picked]))
    if not len(order):
        return model

    squares = np.zeros(model.weights.shape)
    for at in range(0, len(order), batch):
        own = order[at : at + batch]
        data, token, _, context = symbols(words.take(picked[own]))
        context, node = _of_class(context, kinds[own][token]), np.ones(len(data), np.uint32)
        for b in range(7, -1, -1):
            bit = (data >> b) & 1
            pairs, gate = _inputs(model, context, node, b, bit)
            given, mixed = _predict(model, pairs, gate)
            error = bit - 1 / (1 + np.exp(-np.clip(mixed, -_LIMIT, _LIMIT)))
            for k in range(_N + 1):
                slope = np.bincount(gate, error * given[k], _GATES)
                squares[:, k] += slope**2
                model.weights[:, k] += (_RATE * slope / np.sqrt(squares[:, k] + 1)).astype(np.float32)
            node = node << np.uint32(1) | bit
    return model


@dataclass
class Sums:
    """Sums over bits at a model's weights, for each gate."""

    values: np.ndarray

    @classmethod
    def empty(cls) -> Sums:
        return cls(np.zeros((_GATES, 1 + (_N + 1) + (_N + 1) ** 2 + 2 * (_BUCKETS + 1))))

    @property
    def cost(self) -> np.ndarray:
        return self.values[:, 0]

    @property
    def slope(self) -> np.ndarray:  # down the cost
        return self.values[:, 1 : _N + 2]

    @property
    def curve(self) -> np.ndarray:
        return self.values[:, _N + 2 : _N + 2 + (_N + 1) ** 2].reshape(_GATES, _N + 1, _N + 1)

    @property
    def hits(self) -> np.ndarray:  # [gate, bit, bucket]
        return self.values[:, -2 * (_BUCKETS + 1) :].reshape(_GATES, 2, _BUCKETS + 1)


def add_bits(sums: Sums, model: Model, words: Words, weights: np.ndarray) -> None:
    """Add the bits of tokens with their occurrences [class, token], each predicted without its own occurrence."""
    for data, n, context in _occurrences(words, weights):
        node = np.ones(len(data), np.uint32)
        for b in range(7, -1, -1):
            bit = (data >> b) & 1
            pairs, gate = _inputs(model, context, node, b, bit)
            node = node << np.uint32(1) | bit
            given, mixed = _predict(model, pairs, gate)
            low, share = _buckets(mixed)
            given, mixed = given.astype(np.float64), mixed.astype(np.float64)
            small = np.exp(-np.abs(mixed))
            p = np.where(mixed > 0, 1, small) / (1 + small)
            cost, slope, curve = n * (np.log1p(small) + np.maximum(np.where(bit == 1, -mixed, mixed), 0)), n * (bit - p), n * p * (1 - p)
            bucket = (bit.astype(np.int64) * (_BUCKETS + 1)) + low
            order = np.argsort(gate.astype(np.uint8), kind="stable")
            ends = np.searchsorted(gate[order], np.arange(b, _GATES + 8, 8))
            for g, first, last in zip(range(b, _GATES, 8), ends[:-1], ends[1:], strict=True):
                if first == last:
                    continue
                own = order[first:last]
                x = given[:, own]
                sums.cost[g] += cost[own].sum()
                sums.slope[g] += x @ slope[own]
                sums.curve[g] += (x * curve[own]) @ x.T
                for at, part in ((0, 1 - share[own]), (1, share[own])):
                    sums.hits[g].reshape(-1)[:] += np.bincount(bucket[own] + at, n[own] * part, 2 * (_BUCKETS + 1))


def settle(model: Model, sums_of: Callable[[Model], Sums]) -> Model:
    """The model with the weights that cost all bits least, and the last map at these weights.

    sums_of: the sums over all training bits at a model's weights. Each gate's weights are a problem of their own, convex,
    and held with the strength of one observation at where they begin. Steps are bounded, and halved if they raise a
    gate's cost.
    """
    weights, before, lowest = model.weights.astype(np.float64), model.weights.astype(np.float64), np.full(_GATES, np.inf)
    for _ in range(ROUNDS):
        model = replace(model, weights=weights.astype(np.float32))
        sums, weights = sums_of(model), model.weights.astype(np.float64)
        away = weights - _FIRST_WEIGHT
        cost = sums.cost + (away**2).sum(1) / 2
        slope, total = sums.slope - away, max(cost.sum(), 1e-9)
        step = np.linalg.solve(sums.curve + np.eye(_N + 1), slope[:, :, None])[:, :, 0]
        step *= np.minimum(1, _STEP / np.maximum(np.abs(step).max(1, keepdims=True), _STEP))
        worse = cost > lowest
        if np.where(worse, cost - lowest, (slope * step).sum(1) / 2).sum() < SETTLED * total:
            break
        half = (weights + before) / 2
        before, lowest = np.where(worse[:, None], before, weights), np.where(worse, lowest, cost)
        weights = np.where(worse[:, None], half, weights + step)
    hits = sums.hits.transpose(1, 0, 2)
    first = 1 / (1 + np.exp(-_first_refine()))
    refine = np.clip(_odds(np.clip((hits[1] + PRIOR * first) / (hits.sum(0) + PRIOR), 1e-6, 1 - 1e-6)), -_LIMIT, _LIMIT)
    return replace(model, refine=refine.astype(np.float32))


def nearer(start: Model, words: Words, draws: np.ndarray) -> Model:
    """The start with the weights that cost the drawn tokens [class, token] least, and its own last map."""

    def sums_of(model: Model) -> Sums:
        sums = Sums.empty()
        add_bits(sums, model, words, draws)
        return sums

    return replace(settle(start, sums_of), refine=start.refine) if draws.any() else start


# Documents -----------------------------------------------------------------------------------------------------------


def held_out(doc_id="doc_id"):
    """Documents that nothing is learnt from: crc32 of the id as text, modulo 7, is 2. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


def _lowered(batch: pa.RecordBatch) -> pa.Array:
    return pc.ascii_lower(pc.fill_null(batch.column("text"), ""))


def _tokens(classes: int):
    """Distinct tokens of a batch with their occurrences in training documents of each class (0 if in others only)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", *(f"c{k}" for k in range(classes))]
        for batch in batches:
            words, number, bounds = split_words(_lowered(batch))
            kind = np.where(batch.column("held_out").to_numpy(zero_copy_only=False), -1, batch.column("class").to_numpy())
            of = np.repeat(kind, np.diff(bounds))
            n = [np.bincount(number[of == k], minlength=len(words))[words.length > 0] for k in range(classes)]
            used = words.take(np.flatnonzero(words.length > 0))
            offsets = pa.py_buffer(np.append(used.begin, len(used.data)).astype(np.int32).tobytes())
            token = pa.Array.from_buffers(pa.string(), len(used), [None, offsets, pa.py_buffer(used.data.tobytes())])
            yield pa.RecordBatch.from_arrays([token, *(pa.array(x, pa.int64()) for x in n)], names)
            yield pa.RecordBatch.from_arrays([pa.array([""], pa.string()), *(pa.array([int((kind == k).sum())], pa.int64()) for k in range(classes))], names)

    return run


def token_counts(docs: DataFrame, classes: int) -> DataFrame:
    """(token, c0, c1, ...) of all tokens of ``docs`` (text, held_out, class): occurrences in training documents of each
    class; the end is the empty token. They're in byte order, in ranges: neighbours share beginnings."""
    columns = [f"c{k}" for k in range(classes)]
    counted = docs.select("text", "held_out", "class").mapInArrow(tidy(_tokens(classes)), "token string, " + ", ".join(f"{c} long" for c in columns))
    summed = counted.groupBy("token").agg(*(F.sum(c).alias(c) for c in columns))
    return staged(summed.repartitionByRange(shuffle_partitions(docs.sparkSession), "token").sortWithinPartitions("token"), "tokens")


def _sum(columns: list[str]):
    return sum((F.col(c) for c in columns[1:]), F.col(columns[0]))


def _sum_bits(counts: Broadcast, model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = replace(model, counts=counts.value), Sums.empty()
        for batch in _joined(batches):
            add_bits(sums, own, Words.of(batch.column("token")), _counts(batch))
        flat = sums.values.reshape(-1)
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(flat[used])], ["at", "x"])

    return run


def train(tokens: DataFrame, total: int, classes: int, draws: int = DRAWS) -> tuple[Broadcast, Model]:
    """The tables of counts and the model (without them) of token counts (token, c0, c1, ...) that add up to ``total``.

    Everything is learnt from all tokens; ``draws`` of them give Newton's method a near start, which saves it rounds.
    """
    columns = [f"c{k}" for k in range(classes)]
    known = tokens.where(_sum(columns) > 0)
    counts, evidence, bits = count_tables(known)
    shared = tokens.sparkSession.sparkContext.broadcast(counts)  # tables of bounded size
    share = lambda c: F.pmod(F.xxhash64("token", F.lit(c)), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.select("token", *(F.floor(F.col(c) * (draws / max(total, 1)) + share(c)).cast("long").alias(c) for c in columns))
    drawn = drawn.where(_sum(columns) > 0).toArrow().sort_by("token").combine_chunks()  # about as many rows as draws at most
    token = drawn.column("token")
    words, times = Words.of(token.chunk(0) if token.num_chunks else pa.array([], pa.string())), _counts(drawn)
    start = nearer(learn(counts, learnt_maps(evidence), words, times, bits=bits), words, times)

    def sums_of(model: Model) -> Sums:
        sums = Sums.empty()
        added = known.mapInArrow(tidy(_sum_bits(shared, model)), "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
        sums.values.reshape(-1)[added.column("at").to_numpy()] = added.column("x").to_numpy()
        return sums

    start = replace(start, counts=None)
    return shared, settle(start, sums_of) if total else start


def _score_tokens(counts: Broadcast, model: Model, classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = replace(model, counts=counts.value)
        for batch in _joined(batches):
            words = Words.of(batch.column("token"))
            p = log_probabilities(own, words, classes) / np.log(10)
            columns = [pa.array(hash_words(words).view(np.int64)), pa.array(_counts(batch).sum(0)), *map(pa.array, p)]
            yield pa.RecordBatch.from_arrays(columns, ["h", "c", *(f"p{k}" for k in range(classes))])

    return run


_DOCUMENT = (
    "doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, counts double, contexts array<long>, phrases array<long>, own array<int>, "
    "spelled array<float>, tail_h array<long>, tail_at array<int>"
)
_SUMS = "doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, counts double, flags double, spelled array<double>, tail_h array<long>, tail_n array<int>, tail_spelled array<int>"


def _lists(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def _names(columns: str) -> list[str]:
    return [x.split()[0] for x in columns.split(", ")]


def _read_documents(head, end_c: int, end_p: list[float]):
    """Of each document: counts over its frequent tokens and its end, its phrases with their contexts, how often a training
    document has a context (at its first place; -1 at others, 0 in held-out documents), what spelling each phrase's
    frequent tokens takes in each class (with the end for the last phrase, which a document without words has too), and
    rare tokens with the phrase they're in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, c, p = head.value
        for batch in batches:
            words, number, bounds = split_words(_lowered(batch))
            hashes = hash_words(words)
            slot = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
            found = keys[slot] == hashes if len(keys) else np.zeros(len(hashes), bool)

            def of_tokens(of_word: np.ndarray) -> np.ndarray:
                value = np.zeros(len(hashes), of_word.dtype)
                value[found] = of_word[slot[found]]
                return value[number]

            total = lambda x, of_end: pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[bounds]) + of_end)
            n = np.diff(bounds)
            starts, ends, context, phrase = phrases.cut(hashes[number], bounds)
            size = np.diff(ends)
            spelled = np.zeros((len(end_p), len(starts)))
            for k, x in enumerate(p):
                if len(starts):
                    spelled[k] = np.add.reduceat(of_tokens(x), starts)
                    spelled[k, ends[1:][size > 0] - 1] += end_p[k]
            doc = np.repeat(np.arange(batch.num_rows), size)
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            order = np.lexsort((np.arange(len(context)), context, doc))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (doc[order][1:] != doc[order][:-1]) | (context[order][1:] != context[order][:-1])
            own = np.full(len(order), -1)
            own[order[fresh]] = np.where(held[doc[order[fresh]]], 0, np.diff(np.append(np.flatnonzero(fresh), len(order))))
            own[ends[:-1][size > 0]] = -1  # a first phrase has no context
            # documents without words have a phrase without words
            empty = size == 0
            per = np.where(empty, 1, size)
            at = np.cumsum(per) - per
            values = np.empty((int(per.sum()), len(end_p)))
            filled = spread(at[~empty], size[~empty])
            values[filled] = spelled.T
            values[at[empty]] = end_p
            context_of, phrase_of, own_of = np.zeros(len(values), np.uint64), np.zeros(len(values), np.uint64), np.full(len(values), -1)
            context_of[filled], phrase_of[filled], own_of[filled] = context, phrase, own
            rare = np.flatnonzero(~found[number])
            rare_doc = np.repeat(np.arange(batch.num_rows), n)[rare]
            rare_at = np.searchsorted(starts, rare, "right") - 1 - ends[rare_doc]
            rares = np.bincount(rare_doc, minlength=batch.num_rows)
            columns = [
                batch.column("doc_id"), batch.column("held_out"), pa.array(n + 1), total((words.length + 1)[number], 1),
                total(of_tokens((c > 0).astype(np.int64)), int(end_c > 0)), total(of_tokens(np.log10(c + 1.0)), np.log10(end_c + 1.0)),
                _lists(per, context_of.view(np.int64), pa.int64()), _lists(per, phrase_of.view(np.int64), pa.int64()), _lists(per, own_of, pa.int32()),
                _lists(per * len(end_p), values.ravel().astype(np.float32), pa.float32()),
                _lists(rares, hashes[number[rare]].view(np.int64), pa.int64()), _lists(rares, rare_at, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, _names(_DOCUMENT))

    return run


def _flat(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists (null: none), and the bounds of each row's."""
    lists = pc.fill_null(batch.column(column), pa.scalar([], batch.schema.field(column).type))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def _phrase_bits(batch: pa.RecordBatch) -> tuple[phrases.Bits, np.ndarray, np.ndarray]:
    """The predictions of a batch's phrases, which were hit, and the bounds of each document's."""
    context, bounds = _flat(batch, "contexts")
    n = len(context)
    candidate, times, total = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    places, rows = _flat(batch, "places")
    at = places + np.repeat(bounds[:-1], np.diff(rows))
    for column, out in (("candidates", candidate), ("times", times), ("totals", total)):
        out[at] = _flat(batch, column)[0].view(out.dtype)
    training = ~batch.column("held_out").to_numpy(zero_copy_only=False)
    bits, hit = phrases.predictions(bounds, context.view(np.uint64), _flat(batch, "phrases")[0].view(np.uint64), candidate, times, total, training)
    return bits, hit, bounds


def _count_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits, _, _ = _phrase_bits(batch)
        key, place = np.unique(phrases.combined(bits), return_inverse=True)
        n, came = np.bincount(place, minlength=len(key)), np.bincount(place, bits.came, len(key)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(came)], ["key", "n", "came"])


def _add_documents(model, classes: int):
    """Sums of each document: the cost of its phrase bits, what spelling its other phrases takes, and its rare tokens with
    their occurrences in all and in phrases that are spelled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, hit, bounds = _phrase_bits(batch)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            flags = np.bincount(doc[bits.phrase], model.value.costs(bits) / np.log(10), batch.num_rows)
            spelled = _flat(batch, "spelled")[0].reshape(-1, classes).astype(np.float64)
            spelled[hit] = 0
            sums = np.stack([np.bincount(doc, x, batch.num_rows) for x in spelled.T], axis=1)
            rare, rows = _flat(batch, "tail_h")
            own = np.repeat(np.arange(batch.num_rows), np.diff(rows))
            missed = ~hit[_flat(batch, "tail_at")[0] + bounds[:-1][own]] if len(rare) else np.zeros(0, bool)
            order = np.lexsort((rare, own))
            fresh = np.ones(len(rare), bool)
            fresh[1:] = (own[order][1:] != own[order][:-1]) | (rare[order][1:] != rare[order][:-1])
            first = np.flatnonzero(fresh)
            n = np.diff(np.append(first, len(rare)))
            of = np.add.reduceat(missed[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
            per = np.bincount(own[order[first]], minlength=batch.num_rows)
            columns = [batch.column(x) for x in _names(_DOCUMENT)[:6]]
            columns += [pa.array(flags, pa.float64()), _lists(np.full(batch.num_rows, classes), sums.ravel(), pa.float64())]
            columns += [_lists(per, rare[order[first]], pa.int64()), _lists(per, n, pa.int32()), _lists(per, of, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, _names(_SUMS))

    return run


def _predicted(read: DataFrame) -> tuple[DataFrame, phrases.Model]:
    """The documents as read, with the candidates of their contexts, and the model of phrases.

    Counts are added up by (context, phrase) and then by context. Each document asks for a context once; contexts that
    only the document itself has get no answer.
    """
    each = read.select("row", "held_out", F.posexplode(F.arrays_zip("contexts", "phrases", "own")).alias("at", "x")).select("row", "held_out", "at", F.col("x.contexts").alias("h"), F.col("x.phrases").alias("s"), F.col("x.own").alias("own"))
    follow = each.where("not held_out and at > 0").groupBy("h", "s").agg(F.count("*").alias("c"))
    known = follow.groupBy("h").agg(F.sum("c").alias("total"), F.max(F.struct("c", "s")).alias("top"))
    asked = each.where("own >= 0").select("row", "at", "h", "own")
    answers = asked.join(known, "h").where("total > own").groupBy("row").agg(F.collect_list(F.struct("at", F.col("top.s").alias("s"), F.col("top.c").alias("c"), "total")).alias("a"))
    whole = read.join(answers, "row", "left").select("*", F.col("a.at").alias("places"), F.col("a.s").alias("candidates"), F.col("a.c").alias("times"), F.col("a.total").alias("totals")).drop("a", "row")
    whole = staged(whole, "candidates")
    seen = whole.where("not held_out").mapInArrow(tidy(_count_bits), "key long, n long, came long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("came").alias("came"))
    table = seen.orderBy("key").toArrow()  # a row for each combination of evidence, of which there are a bounded number
    return whole, phrases.learn(*(table.column(x).to_numpy() for x in ("key", "n", "came")))


def _classes(docs: DataFrame, column: str | None) -> tuple[DataFrame, list[float]]:
    """``docs`` with its class number, and the share of training documents of each class. Values that few training
    documents have, and null, are one class; without such a column there is one class."""
    if column is None or column not in docs.columns:
        return docs.withColumn("class", F.lit(0)), [1.0]
    found = docs.where(~F.col("held_out")).groupBy(F.col(column).cast("string").alias("v")).agg(F.count("*").alias("n"))
    total = found.agg(F.sum("n")).first()[0] or 0
    rows = found.where(F.col("n") >= max(1.0, CLASS_SHARE * total)).where("v is not null").orderBy(F.desc("n"), "v").limit(CLASSES - 1).collect()
    kind = F.lit(len(rows))
    for k, r in enumerate(rows):
        kind = F.when(F.col(column).cast("string") == r.v, k).otherwise(kind)
    shares = [r.n / total for r in rows]
    rest = (total - sum(r.n for r in rows)) / total if total else 1.0
    if not rest:  # held-out documents may still have other values; their class is never used
        return docs.withColumn("class", F.least(F.coalesce(kind, F.lit(0)), F.lit(len(rows) - 1))), shares
    return docs.withColumn("class", F.coalesce(kind, F.lit(len(rows)))), [*shares, rest]


def score_documents(docs: DataFrame, class_column: str | None = "lang", draws: int = DRAWS, head_tokens: int = HEAD_TOKENS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Tokens are the text's words (anything but ASCII white space, with A-Z lower-cased) and one end; a null text has the
    end alone. base_score is the add-one unigram score and score the model's, both log10 of the probability of the
    token sequence, learnt from documents that aren't :func:`held_out`. Phrases of a training document are predicted by
    the other training documents and by what stands before them in the document, as those of any document; so texts
    that occur twice stand out. The class of a document is used only where it's learnt from. bits_per_byte spreads the
    score over the tokens' bytes with one more for each token. Repeated rows give repeated rows; an empty table gives an
    empty result; if all documents are held out, the model knows nothing and predicts bits by its start. Hashes of
    tokens, contexts and phrases have 64 bits.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    wanted = [class_column] if class_column and class_column in docs.columns else []
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(x).alias("__class") for x in wanted))
    plain, shares = _classes(plain.withColumn("held_out", held_out()), "__class")
    classes = range(len(shares))
    tokens = token_counts(plain, len(shares))
    c_all = _sum([f"c{k}" for k in classes])
    size = tokens.agg(F.coalesce(F.sum(c_all), F.lit(0)).alias("n"), F.count(F.when(c_all > 0, 1)).alias("v")).first()
    columns = [f"p{k}" for k in classes]
    with task_for_each_file(spark):
        counts, model = train(tokens, size.n, len(shares), draws)
        scored = staged(tokens.mapInArrow(tidy(_score_tokens(counts, model, len(shares))), "h long, c long, " + ", ".join(f"{x} double" for x in columns)), "scores")
    release(tokens)

    # the most frequent tokens, by classes of counts, as many as may be broadcast
    grade = F.floor(F.log2(F.col("c") + 1) * 8).cast("int")
    cut, held = None, 0
    for r in sorted(scored.groupBy(grade.alias("g")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.g):
        held += r.n
        if held > head_tokens:
            break
        cut = r.g
    top = (scored.where(grade >= cut) if cut is not None else scored.limit(0)).toArrow()
    keys, c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.argsort(keys)
    head = spark.sparkContext.broadcast((keys[order], c[order], [top.column(x).to_numpy()[order] for x in columns]))
    end = scored.where(F.col("h") == int(hash_words(Words.of(pa.array([""]))).view(np.int64)[0])).first()
    end_c, end_p = (end.c, [end[x] for x in columns]) if end else (0, [0.0 for _ in classes])

    read = plain.select("doc_id", "text", "held_out").mapInArrow(tidy(_read_documents(head, end_c, end_p)), _DOCUMENT)
    read = staged(read.withColumn("row", F.monotonically_increasing_id()), "documents")
    whole, known = _predicted(read)
    release(read)
    added = whole.mapInArrow(tidy(_add_documents(spark.sparkContext.broadcast(known), len(shares))), _SUMS)
    summed = staged(added.withColumn("row", F.monotonically_increasing_id()), "sums")
    release(whole)
    tail = F.explode(F.arrays_zip("tail_h", "tail_n", "tail_spelled")).alias("t")
    rest = summed.where(F.size("tail_h") > 0).select("row", tail).select("row", F.col("t.tail_h").alias("h"), F.col("t.tail_n").alias("n"), F.col("t.tail_spelled").alias("spelled"))
    rare = scored.where(grade < cut) if cut is not None else scored
    more = rest.join(rare, "h").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_counts"),
        *(F.sum(F.col("spelled") * F.col(x)).alias(f"more_{x}") for x in columns),
    )
    of_class = [F.lit(float(np.log10(share))) + F.col("spelled")[k] + F.coalesce(f"more_p{k}", F.lit(0.0)) for k, share in zip(classes, shares)]
    best = F.greatest(*of_class) if len(of_class) > 1 else of_class[0]
    rows = summed.join(more, "row", "left").withColumn("__best", best)
    score = F.col("flags") + F.col("__best") + F.log10(sum((F.pow(F.lit(10.0), x - F.col("__best")) for x in of_class), F.lit(0.0)))
    base = F.col("counts") + F.coalesce("more_counts", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(size.n + size.v + 1)))
    return rows.withColumn("score", score).select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(size.n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
        (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
