"""SimHash near-duplicates through Golay-code fuzzy hashing.

Two fingerprints of 64 bits that differ in three bits at most are cut into three segments of 21, 21 and 22 bits. Two
of the segments then have one error at most. A segment, padded to 23 bits, is decoded by the perfect binary Golay code:
every word is within three errors of one codeword, and a word at exactly three is within four of five more. If two
segments differ in one bit at most, the nearest codeword of either is among the nearby codewords of the other. So a
fingerprint files itself, for each pair of segments, under (nearest of one, nearby of the other) and the reverse; any
two fingerprints in reach share such a key. Keys only nominate; the Hamming distance decides.

Texts that share eight tenths of their five-word shingles differ in about ten of 64 sign bits, beyond that reach. So
where documents are dropped, near copies of that likeness are linked as well: 20 tables, keyed by four minwise hashes of
the five-word shingles each, nominate them (a pair of likeness 0.8 misses all tables in 3 of 100 000 cases, wherever the
texts differ). Sketches of 256 one-bit minwise hashes drop nominations that are far off; what they leave is grouped, and within
the groups the sets of shingles decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlake.llm.chunked import spread
from martlake.llm.common import bounded_batches, fresh, shuffle_partitions, staged, tidy, whole_groups
from martlake.llm.substrings import _OUTER, _mixed, run_hashes, word_hashes

#: Words of a shingle, and the differing bits that still link.
SHINGLE, REACH = 3, 3
#: Fixed value: generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Five-word shingles, the likeness that links near copies, the sketch's bits, and how many more than expected may differ
#: (25 on top of 25: five standard deviations).
COPY_SHINGLE, COPY_LIKENESS, COPY_BITS, COPY_SPARE = 5, 0.8, 256, 25
#: Tables that nominate near copies, and the minwise hashes of a key: 1 - (1 - 0.8^4)^20 of pairs of 0.8 share a key.
COPY_TABLES, COPY_ROWS = 20, 4
#: (lowest bit, bits) of the segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Buckets up to this size compare all their pairs at once; larger ones grow components from member to member.
SMALL = 16
#: Links that a task holds before it folds them into stars, and bytes of shingles that a task compares others with.
FOLD, LEADER_BYTES = 1 << 20, 32 << 20


# Fingerprints --------------------------------------------------------------------------------------------------------


def fingerprints(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """The SimHash of each text as unsigned 64-bit integers; zero of a text without words.

    Words are runs of anything but ASCII white space, with A-Z lower-cased. The hash is XXH64 with seed 42 of the
    blank-joined shingles, repeats included; a text of fewer words is one shingle.
    """
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        n = len(words) - shingle + 1
        if n <= 1:
            hashes = [xxh64_intdigest(b" ".join(words), 42)]
        else:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            begins = [0, *ends[: n - 1].tolist()]
            hashes = [xxh64_intdigest(joined[b:e], 42) for b, e in zip(begins, (ends[shingle - 1 :] - 1).tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = bits.sum(0, dtype=np.int64) * 2 > len(hashes)
        out[k] = np.packbits(ones, bitorder="little").view("<u8")[0]
    return out


# Golay keys ----------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of single bits; for each syndrome the error of the nearest codeword, whether it has three bits, and
    the five errors of four bits."""
    bit = []
    for k in range(23):
        x = 1 << k
        for d in range(k, 10, -1):
            if x >> d & 1:
                x ^= GENERATOR << (d - 11)
        bit.append(x)
    nearest, three = np.zeros(2048, np.int64), np.zeros(2048, bool)
    four: list[list[int]] = [[] for _ in range(2048)]
    for weight in (1, 2, 3, 4):
        for places in combinations(range(23), weight):
            syndrome, error = 0, 0
            for p in places:
                syndrome ^= bit[p]
                error |= 1 << p
            if weight == 4:
                if three[syndrome]:
                    four[syndrome].append(error)
            else:
                nearest[syndrome] = error
                three[syndrome] = weight == 3
    others = np.zeros((2048, 5), np.int64)
    for s, errors in enumerate(four):
        others[s, : len(errors)] = errors
    return np.array(bit, np.int64), nearest, three, others


def codewords(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of 23-bit words: the index of the nearest codeword, and those of all nearby ones [word, 6] (-1 where absent)."""
    bit, nearest, three, others = _tables()
    syndrome = np.zeros(len(x), np.int64)
    for k in range(23):
        syndrome ^= np.where(x >> k & 1, bit[k], 0)
    best = (x ^ nearest[syndrome]) >> 11
    more = np.where(three[syndrome][:, None], (x[:, None] ^ others[syndrome]) >> 11, -1)
    return best, np.concatenate([best[:, None], more], axis=1)


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, key) for all keys of all fingerprints, each once."""
    prints = prints.astype(np.uint64)
    return segment_keys([(prints >> np.uint64(low) & np.uint64((1 << bits) - 1)).astype(np.int64) for low, bits in SEGMENTS])


def segment_keys(segments: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(index, key) for all keys of rows of segments of 23 bits at most."""
    parts = [codewords(x) for x in segments]
    out = []
    for p, (i, j) in enumerate(combinations(range(len(segments)), 2)):
        (near_i, all_i), (near_j, all_j) = parts[i], parts[j]
        out.append(np.where(all_j >= 0, p << 24 | near_i[:, None] << 12 | all_j, -1))
        out.append(np.where(all_i[:, 1:] >= 0, p << 24 | all_i[:, 1:] << 12 | near_j[:, None], -1))
    keys = np.concatenate(out, axis=1)
    row, column = np.nonzero(keys >= 0)
    return row, keys[row, column]


# Links ---------------------------------------------------------------------------------------------------------------


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of links (a, b) as stars around their least member: (member, least), without the least itself."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while True:  # halving the paths to the least member
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            break
        root = new
    member = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[member], nodes[root[member]]


def _grow(prints: np.ndarray, reach: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect all members of a large bucket that are in reach of each other, one for each member at most."""
    left, a, b = prints, [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= reach
            if near.any():
                found = left[near]
                a.append(np.full(len(found), x))
                b.append(found)
                front.extend(found)
                left = left[~near]
    return a, b


def bucket_links(keys: np.ndarray, prints: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect all fingerprints in reach of each other within their buckets."""
    order = np.lexsort((prints, keys))
    keys, prints = keys[order], prints[order]
    fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (prints[1:] != prints[:-1])])
    keys, prints = keys[fresh], prints[fresh]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    size = np.repeat(sizes, sizes)
    small = np.flatnonzero((size > 1) & (size <= SMALL))
    a, b = [], []
    k, p = keys[small], prints[small]
    for d in range(1, SMALL):
        if len(k) <= d:
            break
        ok = (k[d:] == k[:-d]) & (np.bitwise_count(p[d:] ^ p[:-d]) <= reach)
        a.append(p[:-d][ok])
        b.append(p[d:][ok])
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        x, y = _grow(prints[s : s + n], reach)
        a += x
        b += y
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return _forest(np.concatenate(a), np.concatenate(b))


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("fp").to_numpy(zero_copy_only=False)
        row, keys = keys_of(prints.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(prints[row], pa.int64())], ["key", "fp"])


def _folded(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) as the stars of their components, a bounded number at a time."""
    a, b, size = [], [], 0
    for x, y in parts:
        a.append(x)
        b.append(y)
        size += len(x)
        if size >= FOLD:
            star = _forest(np.concatenate(a), np.concatenate(b))
            a, b, size = [star[0]], [star[1]], len(star[0])
            if size >= FOLD // 2:
                yield _link_batch(*star)
                a, b, size = [], [], 0
    if size:
        yield _link_batch(*_forest(np.concatenate(a), np.concatenate(b)))


def _link_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def _link(reach: int):
    """Links of buckets that come one after the other."""

    def of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        keys, prints = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
        return bucket_links(keys, prints.view(np.uint64), reach)

    return lambda batches: _folded(map(of, whole_groups(batches, "key")))


def links(prints: DataFrame, reach: int = REACH) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp); their components are those of all pairs in reach."""
    if reach > REACH:
        raise ValueError(f"the keys cover {REACH} differing bits at most, not {reach}")
    n = shuffle_partitions(prints.sparkSession)
    filed = prints.mapInArrow(tidy(_file), "key int, fp long").repartition(n, "key").sortWithinPartitions("key")
    return filed.mapInArrow(tidy(_link(reach)), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the links; root is the same for all nodes of a component.

    The graph is contracted: each round every node points to the first of its neighbours and itself in a hashed order,
    and on to where that one points; links become those between the nodes pointed to, each once. A star or a clique is a
    single node after one round, long paths shrink by a constant factor, so rounds after the first are small. Tables
    are written, so a lost executor costs one step at most. Labels are composed at the end.
    """
    left = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))
        both = left.select(F.inline(ends))
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("x"))
        up = both.groupBy("node").agg(F.min(order("other")).alias("o")).select("node", F.least(order("node"), "o")["x"].alias("up"))
        top = up.select(F.col("node").alias("up"), F.col("up").alias("root"))
        steps.append(staged(up.join(top, "up").select("node", "root"), "labels"))
        of = lambda c: steps[-1].select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        moved = left.join(of("a"), "a").join(of("b"), "b").where("a_root <> b_root")
        left = staged(moved.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "links")
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps[0]
    for step in steps[1:]:
        found = found.join(step.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return found


def _prints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp) of rows (doc_id, text)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = fingerprints(batch.column("text").to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return docs.mapInArrow(tidy(run), "doc_id long, fp long")


def _groups(prints: DataFrame, reach: int) -> DataFrame:
    """(fp, root, first) of each distinct fingerprint of the rows (doc_id, fp); first is the least id of its class."""
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    found = components(links(distinct.select("fp"), reach))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    return staged(rooted, "roots")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, reach: int = REACH) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable).

    Equal fingerprints count once in the search, so exact copies never meet in pairs; classes of distinct fingerprints
    are joined to the rows at the end. Null and wordless texts have the fingerprint zero. Null ids don't count for
    component_id; it's null where a component has no other. Repeated rows give repeated rows.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = staged(_prints(plain, shingle), "documents")
    rooted = _groups(prints, reach)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = staged(rooted.join(least, "root").select("fp", "component_id"), "components")
    return prints.join(linked, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Near copies ---------------------------------------------------------------------------------------------------------


def _minwise(values: np.ndarray, starts: np.ndarray, seed: int, n: int, bits: int) -> np.ndarray:
    """``n`` minwise hashes of ``bits`` bits of sets of 32-bit values, one set after the other: [set, n]."""
    factors = np.random.default_rng(seed).integers(0, 1 << 31, n).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    out = np.empty((len(starts), n), np.uint8 if bits <= 8 else np.uint32)
    for k, a in enumerate(factors):
        least = np.minimum.reduceat(values * a, starts)
        least ^= least >> np.uint32(15)
        out[:, k] = (least * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits)
    return out


def copy_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with words: their places, the 64-bit hashes of their five-word shingles (repeats included; a text of
    fewer words is one shingle), one text after the other, and where each begins."""
    words, bounds = word_hashes(pc.ascii_lower(texts))
    sizes = np.diff(bounds)
    place = np.flatnonzero(sizes)
    n = np.maximum(sizes[place] - COPY_SHINGLE + 1, 1)
    first = np.cumsum(n) - n
    padded = np.concatenate([words, np.zeros(COPY_SHINGLE, np.uint64)])
    shingles = run_hashes(padded, COPY_SHINGLE, 2)[spread(bounds[place], n)]
    for k in np.flatnonzero(sizes[place] < COPY_SHINGLE).tolist():  # only the text's own words
        own = np.concatenate([words[bounds[place[k]] : bounds[place[k] + 1]], np.zeros(COPY_SHINGLE, np.uint64)])
        shingles[first[k]] = run_hashes(own[:COPY_SHINGLE], COPY_SHINGLE, 2)[0]
    return place, shingles, first


def copy_sketches(shingles: np.ndarray, first: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Of the five-word shingles of texts that begin at ``first``: the minwise hashes of 23 bits that make the keys, and
    the sketches (four 64-bit integers each)."""
    if not len(first):
        return [np.zeros(0, np.int64)] * (COPY_TABLES * COPY_ROWS), np.zeros((0, COPY_BITS // 64), np.uint64)
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    hashes = _minwise(values, first, 23, COPY_TABLES * COPY_ROWS, 23)
    sketch = np.packbits(_minwise(values, first, 5, COPY_BITS, 1), axis=1)
    return list(hashes.T.astype(np.int64)), np.ascontiguousarray(sketch).view(np.uint64)


def copy_keys(hashes: list[np.ndarray]) -> np.ndarray:
    """The key of each table from the minwise hashes of its own: [text, table]."""
    rows = np.stack(hashes, 1).astype(np.uint64).reshape(-1, COPY_TABLES, COPY_ROWS)
    keys = np.broadcast_to(np.arange(COPY_TABLES, dtype=np.uint64), rows.shape[:2])
    for k in range(COPY_ROWS):
        keys = _mixed(keys * np.uint64(_OUTER) + rows[:, :, k])
    return keys


def _far(sketches: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.bitwise_count(sketches ^ other).sum(-1, dtype=np.int64)


def sketch_links(keys: np.ndarray, nodes: np.ndarray, sketches: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect all nodes whose sketches differ in ``most`` bits at most within their buckets."""
    order = np.argsort(keys, kind="stable")
    keys, nodes, sketches = keys[order], nodes[order], sketches[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    size = np.repeat(sizes, sizes)
    small = np.flatnonzero((size > 1) & (size <= SMALL))
    a, b = [], []
    k, p, x = keys[small], nodes[small], sketches[small]
    for d in range(1, SMALL):
        same = np.flatnonzero(k[d:] == k[:-d])
        if not len(same):
            break
        same = same[_far(x[same + d], x[same]) <= most]
        a.append(p[same])
        b.append(p[same + d])
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        left = np.arange(s, s + n)
        while len(left):
            front, left = [left[0]], left[1:]
            while front and len(left):
                at = front.pop()
                near = _far(sketches[left], sketches[at]) <= most
                found, left = left[near], left[~near]
                a.append(np.full(len(found), nodes[at]))
                b.append(nodes[found])
                front.extend(found.tolist())
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return _forest(np.concatenate(a), np.concatenate(b))


def _print_and_sketch(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            prints = fingerprints(texts.to_pylist(), shingle)
            place, shingles, first = copy_shingles(texts)
            digests = np.zeros(batch.num_rows, np.uint64)  # equal of texts with the same shingles
            digests[place] = np.add.reduceat(_mixed(shingles), first) if len(place) else 0
            hashes, sketches = copy_sketches(shingles, first)
            words = np.zeros(batch.num_rows, object)
            words[:] = None
            for k, row in zip(place.tolist(), np.concatenate([copy_keys(hashes), sketches], axis=1)):
                words[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(prints.view(np.int64)), pa.array(digests.view(np.int64)), pa.array(words.tolist(), pa.binary())], ["doc_id", "k1", "k2", "fp", "digest", "sketch"])

    return run


def _file_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
        row = np.repeat(np.arange(len(rows)), COPY_TABLES)
        keys = np.ascontiguousarray(rows[:, :COPY_TABLES]).view(np.int64).ravel()
        sketch = pa.array([x.tobytes() for x in rows[:, COPY_TABLES:]], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("fp").take(pa.array(row)), sketch.take(pa.array(row))], ["key", "fp", "sketch"])


def _rows_of(column: pa.Array) -> np.ndarray:
    """Binary values of one length as rows of 64-bit integers."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _link_sketches(most: int):
    def of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        keys, nodes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
        return sketch_links(keys, nodes.view(np.uint64), _rows_of(batch.column("sketch")), most)

    return lambda batches: _folded(map(of, whole_groups(batches, "key")))


class Sets:
    """Sets of shingles (sorted, without repeats) with their nodes and sketches."""

    def __init__(self, nodes: np.ndarray, sketches: np.ndarray, sets: list[np.ndarray]):
        self.nodes, self.sketches, self.sets = nodes, sketches, sets
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))

    def alike(self, own: np.ndarray, sketch: np.ndarray, places: np.ndarray, most: int, likeness: float) -> np.ndarray:
        """Which of the sets at ``places`` are alike another by ``likeness`` or more. Those whose sketch differs in more
        than ``most`` bits aren't compared."""
        near = np.zeros(len(places), bool)
        maybe = np.flatnonzero(_far(self.sketches[places], sketch) <= most)
        for k in range(0, len(maybe), 1000):
            other = places[maybe[k : k + 1000]]
            values = np.concatenate([self.sets[x] for x in other.tolist()])
            hit = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
            shared = np.add.reduceat(hit, np.cumsum(self.sizes[other]) - self.sizes[other], dtype=np.int64)
            near[maybe[k : k + 1000]] = shared >= likeness * (len(own) + self.sizes[other] - shared) - 1e-9
        return near

    def links(self, most: int, likeness: float) -> tuple[np.ndarray, np.ndarray]:
        """Stars that connect all sets that are alike."""
        left, a, b = np.arange(len(self.sets)), [], []
        while len(left):
            front, left = [left[0]], left[1:]
            while front and len(left):
                at = front.pop()
                near = self.alike(self.sets[at], self.sketches[at], left, most, likeness)
                found, left = left[near], left[~near]
                a.append(np.full(len(found), self.nodes[at]))
                b.append(self.nodes[found])
                front.extend(found.tolist())
        if not a:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return _forest(np.concatenate(a), np.concatenate(b))

    def links_to(self, leaders: Sets, groups: np.ndarray, most: int, likeness: float) -> tuple[np.ndarray, np.ndarray]:
        """Links from leaders that connect each set to all groups of leaders that it's alike a member of."""
        own = np.full(len(self.sets), -1)
        groups, a, b = groups.copy(), [], []
        for k in range(len(leaders.sets)):
            other = np.flatnonzero(own != groups[k])
            found = other[self.alike(leaders.sets[k], leaders.sketches[k], other, most, likeness)]
            if len(found):
                a.append(np.full(len(found), leaders.nodes[k]))
                b.append(self.nodes[found])
                for joined in set(own[found].tolist()) - {-1}:
                    own[own == joined] = groups[k]
                    groups[groups == joined] = groups[k]
                own[found] = groups[k]
        return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place, shingles, first = copy_shingles(batch.column("text"))
        sets = [np.unique(x).tobytes() for x in np.split(shingles, first[1:])] if len(place) else []
        kept = batch.take(pa.array(place))
        size = pa.array(list(map(len, sets)), pa.int64())
        yield pa.RecordBatch.from_arrays([kept.column("root"), kept.column("fp"), kept.column("sketch"), pa.array(sets, pa.binary()), size], ["root", "fp", "sketch", "shingles", "bytes"])


def _verify(most: int, likeness: float):
    """Exact links of parts (root, part) that come one after the other, each with its leaders first."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, Sets]]:
        """Each part's leaders as one, then its others piece by piece."""
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("root", "part", "other", "fp", "sketch", "shingles")), strict=True):
                if held and (row[:3] != held[-1][:3] or held[-1][2] and len(held) >= 2000):
                    yield held[0][:2], bool(held[0][2]), of(held)
                    held = []
                held.append(row)
        if held:
            yield held[0][:2], bool(held[0][2]), of(held)

    def of(rows: list[tuple]) -> Sets:
        sketches = np.frombuffer(b"".join(r[4] for r in rows), np.uint64).reshape(len(rows), -1)
        return Sets(np.array([r[3] for r in rows], np.int64).view(np.uint64), sketches, [np.frombuffer(r[5], np.uint64) for r in rows])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        part, leaders, groups = None, None, None
        for own, other, sets in parts(batches):
            if not other:
                a, b = sets.links(most, likeness)
                part, leaders, star = own, sets, dict(zip(a.tolist(), b.tolist()))
                groups = np.unique([star.get(x, x) for x in sets.nodes.tolist()], return_inverse=True)[1]
                yield a, b
            elif own == part:
                yield sets.links_to(leaders, groups, most, likeness)

    return lambda batches: _folded(found(batches))


def exact_links(sets: DataFrame, most: int, likeness: float, leader_bytes: int = LEADER_BYTES) -> DataFrame:
    """Links (a, b) that connect all nodes of the same group whose sets are alike, of (root, fp, sketch, shingles, bytes).

    A group of up to ``leader_bytes`` is compared in one task. Of a larger one about so many bytes, drawn by a hash, are
    leaders; the group is dealt out in parts, each of which compares its members with all leaders. Rounds go on with
    members that were no leaders yet until all but the largest component were, so every pair is compared whose members
    may still be apart, and no task holds more than the leaders and one batch.
    """
    n = shuffle_partitions(sets.sparkSession)
    sizes = staged(sets.groupBy("root").agg(F.sum("bytes").alias("all")), "sizes").withColumn("parts", F.ceil(F.col("all") / leader_bytes))
    own = sets.join(sizes, "root")
    part = F.pmod(F.xxhash64("fp"), F.col("parts"))
    columns = ["root", "part", "other", "fp", "sketch", "shingles"]

    def compared(leaders: DataFrame, others: DataFrame | None) -> DataFrame:
        every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
        rows = leaders.withColumns({"part": F.explode(every), "other": F.lit(0)}).select(columns)
        if others is not None:
            rows = rows.union(others.withColumns({"part": part, "other": F.lit(1)}).select(columns))
        return rows.repartition(n, "root", "part").sortWithinPartitions("root", "part", "other").mapInArrow(tidy(_verify(most, likeness)), "a long, b long")

    small = compared(own.where("parts = 1"), None)
    if sizes.where("parts > 1").isEmpty():
        return small
    large = staged(own.where("parts > 1"), "large")
    links, left, turn = None, large.select("root", "fp", "bytes"), 0
    done = None
    while True:
        turn += 1
        open_bytes = left.groupBy("root").agg(F.sum("bytes").alias("open"))
        draw = F.pmod(F.xxhash64("fp", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
        leaders = staged(left.join(open_bytes, "root").where(draw < leader_bytes / F.col("open")).select("root", "fp").distinct(), "leaders")
        done = leaders if done is None else staged(done.union(leaders), "leaders")
        mine = large.join(leaders, ["root", "fp"], "left_semi")
        active = large.join(leaders.select("root").distinct(), "root", "left_semi")
        more = compared(mine, active.join(leaders, ["root", "fp"], "left_anti"))
        links = staged(more if links is None else links.union(more), "compared")
        tops = components(links)
        placed = staged(large.join(tops, F.col("fp") == F.col("node"), "left").select(large["root"], "fp", "bytes", F.coalesce(tops["root"], F.col("fp")).alias("top")), "placed")
        most_of = placed.groupBy("root", "top").agg(F.count("*").alias("n")).groupBy("root").agg(F.max(F.struct("n", "top")).alias("m")).select("root", F.col("m.top").alias("top"))
        left = staged(placed.join(most_of, ["root", "top"], "left_anti").join(done, ["root", "fp"], "left_anti").select("root", "fp", "bytes"), "left")
        if left.isEmpty():
            return small.union(links)


def copy_links(docs: DataFrame, rows: DataFrame, likeness: float = COPY_LIKENESS) -> DataFrame:
    """Links (a, b) between the fingerprints of near copies, of ``docs`` (k1, k2, text) and their ``rows`` (k1, k2, fp,
    digest, sketch).

    Nominations whose sketches aren't far off are joined to groups; the sets of shingles of a group's distinct members
    are compared then, and only pairs that share ``likeness`` or more of them are linked.
    """
    most = int(COPY_BITS * (1 - likeness) / 2) + COPY_SPARE
    distinct = rows.where("sketch is not null").select("fp", "sketch").distinct()
    n = shuffle_partitions(rows.sparkSession)
    filed = distinct.mapInArrow(tidy(_file_sketches), "key long, fp long, sketch binary").repartition(n, "key").sortWithinPartitions("key")
    groups = components(filed.mapInArrow(tidy(_link_sketches(most)), "a long, b long"))
    sketch = F.substring("sketch", 8 * COPY_TABLES + 1, COPY_BITS // 8)
    one = rows.where("sketch is not null").groupBy("fp", "digest").agg(F.min(F.struct("k1", "k2", sketch.alias("sketch"))).alias("k"))
    one = one.join(groups, F.col("fp") == F.col("node"))
    texts = docs.join(staged(one.select("root", "fp", "k.k1", "k.k2", "k.sketch"), "members"), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    sets = texts.select("root", "fp", "sketch", "text").mapInArrow(tidy(_shingle_sets), "root long, fp long, sketch binary, shingles binary, bytes long")
    return exact_links(staged(sets, "sets"), most, likeness)


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, reach: int = REACH, likeness: float = COPY_LIKENESS) -> DataFrame:
    """``docs`` with all columns, one document of each group: the one of least id (null last, then by fingerprint).

    Groups are the components of two kinds of links: fingerprints in reach, and near copies, whose five-word shingles
    are alike by ``likeness`` or more. Wordless texts are near each other only. Of rows that are equal in all but other
    columns any one stays. Null ids and texts are kept apart from others by their hashes; an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    text, own = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    k1, k2 = F.xxhash64(own, text), F.hash(text, own)
    plain = docs.select(own.alias("doc_id"), text.alias("text"), k1.alias("k1"), k2.alias("k2"))
    prints = staged(plain.mapInArrow(tidy(_print_and_sketch(shingle)), "doc_id long, k1 long, k2 int, fp long, digest long, sketch binary"), "documents")
    nodes = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("first"))
    found = components(links(nodes.select("fp"), reach).union(copy_links(plain, prints, likeness)))
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select(F.coalesce("root", "fp").alias("root"), "first")
    a, b, x, y = fresh(docs, "key_a", "key_b", "kept_a", "kept_b")
    kept = rooted.groupBy("root").agg(F.min("first").alias("k")).select(F.col("k.k1").alias(x), F.col("k.k2").alias(y))
    marked = docs.withColumns({a: k1, b: k2})
    one = marked.join(staged(kept, "kept"), (F.col(a) == F.col(x)) & (F.col(b) == F.col(y)), "left_semi")
    return one.dropDuplicates([a, b]).drop(a, b)
