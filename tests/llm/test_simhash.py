"""SimHash: fingerprints, Golay keys and components against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from xxhash import xxh64_intdigest

from martlake.llm import simhash as s


def brute_print(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    h = [xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints, reach=3):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted(root)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if bin(a ^ b).count("1") <= reach:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in prints}


def texts_of(seed):
    random.seed(seed)
    words = ["a", "Bee", "c\x0b", "é", "Ünd", "x" * 30, "q\xa0r"]
    base = [" ".join(random.choices(words, k=random.randint(0, 400))) for _ in range(40)]
    return [None, "", " \n", "one", "ONE two", "w " * 60_000] + base + [b + " tail" for b in base[:25]] + base[:5] * 3


def test_fingerprints():
    texts = texts_of(1)
    assert s.fingerprints(texts).tolist() == [brute_print(t) for t in texts]


def test_golay_decoding():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 20_000)
    best, near = s.codewords(x)
    _, _, three, _ = s._tables()
    assert three.sum() == 1771
    # one error never loses the nearest codeword
    y = x ^ (1 << rng.integers(0, 23, len(x)))
    assert (s.codewords(y)[1] == best[:, None]).any(1).all() and (near == s.codewords(y)[0][:, None]).any(1).all()


def test_keys_meet_within_reach():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 30_000, np.uint64) * np.uint64(2) + rng.integers(0, 2, 30_000, np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, len(b)).astype(np.uint64)
    keys = [{(int(r), int(k)) for r, k in zip(*s.keys_of(x))} for x in (a, b)]
    assert {r for r, _ in keys[0] & keys[1]} == set(range(len(a)))
    assert len(keys[0]) < 36 * len(a)


@pytest.mark.parametrize("small", [2, 16])
def test_bucket_links(monkeypatch, small):
    monkeypatch.setattr(s, "SMALL", small)
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 62, 5, np.uint64)
    prints = np.concatenate([centre, *(centre ^ (np.uint64(1) << rng.integers(0, 64, 5).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 5).astype(np.uint64)) for _ in range(30))])
    a, b = s.bucket_links(np.zeros(len(prints), np.int64), prints)
    got = dict(zip(a.tolist(), b.tolist()))
    assert {p: got.get(p, p) for p in prints.tolist()} == brute_classes(prints.tolist())


def clusters(seed, n):
    rng = np.random.default_rng(seed)
    out = [0, 1, 7, (1 << 64) - 1]
    for c in rng.integers(0, 1 << 63, n, np.uint64).tolist():
        out.append(c)
        for _ in range(rng.integers(0, 12)):  # chains, so that components are wider than the reach
            c ^= sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(1, 5)).tolist()))
            out.append(c)
    return sorted(set(out))


def test_components(spark):
    prints = clusters(4, 60)
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    got = {r.node: r.root for r in s.components(s.links(frame)).collect()}
    classes = brute_classes(prints)
    signed = lambda x: int(np.uint64(x).view(np.int64))
    seen = {}
    for p in prints:
        root = got.get(signed(p), signed(p))
        assert seen.setdefault(classes[p], root) == root
    assert len(set(seen.values())) == len(seen)
    with pytest.raises(ValueError):
        s.links(frame, 4)


def test_near_duplicates(spark):
    texts = texts_of(5)
    ids = [None if k % 17 == 16 else k // 2 for k in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, texts)], "doc_id long, text string, fp int, root string")
    prints = [brute_print(t) for t in texts]
    classes = brute_classes(prints)
    least = {}
    for i, p in zip(ids, prints):
        if i is not None:
            least[classes[p]] = min(i, least.get(classes[p], i))
    want = sorted(map(str, ((i, f"{p:016x}", least.get(classes[p])) for i, p in zip(ids, prints))))
    assert sorted(str(tuple(r)) for r in s.near_duplicates(docs).collect()) == want


def likeness(a, b, n=5):
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 0.0


def near_copies(seed, groups=25):
    random.seed(seed)
    word = lambda: "".join(random.choices(["th", "er", "on", "an", "re", "he", "in", "ed"], k=random.randint(1, 4)))
    texts, group = [], []
    for g in range(groups):
        base = [word() for _ in range(random.randint(40, 400))]
        for c in range(random.choice([1, 1, 2, 4])):
            own = list(base)
            for _ in range(0 if c == 0 else max(1, len(own) // 80)):
                own[random.randrange(len(own))] = word()
            texts.append(" ".join(own))
            group.append(g)
    return texts, group


def test_sketches_estimate_likeness():
    texts, _ = near_copies(1)
    texts += ["one two", "ONE two", "one", "", "a b c d e", "a b c d e f"]
    place, shingles, first = s.copy_shingles(pa.array(texts))
    segments, sketches = s.copy_sketches(shingles, first)
    assert place.tolist() == [k for k, t in enumerate(texts) if t] and all(len(x) == len(place) and x.max() < 1 << 23 for x in segments)
    at = {k: i for i, k in enumerate(place.tolist())}
    errors = [abs(likeness(texts[a], texts[b]) - (1 - 2 * int(s._far(sketches[at[a]], sketches[at[b]])) / s.COPY_BITS)) for a in at for b in at if a < b and likeness(texts[a], texts[b]) > 0.3]
    assert np.mean(errors) < 0.06 and int(s._far(sketches[at[len(texts) - 6]], sketches[at[len(texts) - 5]])) == 0


def passages(seed, pairs, low=0.8, high=0.84):
    """Pairs of texts of 60 to 600 words, likeness from ``low`` to ``high``: by turns a passage appended, one put in and
    one replaced by as many words."""
    random.seed(seed)
    word = lambda: "".join(random.choices(["th", "er", "on", "an", "re", "he", "in", "ed"], k=random.randint(2, 5)))
    out = []
    while len(out) < pairs:
        base = [word() for _ in range(random.randint(60, 600))]
        n = len(base)
        put, gone = ((n // 4, 0), (n // 4, 0), (n // 9, n // 9))[len(out) % 3]
        at = n if len(out) % 3 == 0 else random.randint(5, n - gone - 5)
        for cut in range(put):  # the longest passage that leaves the likeness asked for
            own = base[:at] + [word() for _ in range(put - cut)] + base[at + max(gone - cut, 0) :]
            if likeness(" ".join(base), " ".join(own)) >= low:
                break
        if low <= likeness(" ".join(base), " ".join(own)) <= high:
            out.append((" ".join(base), " ".join(own)))
    return out


def test_keys_nominate_passages():
    pairs = passages(6, 450)
    keys = [s.copy_keys(s.copy_sketches(*s.copy_shingles(pa.array([p[k] for p in pairs]))[1:])[0]) for k in (0, 1)]
    assert (keys[0] == keys[1]).any(1).all()


def test_only_copies_of_the_likeness_are_linked(spark):
    pairs = passages(7, 60, 0.8, 0.81) + passages(8, 60, 0.7, 0.799)
    texts = [t for p in pairs for t in p]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # no two are within the fingerprint's reach but those alike
    prints = s.fingerprints(texts)
    alike = [likeness(*p) >= 0.8 or int(np.bitwise_count(prints[2 * k] ^ prints[2 * k + 1])) <= s.REACH for k, p in enumerate(pairs)]
    want = [i for i in range(len(texts)) if i % 2 == 0 or not alike[i // 2]]
    assert 60 <= sum(alike) < 100 and sorted(r.doc_id for r in s.drop_near_duplicates(docs).collect()) == want


def test_sets_link():
    sets = [np.arange(k, k + 9, dtype=np.uint64) for k in (0, 1, 2, 30, 32)] + [np.arange(8, dtype=np.uint64)]
    far = np.zeros((len(sets), 4), np.uint64)
    a, b = s.Sets(np.arange(10, 16, dtype=np.uint64), far, sets).links(50, 0.8)
    assert sorted(zip(a.tolist(), b.tolist())) == [(11, 10), (12, 10), (15, 10)]
    assert len(s.Sets(np.arange(2, dtype=np.uint64), far[:2], [sets[0], sets[1]]).links(50, 0.81)[0]) == 0


def test_large_groups_are_dealt_out(spark):
    """Chains and loners of a group, compared by leaders in several parts and rounds: as by brute force."""
    rng = np.random.default_rng(3)
    sets = []
    for c in range(30):
        at = int(c * 1000)
        for _ in range(rng.integers(1, 25)):
            sets.append((c % 2, np.arange(at, at + 40, dtype=np.uint64)))
            at += int(rng.integers(1, 8))
    order = rng.permutation(len(sets))
    rows = [(sets[k][0], int(i), b"\0" * 32, sets[k][1].tobytes(), 320) for i, k in enumerate(order.tolist())]
    rows += [(7, 10_000, b"\0" * 32, sets[0][1].tobytes(), 320)]  # a small group
    frame = spark.createDataFrame(rows, "root long, fp long, sketch binary, shingles binary, bytes long")
    got = {r.node: r.root for r in s.components(s.exact_links(frame, 50, 0.8, 320 * 40)).collect()}
    root = list(range(len(order)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    own = [(g, set(v.tolist())) for g, v in (sets[k] for k in order.tolist())]
    for i, (g, x) in enumerate(own):
        for j in range(i):
            if g == own[j][0] and len(x & own[j][1]) >= 0.8 * len(x | own[j][1]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    classes = {}
    for i in range(len(order)):
        assert classes.setdefault(find(i), got.get(i, i)) == got.get(i, i)
    assert len(set(classes.values())) == len(classes) > 60 and 10_000 not in got


def test_components_of_a_large_group(spark, monkeypatch):
    """1000 near copies met in buckets of 64 tasks: the links that are joined stay few for each member."""
    rng = np.random.default_rng(4)
    prints = np.full(1000, 0x0123456789ABCDEF, np.uint64)
    for _ in range(2):
        prints ^= np.uint64(1) << rng.integers(0, 64, len(prints)).astype(np.uint64)
    prints = np.unique(np.concatenate([prints, rng.integers(0, 1 << 63, 50, np.uint64)]))
    joined, inner = [], s.staged

    def counted(df, name):
        out = inner(df, name)
        joined.append(out.count() if name == "links" else 0)
        return out

    monkeypatch.setattr(s, "staged", counted)
    monkeypatch.setattr(s, "shuffle_partitions", lambda spark: 64)
    frame = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    got = {int(np.int64(r.node).view(np.uint64)): r.root for r in s.components(s.links(frame)).collect()}
    classes, roots = brute_classes(prints.tolist()), {}
    for p in prints.tolist():
        if p in got:
            assert roots.setdefault(classes[p], got[p]) == got[p]
    assert len(set(roots.values())) == len(roots) and len(got) == sum(list(classes.values()).count(c) for c in roots)
    assert sum(joined) < 10 * len(got)


def test_paths(spark):
    """A path in order of its nodes is contracted in few rounds, links to itself don't count."""
    frame = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1000), (2000, 2001)], "a long, b long")
    got = {r.node: r.root for r in s.components(frame).collect()}
    assert set(got) == set(range(301)) | {2000, 2001} and len({got[k] for k in range(301)}) == 1 and got[2000] == got[2001] != got[0]


@pytest.mark.parametrize("small", [1, 16])
def test_drop_near_duplicates(spark, monkeypatch, small):
    monkeypatch.setattr(s, "SMALL", small)
    texts, group = near_copies(2)
    rows = [(100 + k, t, g) for k, (t, g) in enumerate(zip(texts, group))]
    rows += [(500 + k, texts[k], group[k]) for k in range(0, len(texts), 3)] + [(None, texts[0], group[0]), (7, None, -1), (8, "", -1), (9, " ", -1), (100, texts[0], group[0]), (3, "only one", -2)]
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], "doc_id long, text string, fp int, k1 string, root int, key_a int, Key_B int, kept_a int")
    kept = s.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    out = kept.collect()
    assert sorted(r.fp for r in out) == sorted(set(group) | {-1, -2})
    least = {}
    for i, _, g in rows:
        if i is not None:
            least[g] = min(i, least.get(g, i))
    assert all(r.doc_id == least[r.fp] for r in out)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert s.near_duplicates(docs).count() == 0 and s.drop_near_duplicates(docs).count() == 0
