"""Order MinHash against a Python version of the same fingerprint, and its sensitivity to order."""

import hashlib
import random
import re
import struct

import pytest
from xxhash import xxh64_intdigest

from martlake.llm import order_minhash as o


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chain(seed, values):
    """Spark's xxhash64 of several longs: each is hashed with the hash before as the seed."""
    for v in values:
        seed = xxh64_intdigest(struct.pack("<q", signed(v % (1 << 64))), seed)
    return seed


def brute(text, shingle=3):
    words = [xxh64_intdigest(w.encode(), 42) for w in re.split("[ \x09-\x0d]+", text or "") if w]
    if not words:
        return []
    kmers = [tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    seen, bins = {}, {}
    for p, k in enumerate(kmers):
        h = chain(42, k)
        number = seen[k] = seen.get(k, -1) + 1
        g = xxh64_intdigest(struct.pack("<i", number), xxh64_intdigest(struct.pack("<q", signed(h)), 42))
        bins.setdefault(g >> 58, []).append((signed(g), p))
    out = []
    for b in sorted(bins, key=lambda b: b):
        two = sorted(sorted(bins[b])[:2], key=lambda x: x[1])
        out.append(b << 18 | chain(42, [g for g, _ in two]) >> 46)
    return out


def near(a, b):
    either = {x >> 18 for x in a} | {x >> 18 for x in b}
    return len(set(a) & set(b)) / len(either) if either else 1.0


def hexes(entries):
    return "".join(f"{x:06x}" for x in entries)


def texts_of(seed):
    random.seed(seed)
    words = ["a", "bee", "ç", "d d", "É", "x\n", "\t", "語語"]
    return [None, "", " ", "one", "one two", "a b c", "w " * 3000] + [" ".join(random.choices(words, k=random.randint(0, 300))) for _ in range(40)]


def test_entries(spark):
    texts = texts_of(1)
    df = o.with_entries(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string"), "t", "e")
    for r in df.collect():
        assert r.e == brute(r.t), r.t
    assert df.columns == ["k", "t", "e"]


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_edit_sensitivity(spark, monkeypatch, ranges):
    monkeypatch.setattr(o, "RANGES", ranges)
    texts = texts_of(2)
    ids = [(7 * k) % 1000 - 20 for k in range(len(texts))]
    ids[5], ids[6], ids[9] = None, ids[10], ids[11]
    rows = list(zip(ids, texts)) + [(5, "x y z"), (5, "x y z"), (5, "x y z")]
    docs = spark.createDataFrame([(i, t, 3, "r") for i, t in rows], "doc_id long, text string, n_chars int, entries string")
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = []
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        a, b = brute(t), brute(edited)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexes(a), hexes(b), near(a, b), near(a, brute(u))))
    assert sorted(map(str, (tuple(r) for r in o.edit_sensitivity(docs).collect()))) == sorted(map(str, want))


def test_order_and_repeats_count():
    random.seed(6)
    words = [f"w{k}" for k in range(400)]
    text, halves = " ".join(words), " ".join(words[200:] + words[:200])
    few = words[:]
    few[100] = "new"
    assert near(brute(text), brute(text)) == 1
    assert near(brute(text), brute(" ".join(few))) > 0.8 > near(brute(text), brute(halves)) > 0.2  # same k-mers but for the seams
    assert near(brute(text), brute(text + " " + text)) < 0.8


def test_small_tables(spark):
    docs = spark.createDataFrame([(4, "a b c d")], "doc_id long, text string")
    (r,) = o.edit_sensitivity(docs).collect()
    assert r.edited_sha256 == hashlib.sha256(b"a ba b").hexdigest() or r.n_chars == 7
    assert r.near_next == 1.0 and r.fingerprint == o.fingerprints(docs).first().fingerprint
    assert o.edit_sensitivity(docs.limit(0)).count() == 0
    plan = o.edit_sensitivity(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
