"""Substring deduplication against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from martlake.llm import substrings as s


def brute(texts, window):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def texts_of(seed, window):
    random.seed(seed)
    words = ["a", "b", "ç", "d\xa0d", "é"]
    run = lambda n: [random.choice(words) + str(random.randint(0, 99)) for _ in range(n)]
    passage, texts = run(window + 9), [None, "", " x\n", "w " * 5000]
    for _ in range(60):
        w = run(random.randint(0, 5 * window))
        if random.random() < 0.6:
            at, b = random.randint(0, len(w)), random.randint(0, 9)
            w[at:at] = passage[b : b + random.randint(window - 2, window + 9)]
        texts.append(random.choice([" ", "\n", " \t"]).join(w))
    texts += texts[10:20] + [" ".join((texts[20] or "").split()[3:] + ["end"]), " ".join(run(window) * 3)]
    return texts


@pytest.mark.parametrize("seed,window,rows", [(1, 35, 4000), (2, 7, 4000), (3, 8, 5), (4, 35, 3), (5, 2, 7)])
def test_remove_repeats(spark, monkeypatch, seed, window, rows):
    monkeypatch.setattr("martlake.llm.substrings.PART_DOCS", rows)
    texts = texts_of(seed, window)
    ids = [None if k % 11 == 10 else k // 2 for k in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, texts)], "doc_id long, text string, k1 int, runs string")
    want = sorted(str((i, *r)) for i, r in zip(ids, brute(texts, window)))
    assert sorted(str(tuple(r)) for r in s.remove_repeats(docs, window).collect()) == want


def test_repeated_rows_and_empty(spark):
    text = " ".join(map(str, range(50)))
    docs = spark.createDataFrame([(1, text), (1, text), (2, "short")], "doc_id long, text string")
    assert sorted(map(tuple, s.remove_repeats(docs).collect())) == [(1, 50, 50, ""), (1, 50, 50, ""), (2, 1, 0, "short")]
    assert [tuple(r) for r in s.remove_repeats(docs.limit(1)).collect()] == [(1, 50, 0, text)]
    assert s.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("line", ["w", "one short line"])
def test_long_texts_of_one_line(spark, line):
    n = 65_700
    docs = spark.createDataFrame([(1, " ".join([line] * n)), (2, "other " + " ".join(map(str, range(40))))], "doc_id long, text string")
    got = sorted(map(tuple, s.remove_repeats(docs).collect()))
    assert got[0] == (1, n * len(line.split()), n * len(line.split()), "") and got[1][2] == 0


def test_long_copies_in_one_partition(spark, monkeypatch):
    monkeypatch.setattr("martlake.llm.substrings.PART_DOCS", 1)
    before, text = spark.conf.get("spark.sql.shuffle.partitions"), " ".join(map(str, range(65_700)))
    docs = spark.createDataFrame([(1, text), (2, text + " end")], "doc_id long, text string")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert sorted(map(tuple, s.remove_repeats(docs).collect())) == [(1, 65_700, 65_700, ""), (2, 65_701, 65_700, "end")]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_hashes():
    texts = pa.array([" a bb  a\n", "", "bb a", "\t"])
    h, at = s.word_hashes(texts)
    assert at.tolist() == [0, 3, 3, 5, 5] and h[0] == h[2] == h[4] and h[1] == h[3] != h[0]
    two = s.run_hashes(h, 2)
    assert two[1] == two[3] and len(set(two.tolist())) == 2
    values = np.random.default_rng(1).integers(0, 99, 40)
    for n in (1, 2, 3, 7, 18):
        assert s._least_of(values, n).tolist() == [min(values[i : i + n]) for i in range(41 - n)]
    x = np.random.default_rng(2).integers(0, 1 << 32, 1000).astype("<u4")
    assert (s._unpack(s._pack(x), "<u4") == x).all() and (s._sorted_unpack(s._sorted_pack(x), "<u4") == np.sort(x)).all()
    assert len(s._sorted_unpack(s._sorted_pack(x[:0]), "<u4")) == 0
