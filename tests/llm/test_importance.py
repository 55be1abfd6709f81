"""Importance resampling against features that are put together and hashed one by one."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from martlake.llm import importance as m


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
    return words, [" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def brute(docs, target, percent):
    s, t = (Counter(bucket(f) for text in x for f in features(text)[1]) for x in ([d[1] for d in docs], target))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        words, fs = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= 20])
    fit = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted(str(tuple(r[:5])) for r in out)


def texts_of(seed, n):
    random.seed(seed)
    words = ["The", "a1", "Ünï", "ZZ", "日本", "x", "q-r", "É", "_", "don't", "\x00", "😀"]
    return [None, "", "...", "one", "One two", "a b c"] + [" ".join(random.choices(words, k=random.randint(0, 120))) for _ in range(n)]


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1 << 16])
@pytest.mark.parametrize("ngram", [1, 2, 3, 5])
def test_states_carry_over_pieces(piece, ngram):
    for text in texts_of(1, 20):
        words = m.words_of(text or "")
        got = np.concatenate([np.zeros(0, np.uint32), *m.emit_buckets(words, ngram, 10_000, piece)])
        want = [bucket(b" ".join(words[k : k + n]).decode()) for n in range(1, ngram + 1) for k in range(len(words) - n + 1)]
        assert sorted(got.tolist()) == sorted(want)


def test_words_are_those_of_the_pattern():
    text = "".join(map(chr, range(0x250))) + "AİKZ"
    assert [w.decode() for w in m.words_of(text)] == features(text)[0]


@pytest.mark.parametrize("percent", [5, 100])
def test_against_brute_force(spark, percent):
    texts = texts_of(2, 150)
    docs = list(enumerate(texts)) + [(None, texts[9]), (None, texts[9]), (12, texts[12]), (12, texts[12]), (-5, "w " * 40_000)]
    target = texts_of(5, 30) + ["w x y " * 50]
    frame = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in docs], "doc_id long, text string, score string, rank int, buckets int").repartition(3)
    out = m.resample(frame, spark.createDataFrame([(str(k), t) for k, t in enumerate(target)], "item_id string, text string"), percent)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {k for _, k in out.dtypes} == {"bigint"}
    assert sorted(str(tuple(r)) for r in out.collect()) == brute(docs, target, percent)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a " * 25), (2, None)], "doc_id long, text string")
    assert m.resample(none, some).count() == 0
    assert sorted(str(tuple(r)) for r in m.resample(some, none, 100).collect()) == brute([(1, "a " * 25), (2, None)], [], 100)
