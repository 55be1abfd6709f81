"""Contamination against a brute-force search for windows."""

import hashlib
import random
import re

import pytest

from martlake.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, window):
    rows = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for i, x in items:
            x = words(x)
            n = min(window, len(x))
            for k in range(len(x) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[k : k + n]:
                        hit.update(range(p, p + n))
                        found |= set() if i is None else {i}
        rows.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return rows


def case(seed):
    random.seed(seed)
    some = lambda n: [random.choice(["a", "B", "ça", "d4", "x-y", "Σ", "İ"]) for _ in range(n)]
    items = [(random.choice([None, 1, 2, 30, 4]), random.choice([" ", ", ", "\n"]).join(some(random.randint(0, 9)))) for _ in range(12)] + [(5, None), (6, ""), (30, "a B")]
    texts = [None, "", "!!!", "a" * 3000] + [" ".join(some(random.randint(0, 60))) for _ in range(30)] + [f"{x} foo {y}" for (_, x), (_, y) in zip(items, items[3:])] * 2
    return texts, items


def frames(spark, texts, items):
    docs = spark.createDataFrame([(i // 2, t, i, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, item_id int, digest double")
    return docs, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("seed,shard", [(1, 1 << 20), (2, 20), (3, 1 << 20)])
def test_contamination(spark, seed, shard):
    texts, items = case(seed)
    docs, bench = frames(spark, texts, items)
    want = sorted((i // 2, *r) for i, r in enumerate(brute(texts, items, 5)))
    assert sorted(map(tuple, d.contamination(docs, bench, 5, shard).collect())) == want
    assert sum(r[-1] for r in want) > 3


def test_empty_tables(spark):
    docs, bench = frames(spark, ["a b c", None], [(1, "a b c")])
    assert d.contamination(docs.limit(0), bench).count() == 0
    assert [r.n_hit for r in d.contamination(docs, bench.limit(0)).collect()] == [0, 0]
    assert d.decontaminate(docs, bench.limit(0)).collect() == docs.collect()


def cut(text, items, window):
    """The text without the words of any window, and the text itself if there is none."""
    w, hit = words(text), set()
    for _, x in items:
        x = words(x)
        n = min(window, len(x))
        for k in range(len(x) - n + 1 if n else 0):
            hit |= {q for p in range(len(w) - n + 1) if w[p : p + n] == x[k : k + n] for q in range(p, p + n)}
    spans, out, at = [m.span() for m in WORD_OF_TEXT.finditer(text)], "", 0
    for p in sorted(hit):
        first = p not in {q + 1 for q in hit}
        out += text[at : spans[p][0]] if first else ""
        at = spans[p][1]
    return out + text[at:]


WORD_OF_TEXT = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("shard", [1, 4, 20, 1 << 20])
def test_removal(spark, shard):
    """One answer whatever the shards: rows of one id, and of none, are judged by their own texts; cuts make no hits."""
    items = [(1, "One two, three"), (2, None), (3, "four five"), (4, "x four")]
    texts = ["x " * 200 + "one TWO three", "one-two three", None, "clean text", "four one two three five", "x one two three four", "clean text"]
    rows = [(i, t, k, k, "s") for k, (i, t) in enumerate([(0, texts[0]), (0, texts[1]), (None, texts[1]), (None, texts[3]), (7, None), *enumerate(texts), (0, texts[1])])]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string, item_id int, Spans int, hit_items string"), spark.createDataFrame(items, "item_id long, text string")
    judged = [r[-1] for r in brute([r[1] for r in rows], items, 3)]
    kept = d.decontaminate(docs, bench, window=3, shard_bytes=shard)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=lambda r: r[2]) == [r for r, bad in zip(rows, judged) if not bad] and 2 < sum(judged) < len(rows) - 2
    spans = sorted(d.decontaminate(docs, bench, "spans", 3, shard).collect(), key=lambda r: r.item_id)
    assert [r.text for r in spans] == [None if r[1] is None else cut(r[1], items, 3) for r in rows]
    with pytest.raises(ValueError):
        d.decontaminate(docs, bench, "all")


def test_a_hash_collision_is_verified():
    grams = d.ngrams([(1, "a b"), (2, "c d")], 2)
    hashes = grams.sets[2].hashes
    hashes[:] = hashes[0]
    grams.windows = lambda ids, n, f=grams.windows: (f(ids, n)[0], f(ids, n)[1] * 0 + hashes[0])
    assert d.scan(grams, ["a b x c d a c"]) == [(7, [(0, 2), (3, 5)], [1, 2])]
