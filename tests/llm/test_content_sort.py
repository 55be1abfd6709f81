"""Exact duplicates by sorted content against a dictionary of normalised texts."""

import hashlib
import random
import re

import pytest

from martlake.llm import content_sort as c


def expected(rows):
    """Of a group's rows, in the order of what stays, the first is kept."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[ \x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    out = []
    for k, found in groups.items():
        found.sort()
        keep = None if found[0][1] else found[0][2]
        out += [(None if null else i, keep, len(found), place == 0, hashlib.sha256(k.encode()).hexdigest()) for place, (_, null, i) in enumerate(found)]
    return sorted(map(str, out))


def rows_of(seed, copies):
    random.seed(seed)
    texts = [None, "", " \t\r\n", "a b", "ab", "a\x0bb ", "a\x85b", "é è", "éè", "x" * 70_000, "x" * 70_000 + " ", "p" * 80 + "1", "p" * 80 + "2", "p " * 80 + "1", "\x00", "語 語"]
    rows = [(k if k % 5 else None, t) for k, t in enumerate(texts * 2)]
    rows += [(1000 + k, "the hot text") for k in range(copies)] + [(5, "the hot  text")] * (copies // 4) + [(None, "thehottext")] * 3
    rows += [(3000 + k, "h o t " + " " * (k % 3)) for k in range(copies)]
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("share,least", [(0.25, 64), (0.25, 8), (0.01, 1)])
def test_against_a_dictionary(spark, monkeypatch, share, least):
    monkeypatch.setattr(c, "HOT_SHARE", share)
    monkeypatch.setattr(c, "HOT_ROWS", least)
    rows = rows_of(3, 300)
    docs = spark.createDataFrame([(i, t, 3, "x", "y") for i, t in rows], "doc_id long, text string, n_chars int, norm string, hash string").repartition(5)
    out = c.find_copies(docs)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(str(tuple(r)) for r in out.collect()) == expected(rows)


def test_hot_texts_are_dealt_out(spark):
    """A text with a third of all rows makes many runs; no partition holds most of its rows."""
    docs = spark.range(30_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'copy of one text' ELSE concat('text ', id) END AS text")
    text = c.normalised(docs.text)
    hot = c.hot_hashes(docs.selectExpr("xxhash64(replace(text, ' ', '')) AS hash"), 4).collect()
    assert len(hot) == 1 and hot[0].pieces == 6  # of 1875 rows each, a quarter of a partition's
    out = c.find_copies(docs).where("group_size > 1")
    assert out.count() == 10_000 and out.where("kept").count() == 1 and out.where("keep_id <> 0 OR group_size <> 10000").count() == 0
    assert docs.where(text == "").count() == 0


def test_drop_copies_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "u"), (2, "a  b", "v"), (2, "a  b", "v"), (3, None, "w"), (4, "", "z")], "doc_id long, text string, row string")
    out = c.drop_copies(docs)
    assert out.columns == docs.columns and sorted(tuple(r) for r in out.collect()) == [(2, "a  b", "v"), (3, None, "w")]
    assert c.drop_copies(docs.limit(0)).count() == 0


def test_native_and_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = c.find_copies(docs)
    assert out.count() == 0
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())
