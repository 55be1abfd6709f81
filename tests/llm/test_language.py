"""Language identification: the path against brute force, and accuracy on held-out documents."""

import itertools
import os
import random
import zlib

import numpy as np
import pytest

from martlake.llm import language as l


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    sizes = [0, 3, 5, 1, 0, 5, 2]
    scores = rng.normal(0, 3, (sum(sizes), 3)).astype(np.float32)
    labels, at = l.viterbi(scores, sizes, 2.0), 0
    for n in sizes:
        own = scores[at : at + n].astype(float)
        cost = lambda p: sum(own[t, k] for t, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        if n:
            assert abs(cost(labels[at : at + n].tolist()) - max(map(cost, itertools.product(range(3), repeat=n)))) < 1e-6
        at += n


def test_grams_stay_inside_their_word():
    whole = l._grams(["ab", "c", "über"])
    parts = [l._grams([w]) for w in ("ab", "c", "über")]
    assert whole[0].tolist() == [s for p in parts for s in p[0].tolist()]
    assert np.diff([*whole[1], len(whole[0])]).tolist() == [len(p[0]) for p in parts]


def corpus():
    random.seed(4)
    stems = {"aa": "ka lo mi tu", "bb": "sch ung ein st", "ru": "ва но ми ть"}
    text = lambda k: " ".join("".join(random.choices(stems[k].split(), k=random.randint(1, 4))) for _ in range(random.randint(3, 60)))
    rows = [(i, text(k), k) for i, k in enumerate(random.choices(list(stems), k=240))]
    return rows, text


def test_identify(spark):
    rows, text = corpus()
    more = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 !? ½", "bb"), (1003, text("aa") * 3 + " " + text("bb"), None), (None, text("ru"), "ru"), (1004, "漢字", "ru"), (1006, "m²", None), (1007, "50 km², CO₂", None), (1008, "½ ² ₂ Ⅷ 5", "aa"), (1005, "kalo mitu lolo tumika " * 10_000, None)]
    docs = spark.createDataFrame([(*r, "x", 2.0) for r in rows + more + more], "doc_id long, text string, lang string, lang_pred string, score double")
    model = l.train(docs)
    got = l.identify(docs, model)
    out = {}
    for r in got.collect():
        assert out.setdefault(r.doc_id, r) == r  # repeated rows have the same result
    assert got.count() == len(rows) + 2 * len(more)
    assert all((out[i].lang_pred, out[i].score, out[i].spans) == ("und", 0.0, []) for i in (1000, 1001, 1002, 1008))
    assert all(out[i].lang_pred in model.languages and out[i].spans[0].words == n for i, n in ((1006, 1), (1007, 2)))
    assert [s.lang for s in out[1003].spans] == ["aa", "bb"] and out[1003].lang_pred == "aa" and 0.5 < out[1003].score < 1
    assert out[1005].lang_pred == "aa" and out[None].lang_pred == "ru" and out[1004].lang_pred in model.languages
    held = [(i, k) for i, _, k in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 30 and all(out[i].lang_pred == k for i, k in held)
    assert {r.doc_id for r in docs.where(l.held_out()).collect()} >= {i for i, _ in held}
    kept = l.keep_identified(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(out) - {1000, 1001, 1002, 1008}


def test_nothing_is_learnt_from_held_out_documents(spark):
    rows, _ = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    other = docs.select("doc_id", l.F.when(l.held_out(), "zz zz").otherwise(l.F.col("text")).alias("text"), l.F.when(l.held_out(), "q").otherwise(l.F.col("lang")).alias("lang"))
    a, b = l.train(docs), l.train(other)
    assert a.languages == b.languages and (a.scores == b.scores).all()
    small = l.train(docs, 20)
    assert small.languages == a.languages and not (small.scores == a.scores).all()


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    model = l.train(docs)
    assert [tuple(r) for r in l.identify(docs, model).collect()] == [(1, "und", 0.0, [])]
    assert l.identify(docs.limit(0), model).count() == 0
    assert l.keep_identified(docs, model).count() == 1


def test_every_label_is_learnt(spark):
    """Labels beside a language change nothing in how many slots it has."""
    rows, _ = corpus()
    docs = spark.createDataFrame([(i, t, f"{k}{i % 100}") for i, t, k in rows] + [(5000 + k, f"word{k}", f"x{k:03}") for k in range(400)], "doc_id long, text string, lang string")
    model = l.train(docs)
    learnt = {r.lang for r in docs.where(~l.held_out()).select("lang").distinct().collect()}
    assert len(learnt) > 400 and set(model.languages) == learnt and model.scores.shape == (1 << 18, len(learnt))
    assert l.identify(docs, model).where("lang_pred = 'und'").count() == 0 and l.slot_bits(1024) == 18 and l.slot_bits(1025) == 17


def test_accuracy_on_documents(spark):
    """At least 97 of 100 held-out documents of the tables that have a label."""
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no tables")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and text rlike '[a-z]'")
    right = [r.lang == r.lang_pred for r in l.identify(docs, l.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(l.held_out()).collect()]
    assert len(right) > 200 and sum(right) >= 0.97 * len(right)
