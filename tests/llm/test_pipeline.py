"""The pipeline: what each stage keeps, and the result against the tokenizers library."""

import random

import numpy as np
import pytest

import corpus_pipeline as c
from martlake.llm import chunked, language, queries
from martlake.llm.common import staged


def corpus(spark, folder):
    random.seed(21)
    stems = {"aa": "ka lo mi tu ra ne", "bb": "sch ung ein st erz wo"}
    text = lambda k, n: " ".join("".join(random.choices(stems[k].split(), k=random.randint(1, 4))) for _ in range(n))
    rows = [(i, text(k, random.randint(60, 200)), k) for i, k in enumerate(random.choices(list(stems), k=120))]
    items = [(k, text("aa", 30)) for k in range(3)]
    near = rows[5][1].split()
    near[20] = "other"
    rows += [(200, rows[3][1], "aa"), (201, " ".join(near), "aa"), (202, None, "aa"), (203, "12 !!", "bb"), (204, items[1][1] + " " + text("aa", 20), "aa"), (205, text("bb", 70) + " 4223782374973051 x@y.example.com", None), (None, text("bb", 66), "bb"), (3, rows[3][1], "aa")]
    docs = spark.createDataFrame([(i, t, k, "s", None if t is None else len(t)) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows


def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    rows = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = {i for i, _, _ in rows}
    gone = [{202, 203}, {200, 201}, {204}, set()]
    for (_, stage), lost in zip(c.STAGES[:-1], gone):
        columns = docs.columns
        docs = staged(stage(spark, docs, str(tmp_path)), "stage")
        ids -= lost
        assert docs.columns == columns and {r.doc_id for r in docs.collect()} == ids
    assert docs.count() == len(ids)
    kept = {r.doc_id: r for r in docs.collect()}
    assert "4223782374973051" not in kept[205].text and kept[205].n_chars == len(kept[205].text)
    assert all(kept[i].text == t for i, t, _ in rows[:120] if i in kept)
    tokenizer = chunked.load(queries.tokenizer("byte_bpe_50k.json"))
    out = {r.doc_id: r for r in c.run(spark, str(tmp_path)).collect()}
    assert set(out) == ids
    for i, r in out.items():
        assert np.frombuffer(r.ids, "<u4").tolist() == tokenizer.encode(kept[i].text, add_special_tokens=False).ids
        assert r.text == kept[i].text and r.n_tokens == len(r.ids) // 4


def test_an_empty_corpus(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0
    assert language.held_out() is not None and 4 <= len(c.STAGES) <= 5 and c.ORACLE_SQL is None
