"""Token counts, token files and the BPE codec against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from martlake.llm import bpe, chunked, token_counts, token_files
from martlake.llm.common import stage_path
from martlake.llm.merges import byte_symbols

P = pytest.importorskip("public_tokenizers")
BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
PIECES = ["a", "the", "Tion", " ", " ", "  ", "\n", "\t", "'s", "12", "!!", "é", "À", "<|endoftext|>", "ж", "語", "'re", "\r", " ", "é", "x" * 70]


def some_texts():
    random.seed(3)
    return [None, "", " ", "\n", " \n", "a ", " a", "a  b", "x" * 5000, "the " * 40_000] + ["".join(random.choices(PIECES, k=random.randint(1, 40))) for _ in range(300)] * 2


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "z", 7) for i, t in zip(ids, texts)], "doc_id long, text string, part string, digest int")


def test_chunks_give_the_librarys_ids():
    texts = [t or "" for t in some_texts()]
    for path, kind in ((BYTE, "byte_level"), (WORD, "word_end")):
        encoder = chunked.TextEncoder(path, kind)
        assert encoder.merges.usable
        for batch in (texts, texts[:1], [], ["a"], [" "], [""], ["ж"]):
            ids, at = encoder.encode(pa.array(batch, pa.string()))
            want = [chunked.load(path).encode(t, add_special_tokens=False).ids for t in batch]
            for k, (t, x) in enumerate(zip(batch, want)):
                assert ids[at[k] : at[k + 1]].tolist() == x, t[:80]
            assert encoder.counts(pa.array(batch, pa.string())).tolist() == [len(x) for x in want]


def test_chunks_of_random_plain_texts():
    random.seed(8)
    alphabet = ["a", "B", "é", "×", "÷", "ß", "À", " ", " ", "\n", "\n", "\t", "'", "s", "re", "7", "42", ".", "--", "the", "x" * 120]
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 25))) for _ in range(6000)]
    for path, kind in ((BYTE, "byte_level"), (WORD, "word_end")):
        ids, at = chunked.TextEncoder(path, kind).encode(pa.array(texts))
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == chunked.load(path).encode(t, add_special_tokens=False).ids, t


def test_merges():
    random.seed(9)
    words = ["".join(random.choices("aab ceèrstn=\n", k=random.randint(1, 30))) for _ in range(3000)] + ["a" * 99, "=" * 64, " " * 50]
    for path in (BYTE, WORD):
        merges = chunked.merges(path)
        ids, at = merges.encode(*vars(chunked.Words.of(pa.array(words))).values())
        merge = chunked.load(path).model.tokenize
        symbols = byte_symbols()
        for k, w in enumerate(words):
            assert ids[at[k] : at[k + 1]].tolist() == [t.id for t in merge("".join(symbols[b] for b in w.encode()))], w


def test_counts(spark, tmp_path):
    texts, cache = some_texts(), str(tmp_path / "cache")
    want = sorted((i, len((t or "").encode()), n, n > 512) for i, t in enumerate(texts) for n in [len(chunked.load(BYTE).encode(t or "", add_special_tokens=False).ids)])
    docs = frame(spark, texts)
    assert sorted(map(tuple, token_counts.count_tokens(docs, BYTE, cache).collect())) == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for t in texts})
    assert sorted(map(tuple, token_counts.count_tokens(docs, BYTE, cache).collect())) == want
    assert spark.read.parquet(cache).count() == stored  # all were hits
    token_counts.count_tokens(frame(spark, ["a new text"]), BYTE, cache).collect()
    assert spark.read.parquet(cache).count() == stored + 1
    assert token_counts.count_tokens(docs.limit(0), BYTE).count() == 0
    assert sorted(x.n_tokens for x in token_counts.count_tokens(frame(spark, ["b", "b", None], [None, 4, 4]), BYTE).collect()) == [0, 1, 1]


@pytest.mark.parametrize("bits", [True, False])
@pytest.mark.parametrize("kind", ["<u2", "<u4"])
def test_planes_round_trip(bits, kind):
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 1000):
        ids = rng.integers(0, 60_000, n).astype(kind)
        planes = token_files.to_planes(ids, bits)
        assert (token_files.from_planes(planes, n, ids.itemsize * 8) == ids).all()


@pytest.mark.parametrize("block", [64, 1 << 16])
def test_files(spark, block):
    texts = some_texts()
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    path = stage_path(spark, "t")
    token_files.write_ids(frame(spark, texts, ids), path, WORD, block_ids=block)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_documents(spark, path).collect()}
    start = 0
    for i, t in sorted(zip(ids, texts)):
        own = [*chunked.load(WORD).encode(t or "", add_special_tokens=False).ids, 1]
        assert got[i] == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
    assert len(got) == len(texts)


def test_files_of_an_empty_table_and_repeated_ids(spark):
    path = stage_path(spark, "t")
    token_files.write_ids(frame(spark, ["a"]).limit(0), path, WORD)
    assert token_files.read_documents(spark, path).count() == 0
    path = stage_path(spark, "t")
    token_files.write_ids(frame(spark, ["b", "b", None, "c"], [5, 5, None, 1]), path, WORD)
    assert sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.read_documents(spark, path).collect()) == [(0, None, 1), (1, 1, 2), (3, 5, 2), (5, 5, 2)]


def test_lexicon():
    random.seed(5)
    words = {"".join(random.choices("abcé", k=random.randint(0, 7))).encode(): [random.randrange(9) for _ in range(random.randint(0, 4))] for _ in range(500)}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words.items()))
    find = lambda lexicon, x: lexicon.find(chunked.Words.of(pa.array([w.decode("latin-1") for w in x], pa.string()))).tolist()
    latin = {w.decode().encode("utf-8").decode("latin-1"): v for w, v in words.items()}
    lexicon = bpe.Lexicon(bpe.compile_lexicon((w.encode(), v) for w, v in latin.items()))
    for (w, ids), rank in zip(latin.items(), find(lexicon, words)):
        assert rank >= 0 and lexicon.ids[lexicon.offsets[rank] : lexicon.offsets[rank + 1]].tolist() == ids, w
    others = [w + b"z" for w in words] + [w[:-1] for w in words if w[:-1] not in words] + [b"\xff"] + [b""] * (b"" not in words)
    assert set(find(lexicon, others)) == {-1} and find(lexicon, []) == []
    assert len(lexicon.final) < sum(map(len, words))  # suffixes are shared
    assert find(bpe.Lexicon(bpe.compile_lexicon([])), [b"a", b""]) == [-1, -1]


def test_frequent_words(spark):
    docs = frame(spark, ["a b b c c c c c " + "d " * 30, None, "d", "a  b"])
    assert set(bpe.frequent_words(docs, BYTE, 10, 1)) == {"a", " b", " c", " d", " ", "d"}
    assert bpe.frequent_words(docs, BYTE, 1, 2) == [" d"] and sorted(bpe.frequent_words(docs, BYTE, 2, 5)) == [" c", " d"]
    assert bpe.frequent_words(docs, BYTE, 0, 1) == []


@pytest.mark.parametrize("words", [5, 1 << 16])
def test_codec(spark, words):
    texts, t = some_texts(), chunked.load(BYTE)
    got = {r.doc_id: r for r in bpe.round_trip(frame(spark, texts), BYTE, words).collect()}
    assert len(got) == len(texts)
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        want = len(ids), np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False).encode()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (want[0], *(hashlib.sha256(b).hexdigest() for b in want[1:]))
    encoded = bpe.encode_documents(frame(spark, texts), BYTE, words)
    assert {r.doc_id: r.text for r in bpe.decode_documents(encoded, BYTE).collect()} == {i: x or "" for i, x in enumerate(texts)}
    assert bpe.round_trip(frame(spark, ["a"]).limit(0), BYTE).count() == 0
