"""Language identification: script ranges narrow the candidates, a Viterbi path over word scores labels spans.

A word's score for a language is the summed log-likelihood of its character n-grams (one to four characters, with word
borders), hashed into a table of fixed size. A path over a text's words pays a penalty for each switch of language, so
single foreign words don't break a span but longer passages do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlake.llm.common import bounded_batches, tidy

#: Rows with text, for each language, that the n-gram counts are fitted on: all if there are fewer, else about so many
#: chosen by a hash of the id. It bounds the fit, not what is predicted.
TRAIN_DOCS = 4000
#: Bits of a slot's number in the hashed n-gram table, and the longest n-gram.
SLOT_BITS, ORDERS = 18, 4
#: Bits of (slot, language) that the broadcast table has at most, two bytes each: with over 1024 languages there are
#: fewer slots, and still all languages.
TABLE_BITS = 28
#: Log-likelihood that a switch of language costs.
SWITCH = 12.0
#: What a language that doesn't use a word's script loses against the others, for each of the word's n-grams.
OFF_SCRIPT = 20.0

#: First code points of blocks of letters and the script that begins there, from the Unicode block list.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Nko"),
    (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1780, "Khmer"),
    (0x1800, "Mongolian"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"),
    (0x2C80, "Coptic"), (0x2D00, "Georgian"), (0x2D30, "Tifinagh"), (0x2E80, "Han"), (0x3040, "Hiragana"),
    (0x30A0, "Katakana"), (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3190, "Han"), (0xA000, "Yi"),
    (0xA4D0, "Other"), (0xA640, "Cyrillic"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"),
    (0xD7B0, "Hangul"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Katakana"),
    (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"),
]
_FIRST = np.array([x for x, _ in SCRIPTS])
_NAMES = sorted({x for _, x in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(x) for _, x in SCRIPTS], np.int8)

_WORD = re.compile(r"[^\W\d_]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    """Languages in order, their scores of each slot, and which scripts each of them uses."""

    languages: list[str]
    scores: np.ndarray  # float16 [slot, language]
    scripts: np.ndarray  # bool [script, language]


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; superscripts, fractions and the like are none."""
    words = _WORD.findall((text or "").lower())
    if all(map(str.isalpha, words)):
        return words
    return [own for w in words for own in (w if w.isalpha() else "".join(c if c.isalpha() else " " for c in w)).split()]


def slot_bits(languages: int) -> int:
    return min(SLOT_BITS, TABLE_BITS - max(0, languages - 1).bit_length())


def _grams(words: list[str], bits: int = SLOT_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the n-grams of all words, the first slot of each word, and the script of each word's first letter."""
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    border = codes == 32
    n = len(codes)
    inner = np.cumsum(border)  # n-grams lie between two borders, these included
    code, slots, words_at = np.zeros(n, np.uint64), [], []
    for k in range(ORDERS):
        code = (code[: n - k] * _MULTIPLIER + codes[k:] + np.uint64(k + 1)) * _MULTIPLIER
        at = np.arange(n - k)
        first = inner[at] - 1  # the word that a gram beginning here belongs to, if it doesn't cross a border inside
        ok = inner[at + k] - border[at + k] == inner[at]
        if k == 0:
            ok &= ~border
        slots.append((code[ok] >> np.uint64(64 - bits)).astype(np.int64))
        words_at.append(first[ok])
    slots, words_at = np.concatenate(slots), np.concatenate(words_at)
    order = np.argsort(words_at, kind="stable")
    starts = np.searchsorted(words_at[order], np.arange(len(words)))
    letter = np.flatnonzero(border)[:-1] + 1
    return slots[order], starts, _SCRIPT[np.searchsorted(_FIRST, codes[letter].astype(np.int64), "right") - 1]


def word_scores(model: Model, words: list[str]) -> np.ndarray:
    """Scores [word, language]; a script that no language uses says nothing."""
    if not words:
        return np.zeros((0, len(model.languages)), np.float32)
    part = max(64, PART_SCORES // len(model.languages))
    if len(words) > part:
        return np.concatenate([word_scores(model, words[k : k + part]) for k in range(0, len(words), part)])
    slots, starts, script = _grams(words, slot_bits(len(model.languages)))
    out = np.add.reduceat(model.scores[slots].astype(np.float32), starts, axis=0)
    uses = model.scripts[script]
    known = uses.any(1)
    out[~known] = 0
    sizes = np.diff(np.append(starts, len(slots))).astype(np.float32)
    return out - (~uses & known[:, None]) * (OFF_SCRIPT * sizes)[:, None]


def viterbi(scores: np.ndarray, sizes: list[int], switch: float = SWITCH) -> np.ndarray:
    """The best language of each word; the words of all texts come one after the other and advance side by side."""
    sizes = np.array(sizes, np.int64)
    first = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    longest = sizes[order]
    labels, came = np.zeros(len(scores), np.int16), np.zeros(scores.shape, np.int16)
    if not len(scores):
        return labels
    live = np.searchsorted(-longest, -np.arange(longest[0]), "left")  # texts with more than t words
    begin, own = first[order], np.arange(scores.shape[1], dtype=np.int16)
    best = scores[begin[: live[0]]].astype(np.float64)
    ends = np.zeros(len(sizes), np.int16)
    for t in range(1, longest[0]):
        if live[t] < len(best):
            ends[live[t] : len(best)] = best[live[t] :].argmax(1)
            best = best[: live[t]]
        top = best.argmax(1)
        jump = best[np.arange(len(best)), top][:, None] - switch
        at = begin[: live[t]] + t
        moved = jump > best
        came[at] = np.where(moved, top[:, None], own)
        best = np.where(moved, jump, best) + scores[at]
    ends[: len(best)] = best.argmax(1)
    state = ends[: live[longest[0] - 1]]
    for t in range(longest[0] - 1, -1, -1):
        if live[t] > len(state):
            state = np.concatenate([state, ends[len(state) : live[t]]])
        at = begin[: live[t]] + t
        labels[at] = state
        if t:
            state = came[at, state]
    return labels


#: Characters of texts that are worked on at a time, with up to 24 languages; and words times languages that are scored.
PART_CHARS, PART_SCORES = 1 << 22, 400_000

Found = tuple[str, float, list[tuple[str, int, int]]]


def identify_texts(model: Model, texts: list[str | None]) -> list[Found]:
    """Language, score and spans (language, first word, number of words) of each text; in parts of bounded size."""
    if not model.languages:
        return [("und", 0.0, [])] * len(texts)
    out: list[Found] = []
    part, size, most = [], 0, PART_CHARS * 24 // max(24, len(model.languages))
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= most:
            out += _identify_part(model, part)
            part, size = [], 0
    return out + _identify_part(model, part)


def _identify_part(model: Model, texts: list[str | None]) -> list[Found]:
    index: dict[str, int] = {}
    ids: list[int] = []
    sizes = []
    for t in texts:
        words = words_of(t)
        sizes.append(len(words))
        ids += [index.setdefault(w, len(index)) for w in words]
    unique = list(index)
    scores, letters = word_scores(model, unique), np.fromiter(map(len, unique), np.int64, len(unique))
    ids = np.array(ids, np.int64)
    labels, weight = viterbi(scores[ids], sizes), letters[ids]
    out, at, k = [], 0, len(model.languages)
    for n in sizes:
        if not n:
            out.append(("und", 0.0, []))
            continue
        own, share = labels[at : at + n], np.bincount(labels[at : at + n], weight[at : at + n], k)
        turns = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [n]]).tolist()
        spans = [(model.languages[own[b]], b, e - b) for b, e in zip(turns, turns[1:])]
        top = int(share.argmax())
        out.append((model.languages[top], float(share[top] / share.sum()), spans))
        at += n
    return out


def held_out(doc_id="doc_id"):
    """Documents that nothing is learnt from: crc32 of the id as text, modulo 4, is 2. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _count(languages: list[str]):
    place, bits = {x: k for k, x in enumerate(languages)}, slot_bits(len(languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.int64)  # of one language at a time
        for batch in batches:
            texts: dict[str, list] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                texts.setdefault(lang, []).append(text)
            k, slot, n = [], [], []
            for lang, own in texts.items():
                scripts = np.zeros(len(_NAMES), np.int64)
                for words in filter(None, map(words_of, own)):
                    slots, _, script = _grams(words, bits)
                    np.add.at(table, slots, 1)
                    scripts += np.bincount(script, minlength=len(_NAMES))
                used, used_scripts = np.flatnonzero(table), np.flatnonzero(scripts)
                slot += [used, -1 - used_scripts]  # scripts below zero
                n += [table[used], scripts[used_scripts]]
                k.append(np.full(len(used) + len(used_scripts), place[lang]))
                table[used] = 0
            if k:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(k), pa.int32()), pa.array(np.concatenate(slot), pa.int32()), pa.array(np.concatenate(n), pa.int64())], ["k", "slot", "n"])

    return run


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on rows of ``docs`` (doc_id, text, lang) that aren't held out and have an id, a text and a lang."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("doc_id is not null and text is not null and lang is not null").where(~held_out())
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each label
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1 << SLOT_BITS, 0), np.float16), np.zeros((len(_NAMES), 0), bool))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20))
    bound = F.create_map([x for lang in languages for x in (F.lit(lang), F.lit(int(min(1.0, train_docs / sizes[lang]) * (1 << 20))))])
    keep = draw < F.element_at(bound, F.col("lang"))
    counts = rows.where(keep).select("text", "lang").mapInArrow(tidy(_count(languages)), "k int, slot int, n long")
    counts = counts.groupBy("k", "slot").agg(F.sum("n").alias("n")).toArrow()  # at most the table's size
    k, slot, n = (counts.column(x).to_numpy() for x in ("k", "slot", "n"))
    grams, scripts = np.zeros((1 << slot_bits(len(languages)), len(languages)), np.float32), np.zeros((len(_NAMES), len(languages)))
    grams[slot[slot >= 0], k[slot >= 0]] = n[slot >= 0]
    scripts[-1 - slot[slot < 0], k[slot < 0]] = n[slot < 0]
    smooth = grams + 0.5
    scores = np.log(smooth / smooth.sum(0)) / ORDERS  # overlapping n-grams repeat each other
    scores -= scores.mean(1, keepdims=True)
    return Model(languages, scores.astype(np.float16), scripts >= 0.01 * np.maximum(scripts.sum(0), 1))


_SPANS = "array<struct<lang:string,first:long,words:long>>"


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang_pred, score, spans.

    Only the text is an input. lang_pred is the language with most letters on the best path (ties: the first in order
    of name), score its share of all letters, spans the path. A text that is null or has no letter, and any text if
    nothing could be learnt, is ``und`` with score 0 and no spans. Repeated rows give repeated rows, an empty table an
    empty result.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its table has a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))
        for batch in batches:
            found = identify_texts(shared.value, batch.column("text").to_pylist())
            spans = pa.array([[{"lang": x, "first": b, "words": n} for x, b, n in s] for _, _, s in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _, _ in found], pa.string()), pa.array([x for _, x, _ in found], pa.float64()), spans], ["doc_id", "lang_pred", "score", "spans"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(tidy(run), f"doc_id long, lang_pred string, score double, spans {_SPANS}")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with all columns, without documents that are ``und``: null texts and texts without a letter. Documents of
    several languages stay. If nothing could be learnt, texts with letters stay too."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if shared.value.languages:
                known = [lang != "und" for lang, _, _ in identify_texts(shared.value, texts)]
            else:
                known = [bool(words_of(t)) for t in texts]
            yield batch.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
