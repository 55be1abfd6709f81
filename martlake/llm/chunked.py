"""Exact tokenizer ids of whole batches of texts, by way of their distinct whitespace-delimited chunks.

A byte-level or word-end BPE never merges across the boundaries that its pre-tokenizer draws, so a text's ids are
those of its chunks, one after the other, if chunks are cut only where the pre-tokenizer always cuts. For the two
kinds of pre-tokenizer here that holds for texts over a plain alphabet (ASCII without control characters other than
tab and line feed, and the letters of Latin-1); any other text goes to the library as a whole. A batch is cut,
dictionary-encoded and merged as arrays; nothing is kept between batches.

* ``word_end``: lower case, white space dropped; a chunk is a run without white space.
* ``byte_level``: one blank belongs to the word after it. Texts are cut at blanks, and a chunk has the blank before it.
  A run of white space before such a blank ends there, as at the end of a text. Only a blank before more white space
  would belong to a longer run; texts with one go to the library.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from martlake.llm.merges import Merges

#: What sends a text to the library: anything outside the plain alphabet, and what may begin a special token.
_ODD = "[^\t\n -~À-ÿ]|<\\|"
_RUN = "[ ][ \t\n]"
#: Longer pieces are left to the library.
MERGE_BYTES = 100

#: The pre-tokenizers' patterns, for the plain alphabet. Only chunks with an apostrophe need them.
_PATTERNS = {
    "byte_level": re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^ \t\nA-Za-zÀ-ÖØ-öø-ÿ0-9]+|[ \t\n]+(?![^ \t\n])|[ \t\n]+"),
    "word_end": re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t\na-zß-öø-ÿ0-9]+"),
}

_LETTER, _DIGIT, _OTHER, _SPACE = 1, 2, 3, 4
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[[0x09, 0x0A, 0x20]] = _SPACE


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer in a file, loaded once in a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


class Words:
    """Byte strings one after the other: their bytes, and where each begins and how long it is."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray):
        self.data, self.begin, self.length = data, begin, length

    @classmethod
    def of(cls, array: pa.Array) -> Words:
        array = array.cast(pa.large_string())
        at = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8)
        data = np.frombuffer(array.buffers()[2] or b"", np.uint8)
        return cls(data, at[:-1], np.diff(at))

    def __len__(self) -> int:
        return len(self.length)

    def at(self, k: int) -> bytes:
        return self.data[self.begin[k] : self.begin[k] + self.length[k]].tobytes()

    def take(self, which: np.ndarray) -> Words:
        length = self.length[which]
        return Words(self.data[spread(self.begin[which], length)], np.cumsum(length) - length, length)

    def after_blank(self) -> Words:
        """Each with a blank before it."""
        length = self.length + 1
        begin = np.cumsum(length) - length
        data = np.full(int(length.sum()), 0x20, np.uint8)
        data[spread(begin + 1, self.length)] = self.data[spread(self.begin, self.length)]
        return Words(data, begin, length)

    def __add__(self, other: Words) -> Words:
        return Words(np.concatenate([self.data, other.data]), np.concatenate([self.begin, other.begin + len(self.data)]), np.concatenate([self.length, other.length]))


def spread(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one range after the other."""
    return np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


class TextEncoder:
    """Ids of texts as the tokenizers library gives them without special tokens added."""

    def __init__(self, path: str, kind: str):
        self.tokenizer, self.merges, self.kind = load(path), merges(path), kind

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def chunk_ids(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, and how many each has."""
        piece, single = self._cut(words)
        ids, at = self.merges.encode(piece.data, piece.begin, piece.length)
        first = np.searchsorted(piece.begin, np.append(np.cumsum(words.length) - words.length, words.length.sum()))
        n = np.diff(at[first])
        for k in single.tolist():  # apostrophes and very long pieces
            n[k] = 0
        if not len(single):
            return ids, n
        keep = np.ones(len(words), bool)
        keep[single] = False
        begin, kept = at[first[:-1]], n
        extra = [self._by_pattern(words.at(k)) for k in single.tolist()]
        n = n.copy()
        n[single] = [len(x) for x in extra]
        start = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.int32)
        out[spread(start[keep], n[keep])] = ids[spread(begin[keep], kept[keep])]
        if extra:
            out[spread(start[single], n[single])] = [i for x in extra for i in x]
        return out, n

    def _by_pattern(self, chunk: bytes) -> list[int]:
        """One chunk, by the pattern itself and the library's merges."""
        return [i for x in _PATTERNS[self.kind].findall(chunk.decode()) for i in self.whole(x)]

    def _cut(self, words: Words) -> tuple[Words, np.ndarray]:
        """The pieces of contiguous chunks, and which chunks are to be cut by the pattern instead."""
        data, n = words.take(np.arange(len(words))).data, int(words.length.sum())
        begin = np.cumsum(words.length) - words.length
        kind = _CLASS[data]
        sign = np.flatnonzero((data[1:] == 0x97) | (data[1:] == 0xB7)) if n else np.zeros(0, np.int64)
        sign = sign[data[sign] == 0xC3]  # the signs of multiplication and division among Latin-1's letters
        kind[sign] = kind[sign + 1] = _OTHER
        start = np.zeros(n + 1, bool)
        start[begin[words.length > 0]] = True
        start[n] = True
        if self.kind == "byte_level":
            lead = begin[words.length > 1]
            lead = lead[data[lead] == 0x20]
            kind[lead] = kind[lead + 1]
        edge = start[:-1].copy()
        edge[1:] |= kind[1:] != kind[:-1]
        if self.kind == "word_end":
            edge |= kind == _DIGIT
        elif n > 2:
            # before other text, the last character of a longer run of white space stands alone
            last = np.flatnonzero((kind[1:-1] == _SPACE) & (kind[:-2] == _SPACE) & (kind[2:] != _SPACE)) + 1
            last = last[~start[last] & ~start[last + 1]]
            edge[last] = True
        at = np.flatnonzero(edge)
        length = np.diff(np.append(at, n))
        odd = np.unique(np.searchsorted(begin, np.concatenate([np.flatnonzero(data == 0x27), at[length > MERGE_BYTES]]), "right") - 1)
        odd = odd[words.length[odd] > 0]
        return Words(data, at, length), odd

    def _chunks(self, texts: pa.Array) -> tuple[np.ndarray, Words, np.ndarray, np.ndarray]:
        """Which texts are separable, their distinct chunks, and their chunks' numbers with the bounds of each text."""
        odd = pc.match_substring_regex(texts, _ODD if self.kind == "word_end" else f"{_ODD}|{_RUN}").to_numpy(zero_copy_only=False)
        if not self.merges.usable:
            odd = np.ones(len(texts), bool)
        plain = np.flatnonzero(~odd)
        texts = texts.filter(pa.array(~odd))
        lists = pc.ascii_split_whitespace(pc.utf8_lower(texts)) if self.kind == "word_end" else pc.split_pattern(texts, " ")
        bounds = lists.offsets.to_numpy() if len(texts) else np.zeros(1, np.int64)
        coded = lists.flatten().dictionary_encode()
        words, number = Words.of(coded.dictionary), coded.indices.to_numpy().astype(np.int64)
        bounds = bounds.astype(np.int64) - bounds[0]
        if self.kind == "byte_level" and len(number):
            first = np.unique(number[bounds[:-1]])  # a text's first chunk has no blank before it
            place = np.zeros(len(words), np.int64)
            place[first] = np.arange(len(first)) + len(words)
            number[bounds[:-1]] = place[number[bounds[:-1]]]
            words = words.after_blank() + words.take(first)
        return plain, words, number, bounds

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls), and the bounds of each."""
        plain, words, number, bounds = self._chunks(texts)
        ids, n = self.chunk_ids(words)
        at = np.cumsum(n) - n
        flat = ids[spread(at[number], n[number])]
        total = np.append(0, np.cumsum(n[number]))
        if len(plain) == len(texts):
            return flat, total[bounds]
        size = np.zeros(len(texts), np.int64)
        size[plain] = np.diff(total[bounds])
        others = np.setdiff1d(np.arange(len(texts)), plain)
        more = [self.whole(texts[k].as_py()) for k in others.tolist()]
        size[others] = [len(x) for x in more]
        start = np.append(0, np.cumsum(size))
        out = np.empty(int(start[-1]), np.int32)
        out[spread(start[plain], size[plain])] = flat
        out[spread(start[others], size[others])] = [i for x in more for i in x]
        return out, start

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        plain, words, number, bounds = self._chunks(texts)
        total = np.append(0, np.cumsum(self.chunk_ids(words)[1][number]))
        size = np.zeros(len(texts), np.int64)
        size[plain] = np.diff(total[bounds])
        for k in np.setdiff1d(np.arange(len(texts)), plain).tolist():
            size[k] = len(self.whole(texts[k].as_py()))
        return size
