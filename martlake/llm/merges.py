"""Exact BPE merges of many words at once.

All words are merged side by side: in each round every word merges its pair of lowest rank, at all its places from the
left. That is the order of the one-by-one rule as long as a pair's parts come from merges of lower rank, which is
checked when the table is made; then no new pair can come before the rest of the pair being merged.
"""

from __future__ import annotations

import json

import numpy as np

#: Fixed value: what separates the two parts of a merge in older files.
_NONE = np.int32(2**31 - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def byte_symbols() -> list[str]:
    """The character that byte-level vocabularies write for each byte: printable ones as they are, the rest from U+0100."""
    printable = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(rest)) for b in range(256)]


class Merges:
    """The merge table of a byte-level BPE in a tokenizers file; ``usable`` is False if its rules aren't covered here."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        plain = not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges") or model.get("byte_fallback"))
        symbols = byte_symbols()
        made: dict[str, int] = {}
        ordered = True
        for rank, (a, b) in enumerate(pairs):
            ordered &= made.get(a, -1) < rank and made.get(b, -1) < rank
            made.setdefault(a + b, rank)
        # A part that only a later merge makes would break the order; parts that no merge makes are single symbols.
        later = any(made.get(x, -1) >= rank for rank, pair in enumerate(pairs) for x in pair)
        known = all(x in vocab for s in symbols for x in {s, s + end}) and all(a in vocab and b in vocab and a + b in vocab for a, b in pairs)
        self.usable = bool(plain and ordered and not later and known and len(vocab) < 1 << 20)
        if not self.usable:
            return
        self.first = np.array([vocab[s] for s in symbols], np.int32)
        self.last = np.array([vocab[s + end] for s in symbols], np.int32)
        left = np.array([vocab[a] for a, _ in pairs], np.uint64)
        right = np.array([vocab[b] for _, b in pairs], np.uint64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        bits = max(10, len(pairs).bit_length() + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.zeros(1 << bits, np.uint64), np.full(1 << bits, _NONE, np.int32)
        self.probes = 0
        keys = (left << np.uint64(20) | right) + np.uint64(1)
        waiting, slot = np.arange(len(keys)), ((keys * _SPREAD) >> self.shift).astype(np.int64)
        while len(waiting):  # open addressing: one key wins each free slot, the others go one further
            self.probes += 1
            free = waiting[self.keys[slot[waiting]] == 0]
            winners = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[winners]], self.ranks[slot[winners]] = keys[winners], winners
            waiting = np.setdiff1d(waiting, winners, assume_unique=True)
            waiting = waiting[self.keys[slot[waiting]] != keys[waiting]]  # of a pair listed twice the first rank holds
            slot[waiting] = (slot[waiting] + 1) & self.mask

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint64) << np.uint64(20) | b.astype(np.uint64)) + np.uint64(1)
        slot = ((key * _SPREAD) >> self.shift).astype(np.int64)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], _NONE)
        todo = np.flatnonzero((found != key) & (found != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            found = self.keys[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (found != 0)]
        return out

    def encode(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all (non-empty) words, which fill ``data`` one after the other, and the bounds of each word's ids."""
        n = len(length)
        if not n:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        ids = self.first[data]
        ids[begin + length - 1] = self.last[data[begin + length - 1]]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # finished: word, number of ids, ids
        word = np.arange(n)
        ranks = np.full(len(ids), _NONE, np.int32)
        if len(ids) > 1:
            ranks[:-1] = self.rank(ids[:-1], ids[1:])
        ranks[begin + length - 1] = _NONE
        while len(word):
            least = np.minimum.reduceat(ranks, begin)
            over = least == _NONE
            if over.any():
                end = np.repeat(over, length)
                out.append((word[over], length[over], ids[end]))
                ids, ranks, word, length, least = ids[~end], ranks[~end], word[~over], length[~over], least[~over]
                begin = np.cumsum(length) - length
                if not len(word):
                    break
            at = np.flatnonzero(ranks == np.repeat(least, length))
            # of places that overlap (a pair of equal symbols in a row) every other one, from the left
            turn = np.concatenate([[True], np.diff(at) != 1])
            run = np.maximum.accumulate(np.where(turn, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            ids[at] = self.merged[ranks[at]]
            owner = np.searchsorted(begin, at, "right") - 1
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids[keep]
            ranks = ranks[keep]
            length = length - np.bincount(owner, minlength=len(length))
            begin = np.cumsum(length) - length
            at = at - np.arange(len(at))  # where the merged ids are now
            last = begin[owner] + length[owner] - 1
            ranks[at] = _NONE
            here = at[at < last]
            ranks[here] = self.rank(ids[here], ids[here + 1])
            here = at[at > begin[owner]] - 1
            ranks[here] = self.rank(ids[here], ids[here + 1])
        word, length = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
        ids = np.concatenate([x[2] for x in out])
        offsets = np.zeros(n + 1, np.int64)
        offsets[word + 1] = length
        offsets = np.cumsum(offsets)
        place = np.repeat(offsets[word] - (np.cumsum(length) - length), length) + np.arange(len(ids))
        done = np.empty_like(ids)
        done[place] = ids
        return done, offsets
