"""Predictors across tokens for the language model: will the phrase that followed these tokens before come again?

A document's tokens are cut where the hash of two neighbours says so, so that equal passages are cut alike wherever they
stand. The last three tokens before a phrase are its context. Two predictors look hashed contexts up and predict one
bit each, whether their candidate comes next: the phrase that followed the context last in this document, and the one
that followed it most often in the training documents (a training document's own occurrences aren't counted for it). A
phrase that neither names is spelled token by token.

The bit's log odds are mixed from maps of three kinds of evidence (how often the context was followed by the candidate
and by others, what the other predictor says, and how the last predictions in this document came out) by weights
that the document's recent outcomes select; a last map of the mixed odds and the longest recent run of hits refines
them, so the model adapts from phrase to phrase. Evidence is coarse: all bits of the training documents add up to a
table of a bounded number of combinations, and maps, weights and refinement are learnt from its exact counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from martlake.llm.substrings import _mixed, _power

#: Tokens of a phrase on average, and of its context.
LENGTH, CONTEXT = 16, 3
#: Kinds of evidence: counts, what the other predictor says, recent outcomes; how many values each has.
KINDS, VALUES = 3, (256, 64, 18)
_BASE = 0xA0761D6478BD642F
_BUCKETS, _LIMIT = 24, 9.0
GATES = 2 * VALUES[2]


def cut(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the token hashes of texts one after the other: where each phrase begins, the bounds of each text's phrases, and
    the hashes of the contexts (zero for a text's first phrase) and of the phrases with the text's end."""
    n, first, last = len(tokens), bounds[:-1][np.diff(bounds) > 0], bounds[1:][np.diff(bounds) > 0] - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    place = np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds))
    before = [np.where(place >= k, np.concatenate([np.zeros(k, np.uint64), tokens[: n - k]])[:n], np.uint64(0)) for k in range(1, CONTEXT + 1)]
    ends = _mixed(tokens * np.uint64(3) + before[0]) % np.uint64(LENGTH) == 0
    ends[last] = True
    starts = np.unique(np.concatenate([first, np.flatnonzero(ends[:-1]) + 1])) if n > 1 else first
    context = np.zeros(n, np.uint64)
    for x in reversed(before):
        context = _mixed(context * np.uint64(_BASE) + x)
    context = np.where(place[starts] > 0, context[starts], np.uint64(0))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(tokens * _power(_BASE, n)[:n])])
    stop = np.append(starts[1:], n)
    phrase = (sums[stop] - sums[starts]) * _power(pow(_BASE, -1, 1 << 64), n)[starts]
    closes = np.isin(stop - 1, last).astype(np.uint64)
    phrase = _mixed(_mixed(phrase + (stop - starts).astype(np.uint64)) + closes)
    return starts, np.searchsorted(starts, bounds), context, phrase


@dataclass
class Bits:
    """Predictions that were made: of which phrase, by which predictor (0: the document, 1: the corpus), the evidence, and
    whether the candidate came."""

    phrase: np.ndarray
    kind: np.ndarray
    evidence: np.ndarray  # [KINDS, bit]
    came: np.ndarray


def _few(n: np.ndarray, most: int) -> np.ndarray:
    """Counts in so many classes: exact up to four, then by factors of about two."""
    big = 3 + np.floor(np.log2(np.maximum(n, 4) / 2) * 1.5).astype(np.int64)
    return np.minimum(np.where(n <= 4, n, big), most - 1)


def predictions(bounds: np.ndarray, context: np.ndarray, phrase: np.ndarray, candidate: np.ndarray, times: np.ndarray, total: np.ndarray, own: np.ndarray) -> tuple[Bits, np.ndarray]:
    """The predictions of texts' phrases, and which phrases were hit.

    candidate, times and total (at a context's first occurrence in its text): the phrase that followed it most often in
    training documents, how often, and how often any did (0: never). own: texts whose occurrences are among these.
    """
    n = len(context)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place = np.arange(n) - bounds[:-1][doc]
    order = np.lexsort((place, context, doc))
    fresh = np.ones(n, bool)
    fresh[1:] = (doc[order][1:] != doc[order][:-1]) | (context[order][1:] != context[order][:-1])
    group_of = np.cumsum(fresh) - 1
    head = np.flatnonzero(fresh)
    group = np.empty(n, np.int64)
    group[order] = group_of
    at = np.empty(n, np.int64)  # earlier occurrences in the text
    at[order] = np.arange(n) - head[group_of] if n else 0
    before = np.full(n, -1)
    before[order[1:]] = np.where(fresh[1:], -1, order[:-1])
    first = order[head]
    candidate, times, total = candidate[first][group], times[first][group], total[first][group]
    if n:  # a document's own occurrences
        mine = own[doc]
        size, same = np.diff(np.append(head, n))[group], np.bincount(group, phrase == candidate, len(head))[group].astype(np.int64)
        total, times = np.maximum(total - np.where(mine, size, 0), 0), times - np.where(mine, same, 0)
    inner = place > 0
    has_doc = inner & (before >= 0)
    doc_says = np.where(has_doc, phrase[before], np.uint64(0))
    doc_came = has_doc & (doc_says == phrase)
    says = inner & (times > 0)
    agrees = says & has_doc & (candidate == doc_says)
    has_all = says & ~agrees & ~doc_came
    all_came = has_all & (candidate == phrase)
    hit = doc_came | all_came
    # recent outcomes: 0 nothing predicted, 1 missed, 2 hit; the run of hits before
    outcome = np.where(hit, 2, np.where(has_doc | has_all, 1, 0))
    earlier = np.where(place > 0, np.concatenate([[0], outcome[:-1]])[:n], 0)
    stop = np.maximum.accumulate(np.where(~hit, np.arange(n), -1)) if n else np.zeros(0, np.int64)
    run = np.where(place > 0, np.concatenate([[0], np.minimum(np.arange(n) - stop, place + 1)[:-1]])[:n], 0)
    state = earlier * 6 + np.minimum(_few(run, 6), 5)
    others = np.maximum(total - times, 0)
    was_right = np.where(has_doc & (before >= 0) & has_doc[before], 1 + doc_came[before], 0)
    doc_counts = np.minimum(at, 15) * 3 + was_right
    doc_other = np.where(agrees, 8 * _few(times, 8) + _few(others, 8), _few(total, 8))
    all_counts = 16 * _few(times, 16) + _few(others, 16)
    all_other = np.where(has_doc, 8, 0) + np.minimum(at, 7)
    a, b = np.flatnonzero(has_doc), np.flatnonzero(has_all)
    evidence = np.concatenate([np.stack([doc_counts[a], doc_other[a], state[a]]), np.stack([all_counts[b], all_other[b], state[b]])], axis=1)
    return Bits(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), evidence.astype(np.int64), np.concatenate([doc_came[a], all_came[b]])), hit


def combined(bits: Bits) -> np.ndarray:
    """Predictor and evidence of each bit as one number."""
    key = bits.kind.astype(np.int64)
    for k, n in enumerate(VALUES):
        key = key * n + bits.evidence[k]
    return key


def _apart(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for n in reversed(VALUES):
        out.append(key % n)
        key = key // n
    return key, np.stack(out[::-1])


@dataclass
class Model:
    maps: list[np.ndarray]  # [predictor, value]: log odds, for each kind of evidence
    weights: np.ndarray  # [gate, kind + 1]
    refine: np.ndarray  # [gate, bucket]

    def odds(self, kind: np.ndarray, evidence: np.ndarray) -> np.ndarray:
        """The log odds that the candidate comes."""
        mixed, gate = self._mix(kind, evidence)
        low, share = _bucket(mixed)
        refined = self.refine[gate, low] * (1 - share) + self.refine[gate, low + 1] * share
        return np.clip((mixed + refined) / 2, -_LIMIT, _LIMIT)

    def _mix(self, kind: np.ndarray, evidence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gate = kind * VALUES[2] + evidence[2]
        given = self.inputs(kind, evidence)
        return np.clip(np.einsum("kn,nk->n", given, self.weights[gate]), -_LIMIT, _LIMIT), gate

    def inputs(self, kind: np.ndarray, evidence: np.ndarray) -> np.ndarray:
        return np.stack([*(m[kind, e] for m, e in zip(self.maps, evidence)), np.full(len(kind), 0.3)])

    def costs(self, bits: Bits) -> np.ndarray:
        """The natural logarithm of each bit's probability."""
        odds = self.odds(bits.kind, bits.evidence)
        return -np.log1p(np.exp(np.where(bits.came, -odds, odds)))


def _bucket(mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = (mixed + _LIMIT) * (_BUCKETS / (2 * _LIMIT))
    low = np.minimum(x.astype(np.int64), _BUCKETS - 1)
    return low, x - low


def learn(key: np.ndarray, n: np.ndarray, came: np.ndarray, rounds: int = 60) -> Model:
    """From how many bits of each combination there were and how often the candidate came."""
    kind, evidence = _apart(key)
    n, came = n.astype(float), came.astype(float)
    maps = []
    for k, values in enumerate(VALUES):
        seen = np.stack([np.bincount(kind * values + evidence[k], x, 2 * values).reshape(2, -1) for x in (n, came)])
        p = (seen[1] + 1) / (seen[0] + 2)
        maps.append(np.log(p / (1 - p)))
    model = Model(maps, np.full((GATES, KINDS + 1), 0.4), np.repeat(np.linspace(-_LIMIT, _LIMIT, _BUCKETS + 1)[None], GATES, 0))
    if not len(key):
        return model
    given, gate = model.inputs(kind, evidence), kind * VALUES[2] + evidence[2]
    size = np.maximum(np.bincount(gate, n, GATES), 1)[:, None]
    squares = np.zeros(model.weights.shape)
    for _ in range(rounds):  # steps down the cost of all bits, each weight at its own rate
        p = 1 / (1 + np.exp(-model._mix(kind, evidence)[0]))
        slope = np.stack([np.bincount(gate, (came - n * p) * x, GATES) for x in given], axis=1) / size
        squares += slope**2
        model.weights += 0.1 * slope / np.sqrt(squares + 1e-6)
    mixed, _ = model._mix(kind, evidence)
    low, share = _bucket(mixed)
    hits = np.zeros((2, GATES, _BUCKETS + 1))
    for row, x in enumerate((n - came, came)):
        np.add.at(hits[row], (gate, low), x * (1 - share))
        np.add.at(hits[row], (gate, low + 1), x * share)
    first = 1 / (1 + np.exp(-model.refine))
    p = (hits[1] + 8 * first) / (hits.sum(0) + 8)
    model.refine = np.clip(np.log(p / (1 - p)), -_LIMIT, _LIMIT)
    return model
