"""Language model: exact base scores and counts, proper probabilities, and better than the base on held-out documents."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from martlake.llm import language_model as m
from martlake.llm import phrases
from martlake.llm.chunked import Words
from martlake.llm.substrings import hash_words


def tokens_of(text):
    low = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", low), ""]


def is_held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def corpus(n=300):
    random.seed(12)
    stems = {"aa": "ka lo mi tu ra", "bb": "sch ung ein st e"}
    word = lambda k: "".join(random.choices(stems[k].split(), [8, 4, 2, 1, 1], k=random.randint(1, 4)))
    rows = []
    for i in range(n):
        k = random.choice(["aa", "aa", "bb"])
        rows.append((i, " ".join(word(k).title() for _ in range(random.randint(0, 80))), random.choice([k, k, k, None])))
    return rows + [(n, None, "aa"), (n + 1, " \n", None), (None, "Kalo kalo", "aa"), (n + 2, "É é x\xa0y " * 3, "cc"), (n + 3, "z" * 30_000, "bb")]


def base_of(rows):
    train = collections.Counter(t for i, x, _ in rows if not is_held_out(i) for t in tokens_of(x))
    total, distinct = sum(train.values()), len(train)
    out = []
    for i, x, _ in rows:
        own = tokens_of(x)
        out.append((i, is_held_out(i), len(own), sum(train[t] > 0 for t in own), total, sum(math.log10((train[t] + 1) / (total + distinct + 1)) for t in own)))
    return out


def key(r):
    return str(r[0]), *r[1:5], round(r[5], 6)


@pytest.mark.parametrize("head", [0, 40, 1 << 20])
def test_scores(spark, head):
    rows = corpus()
    rows += rows[:7] + rows[-5:]
    docs = spark.createDataFrame([(*r, 4, 0.5) for r in rows], "doc_id long, text string, lang string, c int, score double")
    got = m.score_documents(docs, draws=4000, head_tokens=head).collect()
    assert sorted(key(r) for r in got) == sorted(key(r) for r in base_of(rows))
    by = {r.doc_id: r for r in got}
    assert all(by[r.doc_id].score == pytest.approx(r.score, rel=1e-12) for r in got)  # repeated rows
    held = [r for r in by.values() if r.held_out and r.n_tokens > 5]
    assert len(held) > 20 and sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.bits_per_byte > 0 for r in held)
    test_scores.seen = getattr(test_scores, "seen", {}) or {r.doc_id: r.score for r in got}
    assert all(test_scores.seen[r.doc_id] == pytest.approx(r.score, rel=1e-6) for r in got)  # however tokens travel


def test_probabilities_add_up():
    random.seed(2)
    words = Words.of(pa.array(sorted({"".join(random.choices("ab", k=random.randint(0, 5))) for _ in range(50)})))
    tables = np.zeros((2, m._offsets(m.TABLE_BITS)[-1]), np.float32)
    draws = np.stack([np.arange(len(words)) % 3 + 1, np.arange(len(words)) % 2])
    m.add_counts(tables, words, draws.astype(np.float32))
    model = m.learn(m._levels(tables), m.learnt_maps(evidence_in(tables)), words, draws)
    # all next symbols after a beginning: the chain of bits makes a distribution
    for start in ("", "a", "bab", "q"):
        ends = []
        for byte in range(256):
            text = start.encode() + bytes([byte])
            data = Words(np.frombuffer(text, np.uint8), np.array([0]), np.array([len(text)]))
            own = m.symbols(data)
            ends.append(_symbol(model, own, len(start), 1))
        assert sum(map(math.exp, ends)) == pytest.approx(1, abs=1e-6)
    assert np.exp(m.log_probabilities(model, words, 2)).sum(1).max() < 1 + 1e-9


def _symbol(model, symbols, place, kind):
    data, _, _, context = symbols
    salted, node, out = m._of_class(context, kind)[:, place : place + 1], np.ones(1, np.uint32), 0.0
    for b in range(7, -1, -1):
        bit = (data[place : place + 1] >> b) & 1
        pairs, gate = m._inputs(model, salted, node, b)
        _, mixed = m._predict(model, pairs, gate)
        refined, _, _ = m._refined(model, gate, mixed)
        odds = (np.clip(mixed, -m._LIMIT, m._LIMIT) + refined) / 2
        out -= float(np.log1p(np.exp(np.where(bit == 1, -odds, odds)))[0])
        node = node << np.uint32(1) | bit
    return out


def test_common_beginnings_change_nothing():
    random.seed(3)
    texts = ["".join(random.choices("abc", k=random.randint(0, 6))) for _ in range(300)]
    tables = np.zeros((2, m._offsets(m.TABLE_BITS)[-1]), np.float32)
    words = Words.of(pa.array(texts))
    m.add_counts(tables, words, np.ones((1, len(words)), np.float32))
    model = m.Model(m._levels(tables), m._first_maps(), np.full((m._GATES, m._N + 1), 0.25, np.float32), m._first_refine())
    alone = np.concatenate([m.log_probabilities(model, words.take(np.array([k]))) for k in range(len(texts))], axis=1)
    for order in (np.arange(300), np.argsort(texts)):
        assert np.allclose(m.log_probabilities(model, words.take(order)), alone[:, order], atol=1e-9)


def test_tables_grow_with_the_distinct_tokens(spark, monkeypatch):
    assert m.table_bits(0) == m.table_bits(1 << 21) == m.TABLE_BITS
    assert m.table_bits((1 << 21) + 1)[-2:] == m.table_bits(1 << 22)[-2:] == (23, 23)
    assert m.table_bits(1 << 40)[-2:] == (m.MOST_BITS, m.MOST_BITS) and m.table_bits(1 << 40)[:-2] == m.TABLE_BITS[:-2]
    words = [f"w{k * 7919}" for k in range(3000)]
    weights = np.array([[1 + k % 300 for k in range(3000)], [k % 2 for k in range(3000)]])
    weights[0, 0] = 3_000_000
    df = spark.createDataFrame([(w, int(a), int(b)) for w, a, b in zip(words, *weights, strict=True)], "token string, c0 long, c1 long")
    for slots, bits in ((2, 22), (4096, 24)):  # the workers get the size from the driver
        monkeypatch.setattr(m, "TOKEN_SLOTS", slots)
        counts, evidence, own = m.count_tables(df.repartition(3))
        assert own[-1] == bits and counts.shape == (2, m._offsets(own)[-1])
        tables = np.zeros(counts.shape, np.float32)
        m.add_counts(tables, Words.of(pa.array(words)), weights.astype(np.float32), own)
        assert (counts == m._levels(tables)).all() and counts.max() > m.EXACT
        assert np.allclose(evidence, evidence_in(tables, own))
    block = np.array([[0, 1, 255, 256], [3e9, 7e12, 0, 1]], np.float32)
    assert (m._unpack_counts(m._pack_counts(block)) == np.rint(block).astype(np.uint64)).all()


def evidence_in(tables, bits=m.TABLE_BITS):
    """What followed each pair of classes, table by table."""
    ends = m._offsets(bits)
    return np.stack([m.evidence_of(tables[:, a:b]) for a, b in zip(ends, ends[1:], strict=False)])


def trained(texts, weights):
    """Words, occurrences [class, token], and the tables' counts."""
    words = Words.of(pa.array(texts))
    tables = np.zeros((2, m._offsets(m.TABLE_BITS)[-1]), np.float32)
    m.add_counts(tables, words, weights.astype(np.float32))
    return words, weights, tables


def bits_of(model, words, weights):
    """Each bit of each occurrence alone: the bit, the pairs of classes of counts, the gate."""
    for kind, weight in enumerate(weights):
        for t in np.flatnonzero(weight):
            data, _, _, context = m.symbols(words.take(np.array([t])))
            node = np.ones(len(data), np.uint32)
            for b in range(7, -1, -1):
                bit = (data >> b) & 1
                found = m._inputs(model, m._of_class(context, kind), node, b, bit)
                for _ in range(weight[t]):
                    yield bit, *found
                node = node << np.uint32(1) | bit


def test_maps_are_what_was_observed(monkeypatch):
    """Each occurrence's bits meet the exact counts of all other occurrences; maps are the frequencies by their classes,
    those of 15, of 16 and of larger counts as well."""
    random.seed(7)
    monkeypatch.setattr(m, "PRIOR", 4)
    texts = sorted({"".join(random.choices("abc", k=random.randint(0, 5))) for _ in range(60)})
    words, weights, tables = trained(texts, np.array([[random.choice([0, 1, 5, 15, 16, 17, 60]) for _ in texts] for _ in range(2)]))
    seen, offsets = np.zeros((m._N, 2, m.LEVELS, m.LEVELS)), m._offsets(m.TABLE_BITS)
    for kind, weight in enumerate(weights):
        for t in np.flatnonzero(weight):
            data, _, _, context = m.symbols(words.take(np.array([t])))
            context, node = m._of_class(context, kind), np.ones(len(data), np.uint32)
            for b in range(7, -1, -1):
                bit = (data >> b) & 1
                for k in range(m._N):
                    slot = m.slots_of(context[k], node, m.TABLE_BITS[k]) + offsets[k]
                    zeros, ones = tables[0][slot] - (bit == 0), tables[1][slot] - (bit == 1)
                    np.add.at(seen[k], (bit, m._levels(zeros), m._levels(ones)), weight[t])
                node = node << np.uint32(1) | bit
    evidence = evidence_in(tables)
    assert np.allclose(evidence, seen) and seen[:, :, m.EXACT - 1].sum() > 100 and seen[:, :, m.EXACT :].sum() > 1000
    first = 1 / (1 + np.exp(-m._first_maps().astype(np.float64)))
    p = (seen[:, 1] + 4 * first) / (seen.sum(1) + 4)
    assert np.allclose(m.learnt_maps(evidence), np.log(p / (1 - p)), atol=1e-3)


def test_maps_rise_evenly_over_the_last_exact_count(spark):
    """After 15 zeros and no one a one is about as rare as after 14 and 16."""
    rng = np.random.default_rng(3)
    chance = rng.beta(0.05, 3, 200_000)
    tables = np.stack([(n := rng.integers(10, 25, len(chance))) - (o := rng.binomial(n, chance)), o]).astype(np.float64)
    one = 1 / (1 + np.exp(-m.learnt_maps(np.stack([m.evidence_of(tables)] * m._N))[0, :, 0]))
    assert one[14] * 1.1 > one[15] > one[16] * 0.9 and one[14] < 0.02


def test_sums_take_every_training_token():
    random.seed(4)
    texts = sorted({"".join(random.choices("abc", k=random.randint(0, 6))) for _ in range(60)})
    words, weights, tables = trained(texts, np.array([[random.choice([0, 1, 1, 2, 20]) for _ in texts] for _ in range(2)]))
    maps, n = m.learnt_maps(evidence_in(tables)), 0
    rng = np.random.default_rng(1)
    model = m.Model(m._levels(tables), maps, rng.normal(0.3, 0.1, (m._GATES, m._N + 1)).astype(np.float32), m._first_refine())
    cost, slope, hits = np.zeros(m._GATES), np.zeros((m._GATES, m._N + 1)), 0
    for bit, pairs, gate in bits_of(model, words, weights):
        given, mixed = m._predict(model, pairs, gate)
        for j in range(len(bit)):
            n, hits = n + 1, hits + int(bit[j])
            cost[gate[j]] += math.log1p(math.exp(-mixed[j] if bit[j] else mixed[j]))
            slope[gate[j]] += given[:, j] * (bit[j] - 1 / (1 + math.exp(-mixed[j])))
    sums = m.Sums.empty()
    for half in np.array_split(np.arange(len(words)), 2):  # however tokens are dealt out
        m.add_bits(sums, model, words.take(half), weights[:, half])
    assert np.allclose(sums.cost, cost, rtol=1e-5) and np.allclose(sums.slope, slope, rtol=1e-4, atol=1e-3)
    assert sums.hits.sum() == pytest.approx(n) and sums.hits[:, 1].sum() == pytest.approx(hits)


def test_weights_settle_at_the_optimum():
    random.seed(5)
    texts = sorted({"".join(random.choices("abcde", [9, 4, 2, 1, 1], k=random.randint(0, 6))) for _ in range(500)})
    words, weights, tables = trained(texts, np.array([[random.choice([1, 2, 9]) for _ in texts]]))
    counts, maps = m._levels(tables), m.learnt_maps(evidence_in(tables))

    def sums_of(model):
        sums = m.Sums.empty()
        m.add_bits(sums, m.replace(model, counts=counts), words, weights)
        return sums

    cost = lambda model: (s := sums_of(model)).cost.sum() + ((model.weights - 0.25) ** 2).sum() / 2
    found = []
    for start in (0.25, 0.0, 1.0):
        model = m.Model(None, maps, np.full((m._GATES, m._N + 1), start, np.float32), m._first_refine())
        found.append(m.settle(model, sums_of))
        assert cost(found[-1]) <= cost(model)
    best = cost(found[0])
    assert all(cost(x) == pytest.approx(best, rel=2 * m.SETTLED) for x in found)
    rng = np.random.default_rng(3)
    for _ in range(5):  # no other weights near cost less
        near = found[0].weights + rng.normal(0, 0.05, found[0].weights.shape).astype(np.float32)
        assert cost(m.replace(found[0], weights=near)) > best


def test_a_near_start_saves_rounds():
    """Newton's method on the drawn tokens leaves fewer rounds over all tokens, and the same optimum."""
    random.seed(8)
    texts = sorted({"".join(random.choices("abcde", [9, 4, 2, 1, 1], k=random.randint(0, 6))) for _ in range(900)})
    words, weights, tables = trained(texts, np.array([[random.choice([1, 2, 9]) for _ in texts]]))
    counts, maps = m._levels(tables), m.learnt_maps(evidence_in(tables))
    calls = [0]

    def sums_of(model):
        calls[0] += 1
        sums = m.Sums.empty()
        m.add_bits(sums, m.replace(model, counts=counts), words, weights)
        return sums

    draws = (weights + 1) // 2
    start = m.learn(counts, maps, words, draws)
    near = m.nearer(start, words, draws)
    assert (near.refine == start.refine).all()  # of draws only the weights' start is taken
    rounds, cost = [], []
    for x in (start, near):
        calls[0] = 0
        settled = m.settle(m.replace(x, counts=None), sums_of)
        rounds.append(calls[0])
        cost.append(sums_of(settled).cost.sum() + ((settled.weights - 0.25) ** 2).sum() / 2)
    assert rounds[1] < rounds[0] and cost[1] == pytest.approx(cost[0], rel=2 * m.SETTLED)
    assert m.nearer(start, words, draws * 0) is start


def test_counts_without_the_own_occurrence_and_gates():
    """For every pair of classes: what's taken off, and the gate, against the plain rules."""
    zeros, ones = (x.ravel().astype(np.uint8) for x in np.meshgrid(np.arange(m.LEVELS), np.arange(m.LEVELS)))
    bits = (14,) * m._N
    counts = np.zeros((m._N << 14, 2), np.uint8)
    slots = m.slots_of(np.zeros(1, np.uint32), np.arange(1, 40_000, dtype=np.uint32), 14)
    place, first = np.unique(slots, return_index=True)
    node, place = (first[: len(zeros)] + 1).astype(np.uint32), place[: len(zeros)]
    zeros, ones = zeros[: len(node)], ones[: len(node)]
    for k in range(m._N):
        counts[(k << 14) + place] = np.stack([zeros, ones], axis=1)
    model = m.Model(counts.T, m._first_maps(), np.zeros((m._GATES, m._N + 1), np.float32), m._first_refine(), bits)
    assert len(node) > 10_000
    for bit in (0, 1, None):
        pairs, gate = m._inputs(model, np.zeros((m._N, len(node)), np.uint32), node, 3, None if bit is None else np.full(len(node), bit, np.uint8))
        z, o = (x - ((x > 0) & (x < m.EXACT)) if bit == k else x for k, x in enumerate((zeros.astype(int), ones.astype(int))))
        assert (pairs == z + 256 * o).all()
        assert (gate == 3 + 8 * np.where(z + o > 0, m._N - 1 + np.searchsorted(m._SEEN, z + o, "right"), 0)).all()


def test_scores_come_from_all_tokens_not_from_draws(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    few, many = ({r.doc_id: r.score for r in m.score_documents(docs, draws=n).collect()} for n in (1, 4000))
    assert all(few[i] == pytest.approx(many[i], rel=5e-3) for i in few)


def test_learning_uses_training_documents_only(spark):
    rows = corpus(80)
    docs = lambda change: spark.createDataFrame([(i, "other words" if change and is_held_out(i) else x, "zz" if change and is_held_out(i) else k) for i, x, k in rows], "doc_id long, text string, lang string")
    a, b = ({r.doc_id: r for r in m.score_documents(docs(c), draws=1000).collect()} for c in (False, True))
    assert all(a[i].score == pytest.approx(b[i].score) and a[i].base_score == pytest.approx(b[i].base_score) for i in a if not is_held_out(i))


def test_small_tables(spark):
    docs = spark.createDataFrame([(2, "a b", "x")], "doc_id long, text string, lang string")
    assert m.score_documents(docs.limit(0)).count() == 0
    held = next(i for i in itertools.count() if is_held_out(i))
    (r,) = m.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (r.held_out, r.n_known, r.train_tokens, r.base_score) == (True, 0, 0, 0.0) and r.score < 0
    (r,) = m.score_documents(docs).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 3, 3)


def cut_slowly(words):
    """Phrases as (context of the last three tokens, tokens, whether the text ends), cut by the same hash of two neighbours."""
    hashes = [int(x) for x in hash_words(Words.of(pa.array(words)))] if words else []
    out, own = [], []
    for k, w in enumerate(words):
        own.append(w)
        before = hashes[k - 1] if k else 0
        z = np.array([(hashes[k] * 3 + before) % 2**64], np.uint64)
        if k == len(words) - 1 or int(phrases._mixed(z)[0]) % phrases.LENGTH == 0:
            at = k - len(own) + 1
            out.append((tuple([None] * max(0, 3 - at) + words[max(0, at - 3) : at]) if at else None, tuple(own), k == len(words) - 1))
            own = []
    return out


def test_phrases_are_cut_by_their_content():
    random.seed(6)
    texts = [[random.choice("abcdefgh") * random.randint(1, 3) for _ in range(random.randint(0, 120))] for _ in range(30)] + [[], ["x"]]
    texts += [texts[0] + texts[1], ["new"] + texts[2]]
    bounds = np.cumsum([0] + [len(t) for t in texts])
    tokens = hash_words(Words.of(pa.array([w for t in texts for w in t])))
    starts, ends, context, phrase = phrases.cut(tokens, bounds)
    want = [cut_slowly(t) for t in texts]
    assert np.diff(ends).tolist() == [len(x) for x in want]
    flat = [x for t in want for x in t]
    assert np.diff(np.append(starts, len(tokens))).tolist() == [len(x[1]) for x in flat]
    for names, hashes in (([x[0] for x in flat], context), ([x[1:] for x in flat], phrase)):
        pairs = set(zip(names, hashes.tolist()))
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_predictions_against_a_loop():
    """Candidates, own occurrences and outcomes, phrase after phrase."""
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 30, 25)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    context, phrase = rng.integers(1, 6, bounds[-1]).astype(np.uint64), rng.integers(1, 4, bounds[-1]).astype(np.uint64)
    own = rng.integers(0, 2, len(sizes)).astype(bool)
    tables = [collections.defaultdict(collections.Counter) for _ in sizes]
    for d in range(len(sizes)):
        for k in range(bounds[d] + 1, bounds[d + 1]):
            tables[d][int(context[k])][int(phrase[k])] += 1
    every = collections.defaultdict(collections.Counter)
    for d in np.flatnonzero(own):
        for h, c in tables[d].items():
            every[h].update(c)
    n = len(context)
    candidate, times, total = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    context[bounds[:-1][sizes > 0]] = 0  # first phrases have no context
    for d in range(len(sizes)):
        for k in range(bounds[d], bounds[d + 1]):
            if int(context[k]) in every and int(context[k]) not in map(int, context[bounds[d] : k]):
                (candidate[k], times[k]), total[k] = max(every[int(context[k])].items(), key=lambda x: (x[1], x[0])), sum(every[int(context[k])].values())
    bits, hit = phrases.predictions(bounds, context, phrase, candidate, times, total, own)
    want, hits = [], []
    for d in range(len(sizes)):
        last = {}
        for k in range(bounds[d], bounds[d + 1]):
            h, x, came = int(context[k]), int(phrase[k]), False
            if k > bounds[d]:
                if h in last:
                    came = last[h] == x
                    want.append((k, 0, came))
                if h in every and not came:
                    top, m = max(every[h].items(), key=lambda y: (y[1], y[0]))
                    if m - (tables[d][h][top] if own[d] else 0) > 0 and last.get(h) != top:
                        want.append((k, 1, top == x))
                        came = top == x
                last[h] = x
            hits.append(came)
    assert sorted(zip(bits.phrase.tolist(), bits.kind.tolist(), bits.came.tolist())) == sorted(want)
    assert hit.tolist() == hits and sum(hits) > 50
    assert all((e >= 0).all() and (e < v).all() for e, v in zip(bits.evidence, phrases.VALUES))


def test_the_mixing_learns():
    rng = np.random.default_rng(9)
    kind, evidence = rng.integers(0, 2, 5000), np.stack([rng.integers(0, v, 5000) for v in phrases.VALUES])
    truth = 1 / (1 + np.exp(-((evidence[0] % 7) - 3 + (evidence[2] % 3) - 1.0)))
    bits = phrases.Bits(np.arange(5000), kind, evidence, rng.random(5000) < truth)
    key, place = np.unique(phrases.combined(bits), return_inverse=True)
    model = phrases.learn(key, np.bincount(place), np.bincount(place, bits.came))
    assert model.costs(bits).mean() > np.log(0.5) * 0.8 and np.isfinite(model.costs(bits)).all()
    assert np.isfinite(phrases.learn(*(np.zeros(0, np.int64),) * 3).costs(bits)).all()


def test_texts_that_occur_twice_stand_out(spark):
    """Copies, whole or in part, trained on or not, are scored far above texts that occur once."""
    random.seed(8)
    word = lambda: "".join(random.choices("abcdefghij", k=random.randint(2, 6)))
    once = [" ".join(word() for _ in range(150)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(once)] + [(1000 + i, once[i]) for i in range(0, 120, 6)] + [(2000, once[1] + " " + once[2])]
    got = {r.doc_id: r for r in m.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), draws=4000).collect()}
    per = {i: r.score / r.base_score for i, r in got.items()}
    twice = [i for i in range(0, 120, 6)] + [1000 + i for i in range(0, 120, 6)]
    alone = [i for i in range(120) if i % 6 and i not in (1, 2)]
    seen = [i for i in twice if not got[i + 1000 if i < 1000 else i - 1000].held_out]
    assert len(seen) > 25 and max(per[i] for i in seen) < 0.6 * min(per[i] for i in alone)
    assert per[2000] < 0.6 * min(per[i] for i in alone)
