"""Hard negatives against all scores, and the bounds that let intervals go."""

import math

import numpy as np
import pytest

from martlake.llm import hard_negatives as h

SCHEMA = "vec_id long, label int, vector array<float>, score int, uid string"


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95):
    dims = max((len(v) for _, _, v in rows if v), default=0)
    kept = [(i, y, [math.floor(256 * x) for x in v] + [0] * (dims - len(v))) for i, y, v in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = 1 << 62
    out = []
    for a, (i, y, v) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), last if j is None else j, k, j, z) for k, (j, z, w) in enumerate(kept) if k != a)
        for s, _, _, j, _ in [r for r in scored if r[4] == y][:positives]:
            hard = [r for r in scored if r[4] != y and -low * s <= -100 * r[0] <= -high * s][:negatives]
            out += [(i, j, k + 1, r[3], -s, -r[0]) for k, r in enumerate(hard)]
    return sorted(map(str, out))


def vectors(n, dims, seed, clusters=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    if clusters:
        x = rng.normal(size=(clusters, dims))[rng.integers(clusters, size=n)] * 4 + x * 0.3
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).tolist()


def odd_rows():
    rows = [(k, k % 3, v) for k, v in enumerate(vectors(300, 6, 1))]
    rows += [(150, 0, rows[150][2])] * 3 + [(None, 1, rows[7][2]), (None, 0, rows[8][2])]  # repeated rows and null ids
    rows += [(1000 + k, 2, [0.5, 0.5]) for k in range(60)] + [(2000 + k, k % 3, [1.0, 0.0, 0.0]) for k in range(60)]  # ties, short vectors
    rows += [(50, None, [1.0]), (100, 1, None), (400, 1, [1.0, None]), (450, 1, [float("nan"), 1.0]), (500, 2, [float("inf")]), (550, 2, []), (-50, 0, [-1.0] * 6), (0, 1, [0.0] * 6)]
    return rows


def mined(spark, rows, parts=3, **kw):
    frame = spark.createDataFrame([(i, y, v, 1, "x") for i, y, v in rows], SCHEMA).repartition(parts)
    return sorted(str(tuple(r)) for r in h.mine(frame, **kw).collect())


@pytest.mark.parametrize("block,intervals", [(4096, 8192), (16, 8192), (16, 3)])
def test_against_all_scores(spark, monkeypatch, block, intervals):
    monkeypatch.setattr(h, "BLOCK_ROWS", block)
    monkeypatch.setattr(h, "INTERVALS", intervals)
    monkeypatch.setattr(h, "TILE", 3)
    rows = odd_rows()
    assert mined(spark, rows) == brute(rows)


def test_other_parameters(spark):
    rows = [(k, k % 2, v) for k, v in enumerate(vectors(120, 4, 5))]
    got = mined(spark, rows, anchors_every=7, positives=2, negatives=4, low=10, high=100)
    assert got == brute(rows, 7, 2, 4, 10, 100)


def test_large_components(spark):
    rows = [(k, k % 2, [300.0 * x for x in v]) for k, v in enumerate(vectors(100, 4, 6))]
    assert mined(spark, rows) == brute(rows)  # beyond what products of 32-bit floats hold
    with pytest.raises(ValueError, match="too large"):
        mined(spark, [(0, 0, [1e9]), (1, 0, [1.0])])


def test_small_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(50, 1, [1.0, 2.0])]) == []
    assert mined(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9])]) == brute([(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9])])


def test_bounds_hold_and_exclude(spark, monkeypatch):
    """Every row's score is within its interval's bounds; on clustered vectors most intervals are let go."""
    monkeypatch.setattr(h, "BLOCK_ROWS", 64)
    rows = [(k, k % 2, v) for k, v in enumerate(vectors(4000, 8, 3, clusters=40))]
    frame = spark.createDataFrame([(i, y, [float(x) for x in v]) for i, y, v in rows], "vec_id long, label long, vector array<double>")
    shape = h.measure(frame, 256.0)
    pivots = h.fit_pivots(frame, shape, 256.0)
    index = h.build_index(frame, shape, pivots, 256.0)
    directory = h.Directory.of(index, pivots, shape)
    queries = h.rows_of(index, shape, 50)
    q = np.stack([np.frombuffer(r.vector, shape.dtype) for r in queries.collect()]).astype(float)
    _, worst, best = directory.bounds(q)
    held = {i: k for k, i in enumerate(directory.interval.tolist())}
    order = []
    for r in index.collect():
        x = np.frombuffer(r.vectors, shape.dtype).reshape(r.n, -1).astype(float)
        s, k = q @ x.T, held[r.interval]
        assert (s.max(axis=1) <= best[:, k]).all() and (s.min(axis=1) >= worst[:, k]).all()
        order.append(s)
    kth = np.sort(np.concatenate(order, axis=1), axis=1)[:, -5]
    assert (best >= kth[:, None]).mean() < 0.3
    assert index.agg({"n": "sum"}).first()[0] == 4000


def test_large_tables_are_not_broadcast(spark, monkeypatch):
    """No join is planned as a broadcast (files are smaller than their rows, so Spark's estimate would let queries and
    results grow on the driver), and intervals are bounded whatever the number of partitions."""
    plans, intervals = [], []
    write, of = h.staged, h.Directory.of
    monkeypatch.setattr(h, "staged", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    monkeypatch.setattr(h.Directory, "of", lambda *a: intervals.append(len((d := of(*a)).interval)) or d)
    monkeypatch.setattr(h, "BLOCK_ROWS", 16)
    monkeypatch.setattr(h, "INTERVALS", 3)
    monkeypatch.setattr(h, "PIVOTS", 2)
    monkeypatch.setattr(h, "PACK_BYTES", 1)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    rows = odd_rows()
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        found = h.mine(spark.createDataFrame([(i, y, v, 1, "x") for i, y, v in rows], SCHEMA).repartition(3))
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        assert sorted(str(tuple(r)) for r in found.collect()) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum("SortMergeJoin" in p for p in plans) > 3 and not any("Broadcast" in p for p in plans)
    assert intervals[0] <= 2 * 3 + 2


def test_floors_rise_from_block_to_block():
    """What a block gave ``k`` rows of bounds the rows that the interval's next block may add."""
    none = np.zeros(0)
    directory = h.Directory(none, none, none, none, np.zeros((1, 2)), 100.0)
    x = np.arange(1, 9, dtype="<i2")
    pack = {
        "uids": np.array([h.UID_STEP * 5], "<i8").tobytes(), "q_labels": np.array([1], "<i8").tobytes(), "q_vectors": np.array([1], "<i2").tobytes(), "caps": np.array([[1 << 62, 6]], "<i8").tobytes(),
        "floors": np.full((1, 2), -(1 << 62)), "labels": np.full(8, 2, "<i8").tobytes(), "vectors": x.tobytes(), "block": 0, "pivot": 0, "low": 0.0, "high": 100.0,
    }
    run = lambda: {int(slot[0]): score.tolist() for _, slot, score, _ in h._best_of(pack, directory, np.dtype("<i2"), np.float64, 3, False, 4)}
    assert run() == {0: [8, 7, 6], 1: [6, 5, 4]} and pack["floors"].tolist() == [[6, 4]]
    pack["vectors"] = (x - 2).tobytes()  # scores from -1 to 6
    assert run() == {0: [6], 1: [6, 5, 4]}  # ties count
