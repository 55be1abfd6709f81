"""Hot keys: histories and point-in-time joins in slices equal those in one piece; latest rows without windows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from martlake.functions import timelines as tl
from martlake.operators import history as h
from martlake.operators import upsert as u

START = datetime(2020, 1, 1)
LOG = "k string, at timestamp, a string, b int"


def log_of(n, seed=1, hot=0.6):
    random.seed(seed)
    rows = []
    for _ in range(n):
        key = "hot" if random.random() < hot else random.choice(["x", "y", "z", None])
        rows.append((key, START + timedelta(minutes=random.randrange(3 * n)) if random.random() < 0.98 else None, random.choice(["p", "p", None]), random.choice([1, 1, 1, 2])))
    return rows


def collected(df, *drop):
    return sorted(map(str, df.drop(*drop).collect()))


@pytest.fixture
def hot(monkeypatch):
    def few(rows):
        monkeypatch.setattr(tl, "HOT_ROWS", rows)

    return few


def test_cuts(spark, hot):
    df = spark.createDataFrame(log_of(900), LOG)
    assert tl.hot_cuts(df, "k", "at") is None
    hot(50)
    rows = tl.hot_cuts(df, "k", "at").collect()
    assert [r[0] for r in rows] == ["hot"] and len(rows[0][1]) >= 2 and rows[0][1] == sorted(rows[0][1])
    sliced = tl.with_slices(df, tl.hot_cuts(df, "k", "at"), "k", "at")
    sizes = {(r.k, r["__slice"]): r.n for r in sliced.where("at IS NOT NULL").groupBy("k", "__slice").agg(F.count(F.lit(1)).alias("n")).collect()}
    own = [n for (k, _), n in sizes.items() if k == "hot"]
    assert len(own) == len(rows[0][1]) + 1 and max(own) < 1.3 * min(own)  # dealt out evenly
    assert {s for k, s in sizes if k != "hot"} == {0}


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_in_slices(spark, hot, seed):
    log = spark.createDataFrame(log_of(600, seed), LOG).repartition(3)
    whole = collected(h.replay(log, "k", "at"))
    hot(20)
    assert collected(h.replay(log, "k", "at")) == whole and len(whole) > 100
    same = spark.createDataFrame([("hot", START + timedelta(days=k), "p", 1) for k in range(200)], LOG)
    (r,) = h.replay(same, "k", "at").collect()  # equal versions collapse over all slices
    assert (r.valid_from, r.valid_to, r.is_current) == (START, None, True)


@pytest.mark.parametrize("late", [False, True])
def test_incremental_history_in_slices(spark, hot, late):
    rows = log_of(500, 4)
    first, second = (spark.createDataFrame(rows[s], LOG) for s in (slice(0, 350), slice(300, 500)))
    start = h.replay(first, "k", "at")
    whole = collected(h.apply_history(start, second, "k", "at", keep_late=late))
    hot(20)
    once = h.apply_history(start, second, "k", "at", keep_late=late)
    assert collected(once) == whole
    assert collected(h.apply_history(once, second, "k", "at", keep_late=late)) == whole  # idempotent


def facts_of(n, seed=3):
    random.seed(seed)
    keys = ["hot", "hot", "hot", "x", "y", "none", None]
    return [(k, random.choice(keys), START + timedelta(minutes=random.choice([500, 500, random.randrange(-100, 2 * n)])) if random.random() < 0.95 else None) for k in range(n)]


@pytest.mark.parametrize("hot_rows", [20, 100_000])
def test_stream_equals_join(spark, hot, hot_rows):
    dimension = h.replay(spark.createDataFrame(log_of(400, 6), LOG), "k", "at")
    gone = (F.col("k") == "x") & (F.minute("valid_from") % 3 == 0)  # gaps: versions that ended before the next began
    dimension = dimension.withColumn("valid_to", F.when(gone, F.col("valid_from") + F.expr("INTERVAL 1 MINUTE")).otherwise(F.col("valid_to")))
    facts = spark.createDataFrame(facts_of(800), "id int, k string, moment timestamp").repartition(4)
    want = collected(h.join_as_of(facts, dimension, "k", "moment"))
    hot(hot_rows)
    got = h.join_as_of(facts, dimension, "k", "moment", method="auto")
    assert got.columns == ["id", "k", "moment", "a", "b"] and collected(got) == want and len(want) == 800
    assert collected(h.join_as_of(facts.limit(0), dimension, "k", "moment", method="stream")) == []
    assert collected(h.join_as_of(facts, dimension.limit(0), "k", "moment", method="stream"), "a", "b") == collected(facts)
    with pytest.raises(ValueError):
        h.join_as_of(facts, dimension, "k", "moment", method="best")


def test_half_of_all_facts_on_a_product_of_a_thousand_versions(spark, hot):
    """No fact meets all versions of its product, and no group of one task has much more than its share."""
    hot(500)
    versions = spark.range(1000).selectExpr("'hot' AS k", "timestamp'2020-01-01' + make_interval(0, 0, 0, int(id)) AS valid_from", "timestamp'2020-01-01' + make_interval(0, 0, 0, int(id) + 1) AS valid_to", "id = 999 AS is_current", "id AS price")
    facts = spark.range(20_000).selectExpr("id", "if(id % 2 = 0, 'hot', concat('p', id)) AS k", "timestamp'2020-01-01' + make_interval(0, 0, 0, int(id * 7919 % 1000), 5) AS moment")
    got = h.join_as_of(facts, versions, "k", "moment", method="auto")
    assert got.where("k = 'hot' AND price = id * 7919 % 1000").count() == 10_000 and got.where("k <> 'hot' AND price IS NULL").count() == 10_000
    cuts = tl.hot_cuts(facts, "k", "moment")
    share = 20_000 // int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = tl.with_slices(facts, cuts, "k", "moment", spread=True).groupBy("k", "__slice").agg(F.count(F.lit(1)).alias("n"))
    assert groups.agg(F.max("n")).first()[0] <= 1.1 * share
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "valid_from" not in "".join(line for line in plan.splitlines() if "Join" in line and "__slice" not in line and "__cut_key" not in line)


def test_many_facts_at_one_time_are_dealt_out(spark, hot):
    hot(100)
    facts = spark.range(4000).selectExpr("id", "'hot' AS k", "timestamp'2020-01-02' AS moment")
    groups = tl.with_slices(facts, tl.hot_cuts(facts, "k", "moment"), "k", "moment", spread=True).groupBy("__slice").count().collect()
    assert len(groups) >= 4 and max(r["count"] for r in groups) <= 1100
    versions = spark.createDataFrame([("hot", START, None, True, "old"), ("hot", datetime(2020, 1, 2), None, True, "new")], "k string, valid_from timestamp, valid_to timestamp, is_current boolean, v string")
    assert h.join_as_of(facts, versions, "k", "moment", method="stream").where("v = 'new'").count() == 4000


def by_window(df, key, order_by):
    w = Window.partitionBy(*key).orderBy(F.col(order_by).desc_nulls_last(), F.col("__d"))
    return df.withColumn("__d", u.row_digest(df)).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__d")


def test_latest_is_an_aggregation(spark):
    random.seed(9)
    rows = [(random.choice(["a", "b", None]), random.randrange(8), random.choice([None, 1, 2, 3]), random.random(), [k]) for k in range(300)]
    df = spark.createDataFrame(rows, "`k 1` string, j int, at int, x double, l array<int>").repartition(3)
    for key in (["k 1"], ["k 1", "j"]):
        out = u.latest(df, key, "at")
        assert collected(out) == collected(by_window(df, [f"`{k}`" for k in key], "at")) and out.columns == df.columns
    plan = u.latest(df, "j", "at")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_max_by" in plan and plan.count("hashpartitioning") == 1
    many = spark.range(1000).selectExpr("0 AS k", "id AS at")
    assert u.latest(many, "k", "at").collect() == [(0, 999)]


def test_upsert_is_an_aggregation(spark):
    target = spark.createDataFrame([("a", 5, "t"), ("b", None, "t"), ("c", 3, "t"), (None, 1, "t")], "k string, at int, v string")
    source = spark.createDataFrame([("s", 6, "a"), ("s", 9, "b"), ("s", 3, "c"), ("late", 2, "c"), ("s", None, "d"), ("s", 2, "d"), ("s", 2, None), ("s", None, "e")], "v string, at int, k string")
    out = u.upsert(target, source, "k", "at")
    want = {"a": (6, "s"), "b": (None, "t"), "c": (3, "t"), "d": (2, "s"), "e": (None, "s"), None: (2, "s")}
    assert {r.k: (r.at, r.v) for r in out.collect()} == want and out.columns == ["k", "at", "v"]
    assert collected(u.upsert(out, source, "k", "at")) == collected(out)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_replace_where_tests_new_rows_whatever_is_read(spark):
    old, new = (spark.createDataFrame(r, "a int, b int") for r in ([(1, 1), (2, 2)], [(3, 2), (4, 9)]))
    with pytest.raises(Exception, match="doesn't meet b = 2"):
        u.replace_where(old, new, "b = 2").select("b").collect()
    assert sorted(map(tuple, u.replace_where(old, new.where("b = 2"), "b = 2").collect())) == [(1, 1), (3, 2)]
