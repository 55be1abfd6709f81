"""Selection by pivots, tiles, weighted ranks and prefix sums against sorted rows and window functions."""

import os
import random

import pytest
from pyspark.sql import functions as F

from martlake.functions import order_statistics as o
from martlake.functions import staging
from martlake.functions.numbering import hot_values, percent_rank
from martlake.functions.order_statistics import By


def rows_of(n, seed=1):
    random.seed(seed)
    values = [None, 0.0, -1.5, float("nan"), 7.0, float("inf"), *(random.gauss(0, 100) for _ in range(n))]
    return [(random.choice(values) if random.random() < 0.5 else 3.0, f"k{random.randrange(10**6):06d}", k) for k in range(n)]


def in_order(df, by):
    return [tuple(r) for r in df.select(*(k.column for k in by)).orderBy(*(k.order() for k in by)).collect()]


@pytest.mark.parametrize("few,pivots", [(2048, 32), (3, 2), (1, 1), (1, 7)])
def test_selected_keys_are_those_of_the_sorted_rows(spark, monkeypatch, few, pivots):
    monkeypatch.setattr(o, "FEW", few)
    monkeypatch.setattr(o, "PIVOTS", pivots)
    df = spark.createDataFrame(rows_of(400), "v double, k string, n int").repartition(3)
    orders = {"up": [By("v"), By("k")], "down": [By("v", True), By("k", True)], "ties": [By("v")], "n": [By("n", True)]}
    ranks = [0, 1, 2, 80, 160, 161, 240, 399, 400, 401]
    total, found = o.select_ranks(df, orders, lambda n: ranks)
    assert total == 400
    for name, by in orders.items():
        keys = in_order(df, by)
        assert {r: repr(k) for r, k in found[name].items()} == {r: repr(keys[r - 1]) for r in ranks if 1 <= r <= 400}
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_other_types(spark):
    df = spark.range(500).selectExpr("cast(id % 37 - 10 as decimal(20,2)) / 7 AS d", "date_add(date'2020-01-01', int(id % 91)) AS day", "timestamp_seconds(id * 977 % 5000) AS t", "if(id % 5 = 0, null, concat('é', id % 13)) AS s", "id % 2 = 0 AS b")
    for c in df.columns:
        for by in ([By(c)], [By(c, True), By("t")]):
            found = o.select_ranks(df, {"x": by}, lambda n: [1, 100, 101, 250, n])[1]["x"]
            keys = in_order(df, by)
            assert all(found[r] == keys[r - 1] for r in (1, 100, 101, 250, 500))


@pytest.mark.parametrize("n", [0, 1, 3, 5, 7, 40, 301])
def test_tiles_equal_ntile(spark, n):
    df = spark.range(n).select(F.when(F.col("id") % 4 > 0, (F.col("id") * 7) % 11).alias("v"), F.col("id").alias("k")).repartition(3)
    got = o.with_tiles(df, 5, {"a": [By("v"), By("k")], "b": [By("v", True), By("k")]})
    want = df.selectExpr("*", "ntile(5) OVER (ORDER BY v, k) AS a", "ntile(5) OVER (ORDER BY v DESC, k) AS b")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_tiles_compare_rows_only(spark, tmp_path):
    """Neither exchange nor window: rows are compared with a few bounds."""
    spark.range(1000).selectExpr("id AS k", "id * 37 % 101 AS v").write.parquet(str(tmp_path / "t"))
    plan = o.with_tiles(spark.read.parquet(str(tmp_path / "t")), 5, {"a": [By("v"), By("k")]})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("n", [0, 1, 2, 50, 600])
def test_percent_rank_equals_the_window(spark, n, descending):
    df = spark.createDataFrame(rows_of(n, 3), "v double, k string, n int").repartition(3)
    got = percent_rank(df, "p", "v", descending)
    want = df.selectExpr("*", f"percent_rank() OVER (ORDER BY v {'DESC' if descending else 'ASC'}) AS p")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.columns == ["v", "k", "n", "p"]


def test_tied_scores_are_dealt_out(spark):
    """Nine tenths of the rows have one score; no task reads over twice what the median task reads."""
    df = spark.range(40_000).selectExpr("id", "if(id % 10 = 0, id, -1) AS v")
    before = {c: spark.conf.get(c, None) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = percent_rank(df, "p", "v")
        sizes = sorted(r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect())
        assert sum(sizes) == 40_000 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
        assert out.where("v = -1").select("p").distinct().count() == 1
    finally:
        for c, x in before.items():
            spark.conf.unset(c) if x is None else spark.conf.set(c, x)
    hot = hot_values(df.groupBy(F.col("v").alias("value")).agg(F.count(F.lit(1)).alias("n")), 4).collect()
    assert len(hot) == 1 and hot[0].value == -1 and 50 < hot[0].pieces <= 64


def test_prefix_sums(spark, monkeypatch):
    monkeypatch.setattr(o, "RANGES", 5)
    random.seed(5)
    rows = [(v, random.randrange(9), random.random()) for v in [None, *range(-50, 50)]]
    df = spark.createDataFrame(rows, "v int, n int, x double")
    for descending in (False, True):
        got = {r.v: (r.before_n, r.before_x) for r in o.prefix_sums(df, By("v", descending), ["n", "x"]).collect()}
        ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=descending)
        for k, (v, _, _) in enumerate(ordered):
            assert got[v] == (sum(r[1] for r in ordered[:k]), pytest.approx(sum(r[2] for r in ordered[:k])))


def test_what_was_written_on_the_way_goes(spark):
    df = staging.fixed(spark.range(10))
    path = staging._written[-1][1]
    assert df.count() == 10 and os.path.isdir(path.removeprefix("file://"))
    staging.clear()
    assert not os.path.exists(path.removeprefix("file://")) and not staging._written
