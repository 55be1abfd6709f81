"""Rows marked by key sets, small and large, against Python sets; the filter's rate."""

import random

import pytest
from pyspark.sql import functions as F

from martlake.operators import membership as m


@pytest.mark.parametrize("most", [1 << 17, 0])
@pytest.mark.parametrize("key", [["k"], ["k", "b c"]])
def test_marks_are_exact(spark, monkeypatch, most, key):
    monkeypatch.setattr(m, "BROADCAST_KEYS", most)
    random.seed(3)
    values = [None, "", "a", "b", *map(str, range(200))]
    rows = [(random.choice(values), random.choice([None, 1, 2, 3]), n) for n in range(2000)]
    df = spark.createDataFrame(rows, "k string, `b c` int, n int").repartition(4)
    width = len(key)
    members = {tuple(r[:width]) for r in random.sample(rows, 60)} | {(None,) * width}
    keys = spark.createDataFrame(list(members), ", ".join(f"x{i} {t}" for i, t in enumerate(["string", "int"][:width])))
    out = m.mark_members(df, key, keys, "found")
    assert out.columns == ["k", "b c", "n", "found"]
    assert [tuple(r) for r in out.orderBy("n").collect()] == [(*r, tuple(r[:width]) in members) for r in rows]
    assert m.mark_members(df, key, keys.limit(0), "found").where("found").count() == 0


def test_false_positives_and_bounds(spark, monkeypatch):
    """No key of the set is missed; of the others about as many pass as the filter's size promises, also beyond its bound."""
    keys = spark.range(20_000).selectExpr("concat('k', id) AS k")
    others = spark.range(20_000).selectExpr("concat('o', id) AS k")
    rates = []
    for most in (4096, 2):
        monkeypatch.setattr(m, "MOST_BLOCKS", most)
        blocks = m.blocks_for(20_000)
        bloom = m.bloom_filter(keys, blocks)
        assert bloom.count() == blocks == (8 if most > 8 else 2) and bloom.where("length(bits) <> 4096").count() == 0
        assert m.passing(keys, ["k"], bloom, blocks, "p").where("NOT p").count() == 0
        rates.append(m.passing(others, ["k"], bloom, blocks, "p").where("p").count() / 20_000)
    assert rates[0] < 0.02 and rates[0] < rates[1] < 0.7
    assert m.blocks_for(0) == 1 and m.blocks_for(10**15) == 2


def test_rows_that_cannot_match_are_not_shuffled(spark, monkeypatch, tmp_path):
    """Of rows without offending keys hardly any reaches the exchange of the exact join."""
    monkeypatch.setattr(m, "BROADCAST_KEYS", 100)
    spark.range(100_000).selectExpr("id % 5000 AS k", "id AS n").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    keys = spark.range(10_000, 10_500).selectExpr("id AS k").union(spark.range(20).selectExpr("id AS k"))
    blocks = m.blocks_for(520)
    passed = m.passing(df, ["k"], m.bloom_filter(keys, blocks), blocks, "p").where("p").count()
    assert 400 <= passed < 5000  # the 400 rows that match, and below 5 % of all
    out = m.mark_members(df, ["k"], keys, "found")
    assert out.where("found").count() == 400 and out.count() == 100_000
    assert out.where("found").agg(F.max("k")).first()[0] == 19
