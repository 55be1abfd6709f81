"""Distinct counts from bitmaps, signed deltas and differences by ranges against plain aggregations."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from martlake.operators import deltas, differences, marts
from martlake.operators.distinct_counts import DistinctCounts, bitmaps, counted, new_ids
from martlake.sources.store import Store, version_diff

DAY = date(2024, 1, 1)


def events(seed, n, first=0, days=10):
    random.seed(seed)
    return [(DAY + timedelta(days=first + random.randrange(days)), random.choice(["a", "b", None]), random.choice([None, *(f"v{k}" for k in range(60))])) for _ in range(n)]


def plain(rows, key):
    out = {}
    for r in rows:
        out.setdefault(key(r), set()).update([r[2]] if r[2] is not None else [])
    return {k: len(v) for k, v in out.items()}


def test_distinct_counts_merge(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    stored = DistinctCounts(store, "gold", "things", ["channel"])
    frame = lambda rows: spark.createDataFrame(rows, "date date, channel string, value string")
    one, two, three = events(1, 200), events(2, 200, first=5), events(3, 100, first=7, days=2)
    for rows in (one, two, two):
        stored.add(frame(rows))
    stored.add(frame([]))

    def check(rows):
        assert {(r.date, r.channel): r.n for r in counted(stored.read(), ["date", "channel"], "n").collect()} == plain(rows, lambda r: (r[0], r[1]))
        assert {r.channel: r.n for r in counted(stored.read(), ["channel"], "n").collect()} == plain(rows, lambda r: r[1])
        odd = stored.read().withColumn("part", F.day("date") % 2)
        assert {r.part: r.n for r in counted(odd, ["part"], "n", F.col("channel") == "a").collect()} == plain([(x, y, z if y == "a" else None) for x, y, z in rows], lambda r: r[0].day % 2)

    check(one + two)
    span = (DAY + timedelta(days=7), DAY + timedelta(days=8))
    stored.rebuild(frame(three), *span)
    check([r for r in one + two if not span[0] <= r[0] <= span[1]] + three)
    ids = stored.ids.read()
    assert ids.count() == ids.select("id").distinct().count() == ids.select("value").distinct().count() == ids.agg(F.max("id")).first()[0]


def test_ids_are_dense_and_bitmaps_bounded(spark):
    values = spark.range(70_000).selectExpr("concat('v', id) AS value", "id DIV 1000 AS day")
    ids = new_ids(values, None, "day")
    assert ids.agg(F.min("id"), F.max("id"), F.count_distinct("id")).first() == (1, 70_000, 70_000)
    maps = bitmaps(values.join(ids, "value"), ["day"])
    assert maps.count() <= 70 + 2 and counted(maps, ["day"], "n").where("n <> 1000").count() == 0  # a day touches one bucket or two
    assert new_ids(values, ids, "day").count() == 0
    assert new_ids(spark.createDataFrame([("new",), (None,), ("new",)], "value string"), ids).collect() == [("new", 70_001)]


ORDERS = "order_id string, customer_id string, order_date timestamp, status string, gross_amount decimal(12,2), discount_amount decimal(12,2), total_amount decimal(12,2), updated_at timestamp"


def orders(rows):
    return [(i, c, datetime(2024, 1, d) if d else None, s, float(t), 0.0, float(t), datetime(2024, 2, u) if u else None) for i, c, d, s, t, u in rows]


def frame_of(spark, rows):
    kinds = "order_id string, customer_id string, order_date timestamp, status string, g double, d double, t double, updated_at timestamp"
    df = spark.createDataFrame(orders(rows), kinds)
    return df.select("order_id", "customer_id", "order_date", "status", *(F.col(a).cast("decimal(12,2)").alias(b) for a, b in (("g", "gross_amount"), ("d", "discount_amount"), ("t", "total_amount"))), "updated_at")


def test_deltas_equal_a_full_rebuild(spark):
    from martlake.operators.upsert import retract, upsert

    random.seed(11)
    any_row = lambda i: (f"o{i}", random.choice(["x", "y", "z", None]), random.choice([None, *range(1, 9)]), random.choice(["paid", "shipped", "cancelled"]), random.randrange(100), random.choice([None, *range(1, 9)]))
    stored = frame_of(spark, [any_row(i) for i in range(120)])
    batch = frame_of(spark, [any_row(random.randrange(160)) for _ in range(90)])
    gone = spark.createDataFrame([(f"o{i}",) for i in range(0, 150, 17)] + [(None,)], "order_id string")
    void, new = deltas.replaced(stored, batch, "order_id", "updated_at", gone)
    change = deltas.changes(void, new)
    after = retract(upsert(stored, batch, "order_id", "updated_at"), gone, "order_id")
    got = deltas.apply_to_daily_sales(marts.daily_sales(stored), marts.customer_days(stored), change)
    assert got.collect() == marts.daily_sales(after).select(got.columns).collect()
    days = deltas.apply_to_customer_days(marts.customer_days(stored), change)
    assert sorted(map(str, days.collect())) == sorted(map(str, marts.customer_days(after).select(days.columns).collect()))
    # what is read of the customer days are those that change
    assert deltas.touched(marts.customer_days(stored), change).count() == change.count() < 100


def test_a_day_that_changes_touches_its_customer_days_only(spark):
    rows = [(f"o{i}", f"c{i % 50}", 1 + i % 28, "paid", 1, 1) for i in range(5000)]
    stored, batch = frame_of(spark, rows), frame_of(spark, [("o28", "c28", 1, "paid", 9, 2)])
    change = deltas.changes(*deltas.replaced(stored, batch, "order_id", "updated_at"))
    assert deltas.touched(marts.customer_days(stored), change).count() == 1 < marts.customer_days(stored).count()


@pytest.mark.parametrize("few,cuts", [(1000, 32), (2, 2), (1, 5)])
def test_differences_equal_the_full_join(spark, monkeypatch, few, cuts):
    monkeypatch.setattr(differences, "FEW", few)
    monkeypatch.setattr(differences, "CUTS", cuts)
    random.seed(2)
    rows = [(DAY + timedelta(days=k) if k % 50 else None, float(k), "x") for k in range(400)]
    changed = [(d, v + (1 if k in (17, 18, 333) else 0), "y") for k, (d, v, _) in enumerate(rows) if k != 200] + [(DAY + timedelta(days=900), 1.0, "x")]
    random.shuffle(changed)
    old, new = (spark.createDataFrame(r, "date date, v double, other string") for r in (rows, changed))
    got = [(r.date, r.before, r.after) for r in version_diff(old, new, "date", "v").collect()]
    assert got == [(DAY + timedelta(days=k), float(k), float(k + 1)) for k in (17, 18, 333)]
    assert version_diff(old, old, "date", "v").count() == 0 and version_diff(old.limit(0), new.limit(0), "date", "v").count() == 0


def test_one_changed_day_reads_one_range(spark):
    old = spark.range(20_000).selectExpr("date_add(date'1950-01-01', int(id)) AS date", "id * 3 AS v")
    new = old.withColumn("v", F.when(F.col("date") == date(1970, 5, 5), -1).otherwise(F.col("v")))
    before, after, spans = differences.differing_rows(old, new, "date", ["v"])
    assert len(spans) == 1 and spans[0].rows <= differences.FEW
    assert before.count() == after.count() < 600 and version_diff(old, new, "date", "v").count() == 1
    every = differences.differing_rows(old, old.withColumn("v", F.col("v") + 1), "date", ["v"])
    assert every[0].count() == 20_000  # where all differs, all is compared


def test_unreconciled_days(spark):
    rows = [(f"o{i}", f"c{i % 7}", 1 + i % 20, random.choice(["paid", "cancelled"]), i, 1) for i in range(400)]
    sold = frame_of(spark, rows)
    gold = marts.daily_sales(sold)
    assert differences.unreconciled_days(gold, sold).count() == 0
    off = gold.where("day(date) <> 4").withColumn("net_revenue", F.when(F.day("date") == 9, F.col("net_revenue") - 2).otherwise(F.col("net_revenue")).cast("decimal(22,2)"))
    out = differences.unreconciled_days(off, sold).collect()
    assert [(r.date.day, r.gold is None) for r in out] == [(4, True), (9, False)] and out[1].difference == -2
