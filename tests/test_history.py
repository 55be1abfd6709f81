from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from martlake.operators import history as h
from martlake.operators.upsert import latest, replace_where, retract, update_where, upsert

T0, T1, T2 = datetime(2026, 1, 1), datetime(2026, 3, 1), datetime(2026, 6, 1)
LOG = "customer_id string, country string, city string, updated_at timestamp"


def log(spark, *rows):
    return spark.createDataFrame(list(rows), LOG)


def state(df):
    return sorted(((r.customer_id, r.country, r.valid_from, r.valid_to, r.is_current) for r in df.collect()), key=str)


def test_a_change_closes_and_opens(spark):
    start = h.replay(log(spark, ("1", "MX", "a", T0), ("2", "ES", None, T0)), "customer_id", "updated_at")
    after = h.apply_history(start, log(spark, ("1", "ES", "a", T1), ("3", "US", "b", T1)), "customer_id", "updated_at")
    assert state(after) == [("1", "ES", T1, None, True), ("1", "MX", T0, T1, False), ("2", "ES", T0, None, True), ("3", "US", T1, None, True)]
    again = h.apply_history(after, log(spark, ("1", "ES", "a", T1), ("3", "US", "b", T1)), "customer_id", "updated_at")
    assert state(again) == state(after)


def test_equal_versions_collapse_and_null_is_a_value(spark):
    out = h.replay(log(spark, ("1", "MX", None, T0), ("1", "MX", None, T1), ("1", None, None, T2)), "customer_id", "updated_at")
    assert state(out) == [("1", "MX", T0, T2, False), ("1", None, T2, None, True)]


def test_a_late_version(spark):
    start = h.replay(log(spark, ("1", "MX", "a", T0), ("1", "US", "a", T2)), "customer_id", "updated_at")
    late = log(spark, ("1", "ES", "a", T1))
    assert state(h.apply_history(start, late, "customer_id", "updated_at")) == state(start)
    kept = h.apply_history(start, late, "customer_id", "updated_at", keep_late=True)
    assert [r[1:4] for r in state(kept)] == [("ES", T1, T2), ("MX", T0, T1), ("US", T2, None)]


def test_missing_keys_and_times_are_left_out(spark):
    assert h.replay(log(spark, (None, "MX", "a", T0), ("1", "MX", "a", None)), "customer_id", "updated_at").count() == 0


def test_initialise_current_as_of(spark):
    one = h.initialise(log(spark, ("1", "MX", "a", T0)), "updated_at")
    assert state(one) == [("1", "MX", T0, None, True)] and "updated_at" not in one.columns
    whole = h.replay(log(spark, ("1", "MX", "a", T0), ("1", "ES", "a", T1)), "customer_id", "updated_at")
    assert [r.country for r in h.current(whole).collect()] == ["ES"]
    assert [r.country for r in h.as_of(whole, datetime(2026, 2, 1)).collect()] == ["MX"]
    assert [r.country for r in h.as_of(whole, "2026-03-01").collect()] == ["ES"] and h.as_of(whole, datetime(2025, 1, 1)).count() == 0


def test_join_as_of(spark):
    dim = h.replay(log(spark, ("1", "MX", "a", T0), ("1", "ES", "a", T1)), "customer_id", "updated_at")
    facts = spark.createDataFrame([("a", "1", datetime(2026, 2, 1)), ("b", "1", datetime(2026, 4, 1)), ("c", "9", T1), ("d", "1", datetime(2020, 1, 1)), ("e", "1", T1)], "order_id string, customer_id string, order_date timestamp")
    out = h.join_as_of(facts, dim, "customer_id", "order_date")
    assert {r.order_id: r.country for r in out.collect()} == {"a": "MX", "b": "ES", "c": None, "d": None, "e": "ES"}
    assert out.columns == ["order_id", "customer_id", "order_date", "country", "city"]
    assert "NestedLoop" not in out._jdf.queryExecution().toString()


def test_batches_in_a_row_keep_the_plan_small(spark):
    """Each batch reads the history once and deals it out once."""
    out, sizes = h.replay(log(spark, ("1", "MX", "a", T0)), "customer_id", "updated_at"), []
    for k in range(4):
        out = h.apply_history(out, log(spark, ("1", f"C{k}", "a", datetime(2026, 2, k + 1))), "customer_id", "updated_at")
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        sizes.append((plan.count("LogicalRDD") + plan.count("LocalRelation"), plan.count("Window")))
    assert sizes[3][0] - sizes[2][0] == sizes[1][0] - sizes[0][0] == 1 and sizes[3][1] - sizes[2][1] == sizes[1][1] - sizes[0][1]
    assert out.count() == 5


versions = st.lists(st.tuples(st.sampled_from("12"), st.sampled_from(["MX", "ES", None]), st.integers(1, 6)), max_size=10, unique_by=lambda v: (v[0], v[2]))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(versions)
def test_histories_have_no_gaps_and_batches_equal_a_replay(spark, rows):
    rows = [(k, c, "x", datetime(2026, 1, d)) for k, c, d in rows]
    whole = h.replay(log(spark, *rows), "customer_id", "updated_at")
    by = {}
    for r in sorted(whole.collect(), key=lambda r: r.valid_from):
        by.setdefault(r.customer_id, []).append(r)
    for own in by.values():
        assert [r.is_current for r in own] == [False] * (len(own) - 1) + [True]
        assert all(a.valid_to == b.valid_from and a.country != b.country for a, b in zip(own, own[1:]))
    early, late = [r for r in rows if r[3].day <= 3], [r for r in rows if r[3].day > 3]
    stepped = h.apply_history(h.replay(log(spark, *early), "customer_id", "updated_at"), log(spark, *late), "customer_id", "updated_at")
    assert state(stepped) == state(whole)


ORDERS = "order_id string, status string, updated_at string"


def orders(spark, *rows):
    return spark.createDataFrame(list(rows), ORDERS)


def test_latest(spark):
    df = orders(spark, ("1", "a", "1"), ("1", "b", "2"), ("2", "c", None), ("2", "d", "0"), ("3", "e", "1"), ("3", "f", "1"))
    out = {r.order_id: r.status for r in latest(df, "order_id", "updated_at").collect()}
    assert out["1"] == "b" and out["2"] == "d" and out["3"] in "ef"
    assert {r.order_id: r.status for r in latest(df.repartition(3), "order_id", "updated_at").collect()} == out
    assert latest(df, ["order_id", "status"], "updated_at").count() == 6


def test_upsert(spark):
    target = orders(spark, ("1", "delivered", "5"), ("2", "paid", "1"), ("4", "x", None))
    source = orders(spark, ("1", "pending", "3"), ("2", "shipped", "2"), ("2", "paid", "1"), ("3", "new", "1"), ("4", "y", "9"))
    once = upsert(target, source, "order_id", "updated_at")
    want = {("1", "delivered"), ("2", "shipped"), ("3", "new"), ("4", "x")}
    assert {(r.order_id, r.status) for r in once.collect()} == want
    assert {(r.order_id, r.status) for r in upsert(once, source, "order_id", "updated_at").collect()} == want
    fixed = upsert(orders(spark, ("1", "a", "1")), orders(spark, ("1", "b", "2"), ("2", "c", "1")), "order_id", "order_id")
    assert {(r.order_id, r.status) for r in fixed.collect()} == {("1", "a"), ("2", "c")}


def test_retract_update_replace(spark):
    df = orders(spark, ("1", "a", "1"), ("2", "b", "2"), ("3", None, "3"))
    assert {r.order_id for r in retract(df, orders(spark, ("2", "z", "0"), (None, "z", "0")), "order_id").collect()} == {"1", "3"}
    assert [r.status for r in update_where(df, "status = 'a'", {"status": "upper(status)"}).orderBy("order_id").collect()] == ["A", "b", None]
    new = orders(spark, ("9", "a", "9"))
    assert {r.order_id for r in replace_where(df, new, "status = 'a'").collect()} == {"9", "2", "3"}
    with pytest.raises(Exception, match="doesn't meet"):
        replace_where(df, orders(spark, ("9", "q", "9")), "status = 'a'").collect()
