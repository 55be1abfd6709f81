from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlake.functions import cleaning as c
from martlake.sources import contracts


def landing(spark):
    rows = [("O1", " C1 ", "2026-01-15 10:00:00", " DELIVERED ", "10.50", "2026-01-16 00:00:00"), ("O2", "C2", "not-a-date", "paid", "20", None), ("O3", None, None, None, "12.345", None)]
    return spark.createDataFrame(rows, "order_id string, customer_id string, order_date string, status string, total_amount string, updated_at string")


def test_trim_and_normalise(spark):
    out = c.normalise(c.trim(landing(spark), ["customer_id", "absent"]), ["status"]).collect()
    assert [(r.customer_id, r.status) for r in out] == [("C1", "delivered"), ("C2", "paid"), (None, None)]


def test_cast_errors_are_found_before_casting(spark):
    out = c.combine_errors(c.cast_to_contract(c.with_cast_errors(landing(spark), "orders"), "orders"))
    assert [r._errors for r in out.orderBy("order_id").collect()] == [[], ["order_date"], []]
    assert dict(out.dtypes)["total_amount"] == "decimal(12,2)"
    first = out.orderBy("order_id").first()
    assert first.order_date == datetime(2026, 1, 15, 10) and first.total_amount == Decimal("10.50")


@pytest.mark.parametrize("text,kind,value", [("", "timestamp", None), ("N/A", "timestamp", None), ("0000-00-00 00:00:00", "timestamp", None), ("2026-13-45 99:99:99", "timestamp", None), (" 12 ", "int", 12), ("12.345", "decimal(10,2)", Decimal("12.35")), ("1e3", "decimal(10,2)", Decimal("1000.00")), ("T", "boolean", True), ("x", "int", None)])
def test_safe_cast(spark, text, kind, value):
    assert spark.createDataFrame([(text,)], "t string").select(c.safe_cast("t", kind).alias("v")).first().v == value


def test_quarantine_is_a_partition(spark):
    df = c.cast_to_contract(c.with_cast_errors(landing(spark), "orders"), "orders").withColumn(c.RULE_ERRORS, F.when(F.col("order_id") == "O3", F.array(F.lit("x:y"))))
    valid, rejected = c.split_quarantine(df)
    assert {r.order_id for r in valid.collect()} == {"O1"} and {r.order_id: r._errors for r in rejected.collect()} == {"O2": ["order_date"], "O3": ["x:y"]}
    assert c.ERRORS not in valid.columns
    plain = c.combine_errors(landing(spark))
    assert [r._errors for r in plain.collect()] == [[], [], []]


def test_contracts():
    assert set(contracts.CONTRACTS) == {"customers", "products", "orders", "order_items", "payments", "returns", "reviews", "web_events"}
    for x in contracts.CONTRACTS.values():
        assert x.key == x.columns[0] and x.version in x.columns and not set(x.columns) & set(contracts.LINEAGE)
        assert not any(isinstance(f.dataType, (T.FloatType, T.DoubleType)) for f in x.schema)
        assert x.landing().names == x.columns and all(isinstance(f.dataType, T.StringType) and f.nullable for f in x.landing())
        assert [f.name for f in x.schema if not f.nullable] == [x.key]
    assert {n for n, x in contracts.CONTRACTS.items() if x.history} == {"customers", "products"}
    assert "updated_at" not in contracts.history_schema("customers").names and contracts.history_schema("customers").names[-3:] == ["valid_from", "valid_to", "is_current"]
    with pytest.raises(ValueError):
        contracts.contract("nothing")
    with pytest.raises(ValueError):
        contracts._contract("x", "a string, b double")


def test_projection_drops_lineage(spark):
    df = spark.createDataFrame([tuple("abcdefgh") + ("r",)], ", ".join(f"{n} string" for n in [*contracts.contract("web_events").columns, "_batch_id"]))
    assert c.to_contract(df, "web_events").columns == contracts.contract("web_events").columns
