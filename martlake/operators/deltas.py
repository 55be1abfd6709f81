"""Sales by day kept up to date by signed rows.

A batch replaces versions of orders. Each replaced or retracted version counts as a negative row and each new one as a
positive row; added up by day and customer they're the change of the customer days, of which only the touched ones are
read. A customer counts for a day while it has orders there, so distinct customers change by the customer days that
begin or cease to have any. Days change by the same sums. No other order of the days is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlake.operators.marts import MONEY, TOTAL, customer_days
from martlake.operators.upsert import latest

_KEYS, _SUMS = ["date", "customer_id"], ["orders", *MONEY.values()]


def replaced(stored: DataFrame, batch: DataFrame, key: str, order_by: str, retracted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The stored versions that a batch (and keys that are retracted) makes void, and the versions that take their place.

    As in an upsert, a version counts only if it's newer than the stored one, and of several in a batch the newest does;
    retracted keys go, whatever the batch has of them.
    """
    new = latest(batch, key, order_by)
    if retracted is not None:
        gone = retracted.select(key).where(F.col(key).isNotNull()).distinct()
        new = new.join(gone, key, "left_anti")
    at = F.col("__at")
    known = stored.select(F.col(key).alias("__key"), F.col(order_by).alias("__at"), F.lit(True).alias("__known"))
    newer = F.col("__known").isNull() | (F.col(order_by) > at)
    new = new.join(known, F.col(key).eqNullSafe(F.col("__key")), "left").where(F.coalesce(newer, F.lit(False))).select(batch.columns)
    void = new.select(key)
    if retracted is not None:
        void = void.unionByName(gone)
    void = void.distinct().select(F.col(key).alias("__key"))
    return stored.join(void, F.col(key).eqNullSafe(F.col("__key")), "left_semi"), new


def changes(void: DataFrame, new: DataFrame) -> DataFrame:
    """date, customer_id and the signed sums of what void and new versions of orders add to each customer day."""
    signed = customer_days(void).select(*_KEYS, *((-F.col(c)).alias(c) for c in _SUMS)).unionByName(customer_days(new).select(*_KEYS, *_SUMS))
    return signed.groupBy(*_KEYS).agg(*(F.sum(c).alias(c) for c in _SUMS))


def _same() -> Column:
    return F.col("date").eqNullSafe(F.col("__date")) & F.col("customer_id").eqNullSafe(F.col("__customer"))


def touched(days: DataFrame, change: DataFrame) -> DataFrame:
    """Each changed customer day with its sums before and after: date, customer_id, x and x_after for each sum."""
    before = days.select(F.col("date").alias("__date"), F.col("customer_id").alias("__customer"), *(F.col(c).alias(f"__{c}") for c in _SUMS))
    both = change.join(before, _same(), "left")
    zero = {c: F.coalesce(F.col(f"__{c}"), F.lit(0)) for c in _SUMS}
    return both.select(*_KEYS, *(zero[c].alias(c) for c in _SUMS), *((zero[c] + F.col(c)).alias(f"{c}_after") for c in _SUMS))


def apply_to_customer_days(days: DataFrame, change: DataFrame) -> DataFrame:
    """The customer days after the change; those without orders go."""
    own = days.select(*_KEYS, *_SUMS).unionByName(change.select(*_KEYS, *_SUMS))
    return own.groupBy(*_KEYS).agg(*(F.sum(c).alias(c) for c in _SUMS)).where("orders > 0")


def apply_to_daily_sales(daily: DataFrame, days: DataFrame, change: DataFrame) -> DataFrame:
    """Daily sales after the change, given the customer days before it; days without orders go."""
    met = touched(days, change)
    has = lambda c: (F.col("customer_id").isNotNull() & (F.col(c) > 0)).cast("long")
    moved = met.groupBy("date").agg(
        F.sum(F.col("orders_after") - F.col("orders")).alias("orders"), F.sum(has("orders_after") - has("orders")).alias("customers"),
        *(F.sum(F.col(f"{of}_after") - F.col(of)).alias(name) for name, of in MONEY.items()),
    )
    names = ["orders", "customers", *MONEY]
    summed = daily.select("date", *names).unionByName(moved.select("date", *names)).groupBy("date").agg(F.sum("orders").alias("orders"), F.sum("customers").alias("customers"), *(F.sum(c).cast(TOTAL).alias(c) for c in MONEY))
    average = (F.col("net_revenue") / F.col("orders")).cast("decimal(12,2)").alias("average_order_value")
    return summed.where("orders > 0").select("*", average).orderBy("date")
