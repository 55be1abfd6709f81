"""Latest-row selection and guarded upserts as aggregations: a key's rows are reduced before the one shuffle on the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def row_digest(df: DataFrame) -> Column:
    """A hash of the whole row, to break ties the same way in every run."""
    return F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))


def greatest_row(df: DataFrame, keys: list[str], columns: list[str], *rank: Column) -> DataFrame:
    """For each key the columns of the row of greatest rank. Every task keeps one row of each key that it saw, so a key
    with many rows is no more to the shuffle than any other."""
    row = F.struct(*(F.col(f"`{c}`") for c in columns))
    best = df.groupBy(*(F.col(f"`{k}`").alias(f"__key{i}") for i, k in enumerate(keys))).agg(F.max_by(row, F.struct(*(r.alias(f"r{i}") for i, r in enumerate(rank)))).alias("__row"))
    return best.select(*(F.col(f"__row.`{c}`") for c in columns))


def latest(df: DataFrame, key: str | list[str], order_by: str) -> DataFrame:
    """One row for each key: the one of greatest ``order_by`` (null last, then by the row's least digest)."""
    return greatest_row(df, _keys(key), df.columns, F.col(order_by).isNotNull(), F.col(order_by), F.bitwise_not(row_digest(df)))


def upsert(target: DataFrame, source: DataFrame, key: str | list[str], order_by: str) -> DataFrame:
    """The target after an upsert of the source's latest rows.

    A known key is replaced only by a row of strictly greater ``order_by``, so a second run changes nothing and a late
    row can't undo a newer one. A target row without ``order_by`` stays. New keys are inserted; where ``order_by`` is the key itself this is insert-only.
    """
    old, order = F.col("__old"), F.col(order_by)
    both = target.withColumn("__old", F.lit(True)).unionByName(source.select(target.columns).withColumn("__old", F.lit(False)))
    # a stored row without a version is never older than anything, hence it outranks
    return greatest_row(both, _keys(key), target.columns, old & order.isNull(), order.isNotNull(), order, old, F.bitwise_not(row_digest(target)))


def retract(target: DataFrame, rejected: DataFrame, key: str | list[str]) -> DataFrame:
    """The target without the keys that are rejected now."""
    keys = _keys(key)
    return target.join(rejected.select(*keys).where(" and ".join(f"{k} is not null" for k in keys)).distinct(), keys, "left_anti")


def update_where(df: DataFrame, condition: str, values: dict[str, str]) -> DataFrame:
    """SQL's UPDATE: columns take the expressions where the condition is true, and keep their types."""
    hit = F.coalesce(F.expr(condition), F.lit(False))
    kinds = {f.name: f.dataType for f in df.schema}
    return df.withColumns({c: F.when(hit, F.expr(e).cast(kinds[c])).otherwise(F.col(c)) for c, e in values.items()})


def replace_where(df: DataFrame, new: DataFrame, condition: str) -> DataFrame:
    """The rows that don't meet the condition, and the new ones, all of which must meet it."""
    meets = F.coalesce(F.expr(condition), F.lit(False))
    # a filter, so that it's tested whatever columns are read afterwards
    checked = new.where(F.when(meets, F.lit(True)).otherwise(F.raise_error(F.lit(f"a new row doesn't meet {condition}")).cast("boolean")))
    return df.where(~meets).unionByName(checked)
