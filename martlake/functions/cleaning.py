"""Cleaning and typing of text batches. All of it is projection, so it stays inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlake.sources.contracts import contract

CAST_ERRORS, RULE_ERRORS, ERRORS = "_cast_errors", "_rule_errors", "_errors"


def trim(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Strip blanks around the columns that are there."""
    return df.withColumns({c: F.trim(c) for c in columns if c in df.columns})


def normalise(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Strip and lower-case, for codes such as a status."""
    return df.withColumns({c: F.lower(F.trim(c)) for c in columns if c in df.columns})


def safe_cast(column: Column | str, kind: str) -> Column:
    """A cast that gives null where the text isn't a value of the type."""
    return (F.col(column) if isinstance(column, str) else column).try_cast(kind)


def with_cast_errors(df: DataFrame, entity: str) -> DataFrame:
    """Add the names of the columns whose text is there but isn't a value of the contract's type. Comes before casting."""
    failed = [F.when(F.col(f.name).isNotNull() & safe_cast(f.name, f.dataType.simpleString()).isNull(), F.lit(f.name)) for f in contract(entity).schema if f.name in df.columns]
    return df.withColumn(CAST_ERRORS, F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>"))


def cast_to_contract(df: DataFrame, entity: str) -> DataFrame:
    """Cast the contract's columns that are there; other columns pass."""
    kinds = {f.name: f.dataType.simpleString() for f in contract(entity).schema}
    return df.select(*(safe_cast(c, kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns))


def combine_errors(df: DataFrame) -> DataFrame:
    """Replace cast and rule errors, whichever are there, by one array: casts first."""
    parts = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in (CAST_ERRORS, RULE_ERRORS) if c in df.columns]
    joined = F.concat(*parts) if parts else F.array().cast("array<string>")
    return df.withColumn(ERRORS, joined).drop(CAST_ERRORS, RULE_ERRORS)


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their errors); every row is in exactly one."""
    marked = df if ERRORS in df.columns else combine_errors(df)
    bad = F.coalesce(F.size(ERRORS) > 0, F.lit(False))
    return marked.where(~bad).drop(ERRORS), marked.where(bad)


def to_contract(df: DataFrame, entity: str, *more: str) -> DataFrame:
    """The contract's columns in its order, and further named ones; lineage stays behind."""
    return df.select(*contract(entity).columns, *more)
