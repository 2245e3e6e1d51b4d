"""Choosing and computing columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the numeric columns, from the schema alone."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def prefixed(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def mutate(df: DataFrame, steps: Iterable[tuple[str, Column]]) -> DataFrame:
    """Compute columns in order; a later one sees the earlier ones, and may overwrite them."""
    for name, value in steps:
        df = df.withColumn(name, value)
    return df


def across(df: DataFrame, names: Iterable[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Apply one function to each of the named columns."""
    return df.withColumns({c: fn(F.col(c)) for c in names})


def lookup_value(table: DataFrame, key: str, wanted, value: str) -> Column:
    """The value on the one row of ``table`` with that key, as a scalar subquery.

    More than one such row is an error when the query runs.
    """
    return table.filter(F.col(key) == wanted).select(value).scalar()
