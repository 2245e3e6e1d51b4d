"""Registry of demonstration queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.readers import read_snapshot

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under a name, with equivalent DuckDB SQL."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_snapshot(spark, f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Round result columns so that engines agree beyond the last bits."""
    return df.withColumns({c: F.round(c, digits) for c in names})


def null_if(c: Column, value) -> Column:
    return F.nullif(c, F.lit(value))
