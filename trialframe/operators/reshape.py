"""Long to wide and back, and stacking tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

_MERGE = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}


def wider(
    df: DataFrame, ids: Sequence[str], names_from: str, values_from: str,
    names: Sequence[str], merge: str | None = None,
) -> DataFrame:
    """One row per id with a column for each of ``names``; absent cells are NULL.

    One hash aggregate with map-side combining. Without ``merge`` a cell filled
    more than once raises when the query runs, because the result would depend
    on row order; ``merge`` names the aggregate that settles it instead.
    """

    def cell(name: str) -> Column:
        here = F.col(names_from) == name
        value = F.when(here, F.col(values_from))
        if merge:
            return _MERGE[merge](value)
        clash = F.raise_error(F.lit(f"more than one value for {name} in a row"))
        return F.when(F.count_if(here) > 1, clash).otherwise(F.max(value))

    return df.groupBy(*ids).agg(*[cell(n).alias(n) for n in names])


def longer(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str],
    names_to: str = "var", values_to: str = "value",
) -> DataFrame:
    """One row per id and column; missing values are kept."""
    return df.unpivot(list(ids), list(columns), names_to, values_to)


def stack(*tables: DataFrame) -> DataFrame:
    """Rows of all tables, matched by column name, NULL where a column is absent."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
