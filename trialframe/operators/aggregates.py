"""Group summaries."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.missing import presence, share_missing, strict_mean, strict_sum
from ..functions.numeric import half_even, ratio
from .medians import group_median


def group_means(df: DataFrame, by: Sequence[str], columns: Iterable[str]) -> DataFrame:
    """Group means over the values that are there."""
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns])


def centroids(df: DataFrame, by: Sequence[str], columns: Iterable[str]) -> DataFrame:
    """Group means, NULL where the group has a missing value."""
    return df.groupBy(*by).agg(*[strict_mean(F.col(c)).alias(f"mean_{c}") for c in columns])


def group_share(df: DataFrame, by: Sequence[str], digits: int = 0) -> DataFrame:
    """Percent of all rows in each group, halves rounded to even.

    The total is a scalar subquery over the group counts, so the table is
    aggregated once and no join is needed.
    """
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows")).scalar()
    share = ratio(F.col("rows").cast("double"), total.cast("double")) * 100
    return counts.select(*by, half_even(share, digits).alias("n"))


def missing_profile(
    df: DataFrame, by: Sequence[str], columns: Iterable[str],
    out_of: Column | float | None = None, digits: int = 1,
) -> DataFrame:
    """Percent of missing values per group and column.

    ``out_of`` replaces the group's row count by a fixed number of individuals.
    """
    return df.groupBy(*by).agg(
        *[half_even(share_missing(F.col(c), out_of), digits).alias(c) for c in columns]
    )


def presence_rate(
    df: DataFrame, by: Sequence[str], columns: dict[str, str], fields: int
) -> DataFrame:
    """Fields with a positive count as a percent of ``fields`` viewed.

    One missing count makes the whole sample missing. ``columns`` maps new to counted.
    """
    return df.groupBy(*by).agg(
        *[
            (strict_sum(presence(F.col(counted))) / F.lit(float(fields)) * 100).alias(new)
            for new, counted in columns.items()
        ]
    )


__all__ = [
    "centroids", "group_means", "group_median", "group_share", "missing_profile", "presence_rate",
]
