"""Shares and running positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.coding import level_order
from ..functions.numeric import ratio
from ..sources.scratch import stored
from .joins import left_join


def partition_share(
    df: DataFrame, by: Sequence[str], value: str, total: str = "total", share: str = "share"
) -> DataFrame:
    """Add each row's group total and its share of it.

    Totals are aggregated with map-side combining, stored, and joined back: a
    group holding much of the table is never gathered in one task as a window
    would, and totals of few groups are broadcast, so the rows do not move.
    """
    totals = stored(df.groupBy(*by).agg(F.sum(value).alias(total)), "totals")
    return left_join(df, totals, list(by)).withColumn(share, ratio(F.col(value), F.col(total)))


def running_share(
    df: DataFrame, factor: str, levels: Sequence[str], value: str, by: Sequence[str] = ()
) -> DataFrame:
    """Total per level, its share of all, and the running and mid-point position.

    Levels run from last to first, values outside them at the end. Rows are
    first reduced to one per level, so the running sum sees at most
    ``len(levels) + 1`` rows for each ``by``.
    """
    keys = list(by)
    reduced = (
        df.withColumn("level_order", level_order(F.col(factor), levels))
        .withColumn(factor, F.when(F.col("level_order").isNotNull(), F.col(factor)))
        .groupBy(*keys, factor, "level_order")
        .agg(F.sum(value).alias(value))
    )
    group = Window.partitionBy(*(keys or [F.lit(1)]))
    upward = group.orderBy(F.desc_nulls_last("level_order")).rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        reduced.withColumn("prop", ratio(F.col(value), F.sum(value).over(group)))
        .withColumn("cumsum", F.sum("prop").over(upward))
        .withColumn("pos", F.col("cumsum") - F.col("prop") / 2)
    )
