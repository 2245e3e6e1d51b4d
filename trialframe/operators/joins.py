"""Left joins that match missing keys to missing keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.missing import in_set
from .columns import lookup_value

_R = "__right_"


def left_join(
    left: DataFrame, right: DataFrame, on: list[str], salt: int | None = None
) -> DataFrame:
    """Every left row with each right row of the same keys, NULL equal to NULL.

    No side is forced to broadcast: Spark does that by itself for a side whose
    size it knows to be below its threshold, and splits skewed partitions of the
    other joins at run time. A small right side that is itself an aggregate of a
    large table is best stored first, because Spark guesses its size from the
    table and would move the left side. ``salt`` spreads each key of the left over that many
    tasks beforehand, for keys known to be hot; the right side is repeated to
    match, so the result is the same.
    """
    keys = [(F.col(k), F.col(_R + k)) for k in on]
    right = right.withColumnsRenamed({k: _R + k for k in on})
    if salt:
        spread = F.xxhash64(*[F.col(c) for c in left.columns]) + F.spark_partition_id()
        left = left.withColumn("__salt", F.pmod(spread, F.lit(salt)).cast("int"))
        right = right.withColumn(
            _R + "salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))
        )
        keys.append((F.col("__salt"), F.col(_R + "salt")))
    same = reduce(lambda a, b: a & b, [a.eqNullSafe(b) for a, b in keys])
    drop = [_R + k for k in on] + (["__salt", _R + "salt"] if salt else [])
    return left.join(right, same, "left").drop(*drop)


def correct_by_dictionary(
    df: DataFrame, column: str, dictionary: DataFrame, old: str, new: str
) -> DataFrame:
    """Add the dictionary's ``new`` value for the free text in ``column``.

    The dictionary holds each ``old`` text once. A repeated one would multiply
    rows, so the largest correction is kept.
    """
    entries = dictionary.groupBy(F.col(old).alias(column)).agg(F.max(new).alias(new))
    return left_join(df, entries, [column])


def class_lookup(
    df: DataFrame,
    group: str,
    first_class: list[str],
    table: DataFrame,
    key: str,
    first_key,
    other_key,
    values: dict[str, str],
) -> DataFrame:
    """Give groups of ``first_class`` one row of the table, all others another.

    A missing group takes the other row. ``values`` maps new column to table column.
    """
    in_first = in_set(F.col(group), first_class)

    def pick(value: str) -> Column:
        return F.when(in_first, lookup_value(table, key, first_key, value)).otherwise(
            lookup_value(table, key, other_key, value)
        )

    return df.withColumns({new: pick(value) for new, value in values.items()})
