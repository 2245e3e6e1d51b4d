"""Exact group medians that survive a group holding much of the table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.scratch import stored
from .joins import left_join

# Bits of a number that one round settles; a group has at most two times 2 ** _BITS counters.
_BITS = 16
_FRACTION = 2.0**52
_INFINITE, _NAN = 2047 << 52, 2**63 - 1


def ordered_bits(x: Column) -> Column:
    """A whole number of 64 bits for a double, in the same order, one for each value.

    It is the double's own binary form, negative for negative values. Zeros are equal; NaN
    comes last. Spark has no expression for it, so whole columns are viewed as numbers in Arrow batches.
    """

    @F.pandas_udf("bigint")
    def view(values: pd.Series) -> pd.Series:
        held = values.to_numpy("float64")
        bits = held.view(np.int64)
        return pd.Series(np.where(np.isnan(held), _NAN, np.where(bits < 0, -(bits & _NAN), bits)))

    return F.when(x.isNotNull(), view(x))


def from_ordered_bits(bits: Column) -> Column:
    """The double of ``ordered_bits``."""
    size = F.abs(bits)
    exponent, fraction = F.shiftright(size, 52), size.bitwiseAND((1 << 52) - 1).cast("double")
    value = (
        F.when(exponent == 0, fraction * 2.0**-537 * 2.0**-537).when(size == _INFINITE, float("inf"))
        .otherwise((1 + fraction / _FRACTION) * F.pow(F.lit(2.0), exponent - 1023))
    )
    return F.when(bits == _NAN, float("nan")).when(bits < 0, -value).otherwise(value)


def group_median(
    df: DataFrame, by: Sequence[str], columns: Sequence[str],
    strict: bool = False, small_groups: bool = False, store_input: bool = False,
) -> DataFrame:
    """Median per group, the mean of the two middle values for an even count.

    Missing values are skipped, or with ``strict`` make the result NULL.

    Spark's own ``median`` holds a whole group in one task. With
    ``small_groups`` it is used, for groups bounded by design. Otherwise the middle values
    are found by their bits, a few at a time (``ordered_bits``): a round counts the rows of each group
    by the next bits, with counters combined on the map side, and keeps the counters that
    the middle ranks fall into; the next round counts only rows that agree with these so
    far. It ends when each such counter holds one value only, after four rounds at
    most, for most data after two. Counters, not rows, are gathered for a group.

    Each round reads the input; set ``store_input`` where it takes work to compute.
    """
    by, columns = list(by), list(columns)
    if small_groups:
        def one(c):
            whole = F.count(c) == F.count(F.lit(1))
            return F.when(whole, F.median(c)) if strict else F.median(c)

        return df.groupBy(*by).agg(*[one(c).alias(c) for c in columns])

    xs = [f"__x{i}" for i in range(len(columns))]
    values = df.select(*by, *[F.col(c).cast("double").alias(x) for c, x in zip(columns, xs)])
    if store_input:
        values = stored(values, "values")
    keyed = values.select(*by, *[ordered_bits(F.col(x)).alias(x) for x in xs])
    cells = [F.struct(F.lit(i).alias("var"), F.col(x).alias("key")) for i, x in enumerate(xs)]
    rows = keyed.select(*by, F.explode(F.array(*cells)).alias("__at")).select(
        *by, F.col("__at.var").alias("__var"), F.col("__at.key").alias("__key"))
    own = [*by, "__var"]
    shift = 64 - _BITS
    lists = _counters(rows, own, shift)
    n = F.aggregate(F.filter("__counters", lambda c: c["bucket"].isNotNull()), F.lit(0).cast("bigint"), lambda a, c: a + c["n"])
    gaps = F.exists("__counters", lambda c: c["bucket"].isNull())
    ranked = lists.withColumns({"__n": n, "__gaps": gaps}).withColumns(
        {"__first": F.expr("(__n + 1) div 2"), "__second": F.expr("(__n + 2) div 2")})
    found = stored(
        ranked.select(*own, "__gaps", *[_holder(f"__{r}", F.col("__counters"), f"__{r}") for r in ("first", "second")]), "middle")
    while shift > 0 and not found.where(_open("__first") | _open("__second")).isEmpty():
        wanted = found.where(_open("__first") | _open("__second")).select(
            *own, F.array("__first.bucket", "__second.bucket").alias("__buckets"))
        near = left_join(rows, wanted, own).where(F.array_contains("__buckets", F.shiftright("__key", shift)))
        shift -= _BITS
        lists = _counters(near.select(*own, "__key"), own, shift)
        held = left_join(found, lists, own)
        found = stored(held.select(*own, "__gaps", *[_narrowed(r) for r in ("__first", "__second")]), "middle")
    middle = (from_ordered_bits(F.col("__first.low")) + from_ordered_bits(F.col("__second.low"))) / 2
    result = F.when(~F.col("__gaps"), middle) if strict else middle
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("__var") == i, result)).alias(c) for i, c in enumerate(columns)])


def _counters(rows: DataFrame, own: list[str], shift: int) -> DataFrame:
    """For each group and variable the sorted counters by the key's leading bits; NULLs count apart."""
    counted = rows.groupBy(*own, F.shiftright("__key", shift).alias("__bucket")).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__key").alias("__low"), F.max("__key").alias("__high"))
    one = F.struct(F.col("__bucket").alias("bucket"), F.col("__n").alias("n"), F.col("__low").alias("low"), F.col("__high").alias("high"))
    return counted.groupBy(*own).agg(F.sort_array(F.collect_list(one)).alias("__counters"))


def _holder(name: str, counters: Column, rank: str) -> Column:
    """The counter that holds a rank, and the rank within it; NULL where there is no such rank."""
    start = F.struct(F.col(rank).alias("left"), F.lit(None).cast("bigint").alias("bucket"),
                     F.lit(None).cast("bigint").alias("low"), F.lit(None).cast("bigint").alias("high"))

    def step(a, c):
        here = a["bucket"].isNull() & (a["left"] <= c["n"])
        passed = a["bucket"].isNull() & (a["left"] > c["n"])
        return F.struct(
            F.when(passed, a["left"] - c["n"]).otherwise(a["left"]).alias("left"),
            *[F.when(here, c[f]).otherwise(a[f]).alias(f) for f in ("bucket", "low", "high")])

    known = F.filter(counters, lambda c: c["bucket"].isNotNull())
    return F.aggregate(known, start, step).alias(name)


def _open(name: str) -> Column:
    return F.coalesce(F.col(f"{name}.low") != F.col(f"{name}.high"), F.lit(False))


def _narrowed(name: str) -> Column:
    """The holder among the finer counters within the old one; a settled one stays."""
    old = F.col(f"{name}.bucket")
    inner = F.filter("__counters", lambda c: F.shiftright(c["bucket"], _BITS) == old)
    return F.when(F.col("__counters").isNull(), F.col(name)).otherwise(_holder(name, inner, f"{name}.left")).alias(name)
