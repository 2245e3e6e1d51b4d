"""Centring, scaling and group-mean imputation from one statistics pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import ratio


def standardize(
    df: DataFrame,
    columns: Mapping[str, Column],
    group: str | None = None,
    impute: Mapping[str, Sequence[str]] | None = None,
    scale: bool = True,
) -> DataFrame:
    """Replace or add columns as z-scores, then fill the gaps of chosen groups.

    ``columns`` maps the new name to the expression to standardise (for a
    log z-score pass ``F.ln(x)``); with ``scale=False`` it is kept as it is.
    ``impute`` lists, per group, the columns whose missing values take the
    group's mean. Means and deviations are taken before imputing.

    A single aggregate yields every mean, deviation and group mean. It enters
    the row pass as one scalar subquery, so the row pass is a projection with no
    shuffle, join or window. Scaling is linear, hence a group mean of z-scores
    is the scaled group mean and needs no second pass.
    """
    impute = dict(impute or {})
    raw = {name: f"__raw_{i}" for i, name in enumerate(columns)}
    wanted = {name: [g for g, names in impute.items() if name in names] for name in columns}
    unknown = {n for names in impute.values() for n in names} - set(columns)
    if unknown:
        raise ValueError(f"cannot impute columns that are not computed here: {sorted(unknown)}")

    work = df.withColumns({raw[name]: value for name, value in columns.items()})
    parts = []
    for i, name in enumerate(columns):
        x = F.col(raw[name])
        if scale:
            parts += [F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}")]
        for j, g in enumerate(wanted[name]):
            parts.append(F.avg(F.when(F.col(group) == g, x)).alias(f"g{i}_{j}"))
    if not parts:
        return work.withColumns({name: F.col(raw[name]) for name in columns}).drop(*raw.values())

    stats = work.agg(F.struct(*parts)).scalar()
    work = work.withColumn("__stats", stats)
    s = F.col("__stats")
    out = {}
    for i, name in enumerate(columns):
        def scaled(v, i=i):
            return ratio(v - s[f"m{i}"], F.nullif(s[f"s{i}"], F.lit(0.0))) if scale else v

        value = scaled(F.col(raw[name]))
        for j, g in enumerate(wanted[name]):
            filled = F.coalesce(value, scaled(s[f"g{i}_{j}"]))
            value = F.when(F.col(group) == g, filled).otherwise(value)
        out[name] = value
    return work.withColumns(out).drop("__stats", *raw.values())


def impute_group_mean(
    df: DataFrame, group: str, impute: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Fill missing values of the named groups with the group mean; drop ungrouped rows."""
    names = list(dict.fromkeys(n for cols in impute.values() for n in cols))
    return standardize(
        df.filter(F.col(group).isNotNull()), {n: F.col(n) for n in names}, group, impute, False
    )
