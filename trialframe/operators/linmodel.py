"""One-way linear models with planned contrasts, for many responses in one pass.

Everything follows from (count, mean, variance) per response and group. The
table is read once whatever the number of responses; the rest works on one row
per response and group.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.numeric import ratio
from ..functions.tails import SimultaneousT, f_upper, t_critical, t_two_sided
from ..sources.scratch import stored

# A response whose residual is this small a part of its total is a perfect fit.
_PERFECT = 1e-12


class OneWayFit(NamedTuple):
    """The three result tables of a batch of one-way models."""

    means: DataFrame
    contrasts: DataFrame
    models: DataFrame


def group_moments(df: DataFrame, group: str, responses: Sequence[str]) -> DataFrame:
    """Rows ``var, grp, n, mean, variance``; each response skips its missing values.

    Aggregates all responses side by side, one input row touching one hash
    entry, then turns the few result rows to the long form. Rows are never
    multiplied by the number of responses.
    """
    x = [F.col(r).cast("double") for r in responses]
    side_by_side = (
        df.filter(F.col(group).isNotNull())
        .groupBy(F.col(group).alias("grp"))
        .agg(
            *[
                F.struct(
                    F.lit(r).alias("var"),
                    F.count(c).alias("n"),
                    F.avg(c).alias("mean"),
                    F.coalesce(F.var_samp(c), F.lit(0.0)).alias("variance"),
                ).alias(f"r{i}")
                for i, (r, c) in enumerate(zip(responses, x))
            ]
        )
    )
    cells = F.array(*[f"r{i}" for i in range(len(responses))])
    return (
        side_by_side.select("grp", F.inline(cells))
        .filter(F.col("n") > 0)
        .select("var", "grp", "n", "mean", "variance")
    )


def _with_residuals(moments: DataFrame) -> DataFrame:
    """Add the model's sums of squares to each (response, group) row."""
    n, mean = F.col("n"), F.col("mean")
    # sums by response are aggregates that join back: a factor's levels never meet in one task
    totals = moments.groupBy("var").agg(
        F.sum("n").alias("nobs"), F.count(F.lit(1)).alias("k"),
        F.sum((n - 1) * F.col("variance")).alias("sse"), (F.sum(n * mean) / F.sum("n")).alias("centre"),
    )
    centred = moments.join(totals, "var")
    between = centred.groupBy("var").agg(F.sum(n * (mean - F.col("centre")) ** 2).alias("ssb"))
    return (
        centred.join(between, "var")
        .withColumn("df_residual", F.col("nobs") - F.col("k"))
        # NULL for a perfect fit: means stay valid, tests and intervals do not exist
        .withColumn(
            "sigma2",
            F.when(
                F.col("sse") > _PERFECT * (F.col("sse") + F.col("ssb")),
                ratio(F.col("sse"), F.col("df_residual").cast("double")),
            ),
        )
    )


def _append(df: DataFrame, names: Sequence[str], fn) -> DataFrame:
    """Add double columns computed in Python, one small summary row at a time."""

    def rows(batches):
        for batch in batches:
            new = [fn(row) for row in batch.to_dict("records")]
            extra = pd.DataFrame(new, columns=list(names), index=batch.index, dtype="float64")
            yield pd.concat([batch, extra], axis=1)

    added = [T.StructField(name, T.DoubleType()) for name in names]
    return df.mapInPandas(rows, T.StructType([*df.schema.fields, *added]))


def _missing(*values) -> bool:
    return any(v is None or v != v for v in values)


def model_summary(moments: DataFrame, tails: bool = True) -> DataFrame:
    """One row per response: fit, overall F test and information criteria."""
    n, k = F.col("nobs").cast("double"), F.col("k").cast("double")
    sse, ssb = F.col("sse"), F.col("ssb")
    per_model = _with_residuals(moments).select(
        "var", "nobs", "k", "sse", "ssb", "df_residual", "sigma2"
    ).dropDuplicates(["var"])
    r2 = ratio(ssb, sse + ssb)
    log_lik = -n / 2 * (F.lit(math.log(2 * math.pi)) + F.ln(sse / n) + 1)
    imperfect = F.col("sigma2").isNotNull()
    out = per_model.select(
        "var",
        r2.alias("r_squared"),
        (1 - (1 - r2) * ratio(n - 1, n - k)).alias("adj_r_squared"),
        F.sqrt("sigma2").alias("sigma"),
        ratio(ratio(ssb, k - 1), F.col("sigma2")).alias("statistic"),
        (F.col("k") - 1).alias("df"),
        F.when(imperfect, log_lik).alias("log_lik"),
        F.when(imperfect, -2 * log_lik + 2 * (k + 1)).alias("aic"),
        F.when(imperfect, -2 * log_lik + F.ln(n) * (k + 1)).alias("bic"),
        sse.alias("deviance"),
        "df_residual",
        "nobs",
    )
    if not tails:
        return out

    def p_value(row):
        f, df1, df2 = row["statistic"], row["df"], row["df_residual"]
        return (None if _missing(f) or df1 < 1 else f_upper(f, df1, df2),)

    return _append(out, ["p_value"], p_value)


def marginal_means(moments: DataFrame, level: float = 0.95, tails: bool = True) -> DataFrame:
    """Group means with standard error, interval and test against zero."""
    out = _with_residuals(moments).select(
        "var", "grp", "n",
        F.col("mean").alias("estimate"),
        F.sqrt(F.col("sigma2") / F.col("n")).alias("std_error"),
        F.col("df_residual").alias("df"),
    ).withColumn("statistic", ratio(F.col("estimate"), F.col("std_error")))
    if not tails:
        return out
    known: dict[int, float] = {}

    def test(row):
        t, df = row["statistic"], row["df"]
        if _missing(t):
            return (None, None, None)
        if df not in known:
            known[df] = t_critical(df, level)
        half = known[df] * row["std_error"]
        return t_two_sided(t, df), row["estimate"] - half, row["estimate"] + half

    return _append(out, ["p_value", "lower_cl", "upper_cl"], test)


def planned_contrasts(
    moments: DataFrame,
    contrasts: Mapping[str, Mapping[str, float]],
    level: float = 0.95,
    tails: bool = True,
    seed: int = 0,
) -> DataFrame:
    """Weighted sums of group means, tested jointly.

    ``contrasts`` maps a name to weights by level name. P-values and intervals
    are adjusted with the joint multivariate t of the contrasts. A contrast is
    NULL for a response that lacks one of its groups.
    """
    names = list(contrasts)

    def weight(name):
        out = F.lit(0.0)
        for group, w in contrasts[name].items():
            out = F.when(F.col("grp") == group, F.lit(float(w))).otherwise(out)
        return out

    w = {name: weight(name) for name in names}
    used = {name: sum(v != 0 for v in contrasts[name].values()) for name in names}
    cells = []
    for name in names:
        whole = F.count_if(w[name] != 0) == used[name]
        cells.append(
            F.struct(
                F.lit(name).alias("contrast"),
                F.when(whole, F.sum(w[name] * F.col("mean"))).alias("estimate"),
                F.sum(w[name] * w[name] / F.col("n")).alias("__scale"),
                F.array(
                    *[F.sum(w[name] * w[other] / F.col("n")) for other in names]
                ).alias("__gram"),
            ).alias(f"c{len(cells)}")
        )
    per_model = (
        _with_residuals(moments)
        .groupBy("var")
        .agg(F.first("sigma2").alias("__s2"), F.first("df_residual").alias("df"), *cells)
    )
    grams = F.array(*[f"c{i}.__gram" for i in range(len(names))])
    rows = per_model.select(
        "var", "df", "__s2", grams.alias("__grams"),
        F.inline(F.array(*[f"c{i}" for i in range(len(names))])),
    ).select(
        "var", "contrast", "estimate",
        F.when(F.col("estimate").isNotNull(), F.sqrt(F.col("__s2") * F.col("__scale")))
        .alias("std_error"),
        "df", "__grams",
    ).withColumn("statistic", ratio(F.col("estimate"), F.col("std_error")))
    if not tails:
        return rows.drop("__grams")
    known: dict[tuple, tuple] = {}

    def test(row):
        t, df = row["statistic"], row["df"]
        if _missing(t):
            return (None, None, None)
        gram = tuple(tuple(float(v) for v in line) for line in row["__grams"])
        live = [i for i in range(len(gram)) if gram[i][i] > 0]
        if (gram, df) not in known:
            corr = [
                [gram[i][j] / math.sqrt(gram[i][i] * gram[j][j]) for j in live] for i in live
            ]
            joint = SimultaneousT(corr, df, seed)
            known[gram, df] = joint, joint.critical(level)
        joint, critical = known[gram, df]
        half = critical * row["std_error"]
        return joint.upper(t), row["estimate"] - half, row["estimate"] + half

    return _append(rows, ["adj_p_value", "lower_cl", "upper_cl"], test).drop("__grams")


def fit_one_way(
    df: DataFrame, group: str, responses: Sequence[str],
    contrasts: Mapping[str, Mapping[str, float]],
) -> OneWayFit:
    """Models, marginal means and contrasts for every response.

    The moments are computed now and stored, so the three tables never read
    ``df`` again.
    """
    moments = stored(group_moments(df, group, responses), "moments")
    return OneWayFit(
        marginal_means(moments), planned_contrasts(moments, contrasts), model_summary(moments)
    )
