"""Linear models, ordination and permutation tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coding
from ..operators import aggregates, crossproducts, linmodel, ordination, permute
from ..plans import partition
from ..sources import readers, writers
from ..sources.scratch import fresh_path, stored
from .matrix_sql import eigen, eliminated, fitted, moments, places, two_components
from .registry import query, rounded, table

# ---------------------------------------------------------------- linear models

# Four responses by return flag; a tax of zero stands for a missing quantity.
_RESPONSES = ["quantity", "price", "discount", "excess"]
_CONTRASTS = {"A to N": {"A": -1.0, "N": 1.0}, "N to R": {"N": -1.0, "R": 1.0}}

_FIT = """
    l AS (SELECT l_returnflag AS grp, CASE WHEN l_tax > 0 THEN l_quantity END AS quantity,
                 l_extendedprice / 1000 AS price, l_discount AS discount,
                 l_discount - 0.05::DOUBLE AS excess
          FROM lineitem),
    v AS (SELECT grp, 'quantity' AS var, quantity AS x FROM l
          UNION ALL SELECT grp, 'price', price FROM l
          UNION ALL SELECT grp, 'discount', discount FROM l
          UNION ALL SELECT grp, 'excess', excess FROM l),
    m AS (SELECT var, grp, count(x) AS n, avg(x) AS mean, var_samp(x) AS variance
          FROM v WHERE x IS NOT NULL GROUP BY var, grp),
    c AS (SELECT *, count(*) OVER w AS k, CAST(sum(n) OVER w AS BIGINT) AS nobs,
                 sum((n - 1) * variance) OVER w AS sse, sum(n * mean) OVER w / sum(n) OVER w AS gm
          FROM m WINDOW w AS (PARTITION BY var)),
    fit AS (SELECT *, nobs - k AS df, sse / (nobs - k) AS s2,
                   sum(n * (mean - gm) * (mean - gm)) OVER (PARTITION BY var) AS ssb
            FROM c)"""


def _moments(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_returnflag",
        F.when(F.col("l_tax") > 0, F.col("l_quantity")).alias("quantity"),
        (F.col("l_extendedprice") / 1000).alias("price"),
        F.col("l_discount").alias("discount"),
        (F.col("l_discount") - F.lit(0.05)).alias("excess"),
    )
    return linmodel.group_moments(rows, "l_returnflag", _RESPONSES)


@query("lm_group_stats", f"""
    WITH {_FIT}
    SELECT var, grp, n, round(mean, 8) AS mean, round(variance, 7) AS variance FROM fit""")
def lm_group_stats(spark, folder):
    return rounded(rounded(_moments(spark, folder), 8, "mean"), 7, "variance")


@query("lm_glance", f"""
    WITH {_FIT},
    g AS (SELECT DISTINCT var, k, nobs, df, sse, ssb, s2, ssb / (sse + ssb) AS r2,
                 ssb / (k - 1) / s2 AS f,
                 -nobs / 2.0::DOUBLE * (ln(2 * pi()) + ln(sse / nobs) + 1) AS ll
          FROM fit)
    SELECT var, round(r2, 10) AS r_squared,
           round(1 - (1 - r2) * (nobs - 1) / (nobs - k), 10) AS adj_r_squared,
           round(sqrt(s2), 7) AS sigma, round(f, 6) AS statistic, k - 1 AS df,
           round(ll, 4) AS log_lik, round(-2 * ll + 2 * (k + 1), 4) AS aic,
           round(-2 * ll + ln(nobs) * (k + 1), 4) AS bic, round(sse, 3) AS deviance,
           df AS df_residual, nobs, round(exp(-df / 2.0::DOUBLE * ln(1 + 2 * f / df)), 8) AS p_value
    FROM g""")
def lm_glance(spark, folder):
    out = linmodel.model_summary(_moments(spark, folder))
    out = rounded(out, 10, "r_squared", "adj_r_squared")
    out = rounded(out, 4, "log_lik", "aic", "bic")
    return rounded(
        rounded(rounded(rounded(out, 7, "sigma"), 6, "statistic"), 3, "deviance"), 8, "p_value"
    )


# Two-sided t tail by Simpson's rule; t critical value by its series in 1/df.
_T_TAIL = """
    (SELECT 1 - 2 * sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
            * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)
                  - (df + 1) / 2.0 * ln(1 + (i * top / 2000) * (i * top / 2000) / df)))
            * top / 2000 / 3 / sqrt(df * pi())
     FROM range(2001) AS points(i))"""
_T_CRITICAL = """(SELECT z + (z ** 3 + z) / (4 * df)
    + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96.0 * df * df)
    FROM (SELECT 1.959963984540054::DOUBLE AS z))"""


@query("lm_marginal_means", f"""
    WITH {_FIT},
    e AS (SELECT var, grp, n, mean, sqrt(s2 / n) AS se, df, mean / sqrt(s2 / n) AS t,
                 least(abs(mean / sqrt(s2 / n)), 12) AS top
          FROM fit)
    SELECT var, grp, n, round(mean, 8) AS estimate, round(se, 8) AS std_error, df,
           round(t, 4) AS statistic, abs(round({_T_TAIL}, 7)) AS p_value,
           round(mean - {_T_CRITICAL} * se, 7) AS lower_cl,
           round(mean + {_T_CRITICAL} * se, 7) AS upper_cl
    FROM e""")
def lm_marginal_means(spark, folder):
    out = linmodel.marginal_means(_moments(spark, folder))
    out = rounded(rounded(out, 8, "estimate", "std_error"), 4, "statistic")
    return rounded(out, 7, "p_value", "lower_cl", "upper_cl")


# Tail of the larger |t| of two: average over directions of a closed radial tail.
_JOINT_TAIL = """
    (SELECT avg(exp(-df / 2.0 * ln(1 + t * t / df
            / greatest(abs(cos(a)), abs(rho * cos(a) + sqrt(1 - rho * rho) * sin(a))) ** 2)))
     FROM (SELECT (i + 0.5) * pi() / 8000 AS a FROM range(8000) AS points(i)))"""


_PAIRS = """
    p AS (SELECT var, any_value(df) AS df, any_value(s2) AS s2,
                 any_value(mean) FILTER (grp = 'A') AS ma, any_value(mean) FILTER (grp = 'N') AS mn,
                 any_value(mean) FILTER (grp = 'R') AS mr,
                 1.0::DOUBLE / any_value(n) FILTER (grp = 'A') AS ia,
                 1.0::DOUBLE / any_value(n) FILTER (grp = 'N') AS in_,
                 1.0::DOUBLE / any_value(n) FILTER (grp = 'R') AS ir
          FROM fit GROUP BY var),
    e AS (SELECT var, 'A to N' AS contrast, mn - ma AS est, sqrt(s2 * (ia + in_)) AS se, df,
                 -in_ / sqrt((ia + in_) * (in_ + ir)) AS rho FROM p
          UNION ALL
          SELECT var, 'N to R', mr - mn, sqrt(s2 * (in_ + ir)), df,
                 -in_ / sqrt((ia + in_) * (in_ + ir)) FROM p),
    q AS (SELECT *, est / se AS t FROM e)"""


@query("lm_contrasts", f"""
    WITH {_FIT},
    {_PAIRS}
    SELECT var, contrast, round(est, 8) AS estimate, round(se, 8) AS std_error, df,
           round(t, 5) AS statistic, round({_JOINT_TAIL}, 6) AS adj_p_value
    FROM q""")
def lm_contrasts(spark, folder):
    out = linmodel.planned_contrasts(_moments(spark, folder), _CONTRASTS)
    out = rounded(rounded(out.drop("lower_cl", "upper_cl"), 8, "estimate", "std_error"), 5,
                  "statistic")
    return rounded(out, 6, "adj_p_value")


# Critical value of the larger |t| of two by halving an interval, fifty times.
_JOINT_CRITICAL = """
    points AS (SELECT (i + 0.5) * pi() / 8000 AS a FROM range(8000) AS p(i)),
    halves AS (SELECT DISTINCT var, df, rho, 0.0::DOUBLE AS lo, 50.0::DOUBLE AS hi, 0 AS i FROM q
               UNION ALL
               SELECT var, df, rho, CASE WHEN tail > 0.05 THEN (lo + hi) / 2 ELSE lo END,
                      CASE WHEN tail > 0.05 THEN hi ELSE (lo + hi) / 2 END, i + 1
               FROM (SELECT var, df, rho, lo, hi, i,
                            avg(exp(-df / 2.0 * ln(1 + ((lo + hi) / 2) ** 2 / df
                                / greatest(abs(cos(a)), abs(rho * cos(a) + sqrt(1 - rho * rho) * sin(a))) ** 2)))
                                AS tail
                     FROM halves, points WHERE i < 50 GROUP BY ALL)),
    crit AS (SELECT var, (lo + hi) / 2 AS c FROM halves WHERE i = 50)"""


@query("lm_contrast_intervals", f"""
    WITH RECURSIVE {_FIT},
    {_PAIRS},
    {_JOINT_CRITICAL}
    SELECT var, contrast, round(est, 8) AS estimate, round(est - c * se, 6) AS lower_cl,
           round(est + c * se, 6) AS upper_cl
    FROM q JOIN crit USING (var)""")
def lm_contrast_intervals(spark, folder):
    out = linmodel.planned_contrasts(_moments(spark, folder), _CONTRASTS)
    out = out.select("var", "contrast", "estimate", "lower_cl", "upper_cl")
    return rounded(rounded(out, 8, "estimate"), 6, "lower_cl", "upper_cl")


# ---------------------------------------------------------------- ordination

_MEASURES = ["quantity", "turnover", "reduction", "tax"]
_MEASURES_SQL = """SELECT l_orderkey, l_linenumber, l_returnflag,
                          CASE WHEN l_linenumber > 1 THEN l_quantity END AS quantity,
                          l_extendedprice * l_quantity / 1e5 AS turnover,
                          (l_discount + l_tax) * 100 AS reduction, l_tax * 100 AS tax
                   FROM lineitem"""


def _measures(spark, folder):
    c = F.col
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag",
        F.when(c("l_linenumber") > 1, c("l_quantity")).alias("quantity"),
        (c("l_extendedprice") * c("l_quantity") / F.lit(1e5)).alias("turnover"),
        ((c("l_discount") + c("l_tax")) * 100).alias("reduction"), (c("l_tax") * 100).alias("tax"),
    )


def _pairs_sql(columns):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS var_i, '{b}' AS var_j, round(covar_samp({a}, {b}), 6) AS cov FROM m"
        for i, a in enumerate(columns) for b in columns[i:]
    )


_COMPLETE = f"WITH m AS (SELECT * FROM ({_MEASURES_SQL}) WHERE quantity IS NOT NULL)"


@query("pca_covariance", f"{_COMPLETE} {_pairs_sql(_MEASURES)}")
def pca_covariance(spark, folder):
    return rounded(crossproducts.covariance_table(_measures(spark, folder), _MEASURES), 6, "cov")


_TWO_TURNED = f"""
    WITH RECURSIVE m AS (SELECT * FROM ({_MEASURES_SQL}) WHERE quantity IS NOT NULL),
    {two_components("m", _MEASURES)}"""


@query("pca_loadings", f"""{_TWO_TURNED}
    SELECT ['quantity', 'turnover', 'reduction', 'tax'][i] AS variable, round(l1, 6) AS rc1, round(l2, 6) AS rc2,
           CASE WHEN i <= 2 THEN 'amount' ELSE 'rate' END AS type FROM rc""")
def pca_loadings(spark, folder):
    fit = ordination.principal_components(_measures(spark, folder), _MEASURES)
    kinds = {"quantity": "amount", "turnover": "amount"}
    return rounded(fit.loadings_table(kinds, "rate"), 6, "rc1", "rc2")


@query("pca_scores", f"""{_TWO_TURNED},
    w AS (SELECT list(w1 ORDER BY i) AS w1, list(w2 ORDER BY i) AS w2 FROM rc),
    away AS (SELECT l_orderkey, l_linenumber, l_returnflag,
                    [quantity - mean[1], turnover - mean[2], reduction - mean[3], tax - mean[4]] AS d FROM m, mo)
    SELECT l_orderkey, l_linenumber, l_returnflag, round(list_inner_product(d, w1), 5) AS rc1,
           round(list_inner_product(d, w2), 5) AS rc2 FROM away, w""")
def pca_scores(spark, folder):
    rows = _measures(spark, folder)
    out = ordination.principal_components(rows, _MEASURES).scores(rows, ["l_orderkey", "l_linenumber", "l_returnflag"])
    return rounded(out, 5, "rc1", "rc2")


_COMPONENTS = 64
_EMBEDDED = [f"e{i}" for i in range(_COMPONENTS)]


@query("pca_embedding_covariance", f"""
    WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings
               WHERE len(list_filter(embedding, lambda e: e IS NULL)) = 0)
    SELECT 'e' || a.i AS var_i, 'e' || b.i AS var_j, round(covar_samp(a.x, b.x), 9) AS cov
    FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i""")
def pca_embedding_covariance(spark, folder):
    """All components of the vectors, too many for one aggregate of pairs."""
    rows = table(spark, folder, "embeddings").select(*[F.col("embedding")[i].alias(c) for i, c in enumerate(_EMBEDDED)])
    return rounded(crossproducts.covariance_table(rows, _EMBEDDED), 9, "cov")


@query("pca_observed_eigenvalues", f"""
    WITH RECURSIVE m AS (SELECT * FROM ({_MEASURES_SQL}) WHERE quantity IS NOT NULL),
    {moments("m", _MEASURES, "raw")},
    mo AS (SELECT n, mean, list_transform(range(1, 5), lambda i: list_transform(range(1, 5), lambda j:
             c[i][j] / sqrt(c[i][i] * c[j][j]))) AS c FROM raw),
    {eliminated(4, 4)},
    -- the inverse is T' D T, with T and D of the elimination
    uniq AS (SELECT c, list_transform(range(1, 5), lambda i:
               1 / list_sum(list_transform(range(1, 5), lambda j: t[j][i] * t[j][i] / m[j][j]))) AS u FROM el),
    reduced AS (SELECT list_transform(range(1, 5), lambda i: list_transform(range(1, 5), lambda j:
                  c[i][j] - CASE WHEN i = j THEN u[i] ELSE 0 END)) AS a FROM uniq),
    {eigen(4, "reduced")}
    SELECT axis AS component, round(value, 7) AS observed FROM ei""")
def pca_observed_eigenvalues(spark, folder):
    """The side of parallel analysis that is not simulated."""
    out = ordination.parallel_analysis(_measures(spark, folder), _MEASURES, 50)
    return rounded(out.select("component", "observed"), 7, "observed")


# One component of two variables has a closed form.
_FIRST = f"""{_COMPLETE},
    s AS (SELECT var_samp(quantity) AS a, covar_samp(quantity, turnover) AS b, var_samp(turnover) AS d,
                 avg(quantity) AS mq, avg(turnover) AS mp FROM m),
    e AS (SELECT *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS e1 FROM s),
    v AS (SELECT *, sign(b + e1 - a) * b / sqrt(b * b + (e1 - a) * (e1 - a)) AS vq,
                 sign(b + e1 - a) * (e1 - a) / sqrt(b * b + (e1 - a) * (e1 - a)) AS vp FROM e)"""


@query("pca_first_loadings", f"""{_FIRST}
    SELECT 'quantity' AS variable, round(vq * sqrt(e1), 6) AS rc1, 'amount' AS type FROM v
    UNION ALL SELECT 'turnover', round(vp * sqrt(e1), 6), 'other' FROM v""")
def pca_first_loadings(spark, folder):
    fit = ordination.principal_components(_measures(spark, folder), ["quantity", "turnover"], 1)
    return rounded(fit.loadings_table({"quantity": "amount"}, "other"), 6, "rc1")


@query("pca_first_scores", f"""{_FIRST}
    SELECT l_orderkey, l_linenumber, l_returnflag,
           round(((quantity - mq) * vq + (turnover - mp) * vp) / sqrt(e1), 6) AS rc1
    FROM m, v""")
def pca_first_scores(spark, folder):
    rows = _measures(spark, folder)
    fit = ordination.principal_components(rows, ["quantity", "turnover"], 1)
    return rounded(fit.scores(rows, ["l_orderkey", "l_linenumber", "l_returnflag"]), 6, "rc1")


@query("pca_parallel_analysis")
def pca_parallel_analysis(spark, folder):
    return ordination.parallel_analysis(_measures(spark, folder), _MEASURES, 5000)


@query("ord_centroids", """
    SELECT l_returnflag, round(avg(l_extendedprice * l_quantity / 1e5), 7) AS mean_turnover,
           round(avg((l_discount + l_tax) * 100), 7) AS mean_reduction,
           CAST(NULL AS DOUBLE) AS mean_quantity
    FROM lineitem GROUP BY ALL""")
def ord_centroids(spark, folder):
    names = ["turnover", "reduction", "quantity"]
    out = aggregates.centroids(_measures(spark, folder), ["l_returnflag"], names)
    return rounded(out, 7, "mean_turnover", "mean_reduction")


# Two responses on two predictors: everything has a closed form.
_TERMS, _OUTCOMES = ["quantity", "tax"], ["turnover", "reduction"]
_RDA = f"""{_COMPLETE},
    s AS (SELECT count(*) AS n, var_samp(quantity) AS xx, covar_samp(quantity, tax) AS xw,
                 var_samp(tax) AS ww, covar_samp(quantity, turnover) AS xp,
                 covar_samp(quantity, reduction) AS xd, covar_samp(tax, turnover) AS wp,
                 covar_samp(tax, reduction) AS wd, var_samp(turnover) + var_samp(reduction) AS total
          FROM m),
    r AS (SELECT *, xp / sqrt(xx) AS s11, xd / sqrt(xx) AS s12,
                 (wp - xw / xx * xp) / sqrt(ww - xw * xw / xx) AS s21,
                 (wd - xw / xx * xd) / sqrt(ww - xw * xw / xx) AS s22
          FROM s),
    k AS (SELECT *, s11 * s11 + s21 * s21 AS a, s11 * s12 + s21 * s22 AS b,
                 s12 * s12 + s22 * s22 AS d
          FROM r),
    eig AS (SELECT *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS e1,
                   (a + d) / 2 - sqrt((a - d) * (a - d) / 4 + b * b) AS e2
            FROM k)"""


@query("rda_covariance", f"{_COMPLETE} {_pairs_sql([*_TERMS, *_OUTCOMES])}")
def rda_covariance(spark, folder):
    out = crossproducts.covariance_table(_measures(spark, folder), [*_TERMS, *_OUTCOMES])
    return rounded(out, 6, "cov")


@query("rda_rsquare", f"""{_RDA}
    SELECT round(a + d, 7) AS constrained, round(total, 6) AS total,
           round((a + d) / total, 10) AS r_squared,
           round(1 - (1 - (a + d) / total) * (n - 1) / (n - 3), 10) AS adj_r_squared
    FROM eig""")
def rda_rsquare(spark, folder):
    out = ordination.redundancy(_measures(spark, folder), _OUTCOMES, _TERMS).r_squared()
    return rounded(
        rounded(rounded(out, 7, "constrained"), 6, "total"), 10, "r_squared", "adj_r_squared"
    )


@query("rda_axes", f"""{_RDA}
    SELECT 'rda1' AS axis, round(e1, 7) AS eigenvalue, round(e1 / total, 10) AS share_total,
           round(e1 / (a + d), 7) AS share_constrained FROM eig
    UNION ALL
    SELECT 'rda2', round(e2, 7), round(e2 / total, 10), round(e2 / (a + d), 7) FROM eig""")
def rda_axes(spark, folder):
    out = ordination.redundancy(_measures(spark, folder), _OUTCOMES, _TERMS).axes_table()
    return rounded(rounded(out, 7, "eigenvalue", "share_constrained"), 10, "share_total")


_SPECIES = f"""{_RDA},
    dir AS (SELECT *, sqrt(b * b + (e1 - a) * (e1 - a)) AS h1, sqrt(b * b + (e2 - a) * (e2 - a)) AS h2,
                   sign(b + e1 - a) AS g1, sign(b + e2 - a) AS g2 FROM eig),
    v AS (SELECT *, g1 * b / h1 AS p1, g1 * (e1 - a) / h1 AS d1,
                 g2 * b / h2 AS p2, g2 * (e2 - a) / h2 AS d2 FROM dir)"""


@query("rda_species", f"""{_SPECIES}
    SELECT 'turnover' AS var, round(p1 * sqrt(e1), 5) AS rda1, round(p2 * sqrt(e2), 5) AS rda2 FROM v
    UNION ALL SELECT 'reduction', round(d1 * sqrt(e1), 5), round(d2 * sqrt(e2), 5) FROM v""")
def rda_species(spark, folder):
    fit = ordination.redundancy(_measures(spark, folder), _OUTCOMES, _TERMS)
    return rounded(fit.species_scores(), 5, "rda1", "rda2")


@query("rda_scores", f"""{_SPECIES},
    mid AS (SELECT avg(turnover) AS mp, avg(reduction) AS md FROM m)
    SELECT l_orderkey, l_linenumber, l_returnflag,
           round(((turnover - mp) * p1 + (reduction - md) * d1) / sqrt(e1), 3)
               AS rda1,
           round(((turnover - mp) * p2 + (reduction - md) * d2) / sqrt(e2), 3)
               AS rda2
    FROM m, v, mid""")
def rda_scores(spark, folder):
    rows = _measures(spark, folder)
    fit = ordination.redundancy(rows, _OUTCOMES, _TERMS)
    out = fit.site_scores(rows, ["l_orderkey", "l_linenumber", "l_returnflag"])
    return rounded(out, 3, "rda1", "rda2")


_BIPLOT = f"""{_SPECIES},
    u AS (SELECT *, (s11 * p1 + s12 * d1) / sqrt(e1) AS u11, (s21 * p1 + s22 * d1) / sqrt(e1) AS u21,
                 (s11 * p2 + s12 * d2) / sqrt(e2) AS u12, (s21 * p2 + s22 * d2) / sqrt(e2) AS u22,
                 xw / sqrt(xx * ww) AS low, sqrt(1 - xw * xw / xx / ww) AS high
          FROM v),
    bi AS (SELECT 'quantity' AS var, u11 AS rda1, u12 AS rda2 FROM u
           UNION ALL SELECT 'tax', low * u11 + high * u21, low * u12 + high * u22 FROM u)"""


@query("rda_biplot", f"""{_BIPLOT}
    SELECT var, round(rda1, 5) AS rda1, round(rda2, 5) AS rda2 FROM bi""")
def rda_biplot(spark, folder):
    fit = ordination.redundancy(_measures(spark, folder), _OUTCOMES, _TERMS)
    return rounded(fit.biplot_scores(), 5, "rda1", "rda2")


def _biplot_sql(terms, outcomes, source, names):
    """Correlations of the terms with the first two axes, from one row of moments."""
    q, p = len(terms), len(terms) + len(outcomes)
    along = f"list_sum(list_transform(range(1, {len(outcomes) + 1}), lambda y: m[j][{q} + y] * v[y])) / sqrt(m[j][j] * value)"
    labels = "[" + ", ".join(f"'{names.get(t, t)}'" for t in terms) + "]"
    return f"""
    WITH RECURSIVE {source},
    {moments("full_rows", [*terms, *outcomes])},
    {eliminated(q, p)},
    {fitted(q, p)},
    {eigen(len(outcomes), "fi_matrix")},
    u AS (SELECT j, axis, {along} AS u FROM el, ei, range(1, {q + 1}) AS predictors(j)
          WHERE axis <= 2 AND m[j][j] > 1e-9 * c[j][j]),
    score AS (SELECT {labels}[x] AS var, axis, sum(m[j][x] / sqrt(m[j][j] * c[x][x]) * u) AS score
              FROM u, el, range(1, {q + 1}) AS predictors(x) WHERE j <= x AND m[x][x] > 1e-9 * c[x][x] GROUP BY x, axis)"""


_TWO_AXES = """ SELECT var, round(any_value(score) FILTER (axis = 1), 5) AS rda1,
       round(any_value(score) FILTER (axis = 2), 5) AS rda2 FROM score GROUP BY var"""


@query("rda_biplot_interactions", _biplot_sql(
    ["quantity", "tax", "ecc", "quantity_ecc", "tax_ecc"], _OUTCOMES, f"""
    raw AS (SELECT quantity, tax, turnover, reduction,
                   CASE WHEN l_returnflag IN ('A', 'R') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS ecc
            FROM ({_MEASURES_SQL}) WHERE quantity IS NOT NULL),
    full_rows AS (SELECT *, quantity * ecc AS quantity_ecc, tax * ecc AS tax_ecc FROM raw)""",
    {"quantity_ecc": "quantity:ecc", "tax_ecc": "tax:ecc"}) + _TWO_AXES)
def rda_biplot_interactions(spark, folder):
    flag = F.col("l_returnflag")
    rows = _measures(spark, folder).withColumn("ecc", coding.indicator(flag, ["A", "R"]))
    terms = ["quantity", "tax", "ecc", "quantity:ecc", "tax:ecc"]
    rows = ordination.with_interactions(rows, terms)
    return rounded(ordination.redundancy(rows, _OUTCOMES, terms).biplot_scores(), 5, "rda1", "rda2")


@query("rda_contributions", """
    WITH t AS (SELECT event_type AS var, avg(value) AS rda1, stddev_samp(value) AS rda2
               FROM events GROUP BY ALL)
    SELECT var, round_even(rda1 * rda1 / sum(rda1 * rda1) OVER () * 100, 2) AS rda1,
           round_even(rda2 * rda2 / sum(rda2 * rda2) OVER () * 100, 2) AS rda2
    FROM t ORDER BY var""")
def rda_contributions(spark, folder):
    loadings = table(spark, folder, "events").groupBy(F.col("event_type").alias("var")).agg(
        F.avg("value").alias("rda1"), F.stddev_samp("value").alias("rda2")
    )
    return partition.contributions(loadings, "var", ["rda1", "rda2"])


# ---------------------------------------------------------------- permutation tests

_SEED = 7


#: Permutations of the overall, the axis and the term tests.
_OVERALL, _AXES, _TERM_DRAWS = 1000, 999, 10_000


def _suppliers(spark, folder):
    """Two predictors and three responses for each supplier: means over its lines; and its nation."""
    c = F.col
    means = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        F.avg("l_quantity").alias("x1"), (F.avg("l_tax") * 100).alias("x2"),
        (F.avg("l_extendedprice") / 1000).alias("y1"), (F.avg("l_discount") * 100).alias("y2"),
        F.avg(c("l_quantity") * c("l_discount")).alias("y3"),
    )
    nations = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    return stored(means.join(nations, means.l_suppkey == nations.s_suppkey), "suppliers")


def _permuted_sql(source, permutations, responses, strata=False, crossed=False):
    """Sums for every permutation of ``source(rid, x1, x2, y..)``, predictors orthonormalised.

    With ``strata`` the source also has ``st``, and rows swap within its values; with ``crossed``
    the predictors are permuted too.
    """
    st = "st" if strata else "'' AS st"
    ys = ", ".join(responses)
    centred = ", ".join(f"{c} - avg({c}) OVER () AS {c}" for c in ["x1", "x2", *responses])
    sums = ", ".join(f"sum(z{j} * {y}) AS s{j}_{y}" for j in (1, 2) for y in responses)
    paired = ", ".join(f"sum(stay.z{j} * swap.{y}) AS s{j}_{y}" for j in (1, 2) for y in responses)
    if crossed:
        paired += "".join(f", sum(stay.z{j} * swap.z{k}) AS t{j}{k}" for j in (1, 2) for k in (1, 2))
    squares = {j: " + ".join(f"s{j}_{y} * s{j}_{y}" for y in responses) for j in (1, 2)}
    total = " + ".join(f"sum({y} * {y})" for y in responses)
    return f"""
    WITH base AS ({source}),
    c AS (SELECT rid, {st}, {centred} FROM base),
    g AS (SELECT sum(x1 * x1) AS xx, sum(x1 * x2) AS xw FROM c),
    o AS (SELECT rid, st, x1 / sqrt(xx) AS z1, x2 - xw / xx * x1 AS w, {ys} FROM c, g),
    z AS (SELECT rid, st, z1, w / sqrt(sum(w * w) OVER ()) AS z2, {ys} FROM o),
    {places("z", permutations, _SEED, [*responses, "z1", "z2"] if crossed else responses)},
    ps AS (SELECT b, {paired} FROM swap JOIN stay USING (pos) GROUP BY b),
{_tested_sql(sums, squares, total)}"""


def _tested_sql(sums, squares, total):
    """Observed sums next to those of each permutation ``ps``."""
    return f"""    p AS (SELECT {squares[1]} AS ss1, {squares[2]} AS ss2 FROM ps),
    os AS (SELECT count(*) AS n, {total} AS sst, {sums} FROM z),
    obs AS (SELECT n, sst, n - 3 AS df, {squares[1]} AS o1, {squares[2]} AS o2 FROM os),
    t AS (SELECT obs.*, ss1, ss2, (sst - o1 - o2) / df AS oe, (sst - ss1 - ss2) / df AS pe
          FROM obs, p)"""


_P = "(1 + count(*) FILTER ({0} >= {1} * (1 - 1e-9))) / (count(*) + 1)::DOUBLE"


def _overall_sql(digits):
    hit = _P.format("(ss1 + ss2) / 2 / pe", "(o1 + o2) / 2 / oe")
    return f"""
    SELECT 1 AS ord, 'Model' AS term, CAST(2 AS BIGINT) AS df,
           round(any_value((o1 + o2) / (n - 1)), {digits}) AS variance,
           round(any_value((o1 + o2) / 2 / oe), 5) AS statistic, {hit} AS p_value FROM t
    UNION ALL
    SELECT 2, 'Residual', df, round((sst - o1 - o2) / (n - 1), {digits}), NULL, NULL FROM obs"""


def _terms_sql(digits, names):
    one = """
    SELECT {j} AS ord, '{name}' AS term, CAST(1 AS BIGINT) AS df,
           round(any_value(o{j} / (n - 1)), {digits}) AS variance,
           round(any_value(o{j} / oe), 5) AS statistic, {hit} AS p_value,
           round(any_value(o{j} / sst), 8) AS prop FROM t"""
    rows = [
        one.format(j=j, name=name, digits=digits, hit=_P.format(f"ss{j} / pe", f"o{j} / oe"))
        for j, name in enumerate(names, start=1)
    ]
    rest = f"""
    SELECT 3, 'Residual', df, round((sst - o1 - o2) / (n - 1), {digits}), NULL, NULL,
           round((sst - o1 - o2) / sst, 8) FROM obs"""
    return " UNION ALL ".join([*rows, rest])


def _suppliers_sql(permutations, strata=False, crossed=False):
    return _permuted_sql(
        f"""SELECT length(k) || ':' || k AS rid, {"length(st) || ':' || st AS st, " if strata else ""}x1, x2, y1, y2, y3 FROM (
              SELECT CAST(l_suppkey AS VARCHAR) AS k, CAST(any_value(s_nationkey) AS VARCHAR) AS st, avg(l_quantity) AS x1,
                     avg(l_tax) * 100 AS x2, avg(l_extendedprice) / 1000 AS y1, avg(l_discount) * 100 AS y2,
                     avg(l_quantity * l_discount) AS y3
              FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)""",
        permutations, ["y1", "y2", "y3"], strata, crossed)


def _supplier_fit(spark, folder):
    rows = _suppliers(spark, folder)
    return ordination.redundancy(rows, ["y1", "y2", "y3"], ["x1", "x2"]), rows


def _overall(spark, folder):
    fit, rows = _supplier_fit(spark, folder)
    return permute.overall_test(fit, permute.permuted_sums(fit, rows, ["l_suppkey"], _OVERALL, _SEED))


def _axes(spark, folder):
    fit, rows = _supplier_fit(spark, folder)
    return permute.axes_test(fit, permute.permuted_sums(fit, rows, ["l_suppkey"], _AXES, _SEED, with_predictors=True))


def _terms(spark, folder):
    fit, rows = _supplier_fit(spark, folder)
    return permute.terms_test(fit, permute.permuted_sums(fit, rows, ["l_suppkey"], _TERM_DRAWS, _SEED))


def _rounded_test(out, digits):
    out = rounded(rounded(out, digits, "variance"), 5, "statistic")
    return rounded(out, 8, "prop") if "prop" in out.columns else out


@query("rda_perm_overall", _suppliers_sql(_OVERALL) + _overall_sql(10))
def rda_perm_overall(spark, folder):
    return _rounded_test(_overall(spark, folder), 10)


@query("rda_perm_terms", _suppliers_sql(_TERM_DRAWS) + _terms_sql(10, ["x1", "x2"]))
def rda_perm_terms(spark, folder):
    return _rounded_test(_terms(spark, folder), 10)


def _axis_sql(responses):
    """Axis tests of two predictors: 2 x 2 eigenvalues, the second axis given the first."""
    seen = ", ".join(f"o.s{j}_{y} AS o{j}_{y}" for j in (1, 2) for y in responses)
    ys = ", ".join(responses)

    def gram(s, i, j):
        return " + ".join(f"{s}{i}_{y} * {s}{j}_{y}" for y in responses)

    def top(a, b, d):
        return f"(({a} + {d}) / 2 + sqrt(({a} - {d}) ** 2 / 4 + {b} ** 2))"

    fitted = ", ".join(f"u1 * o1_{y} + u2 * o2_{y} AS f_{y}" for y in responses)
    moved = ", ".join(
        f"s{j}_{y} - (t{j}1 * u1 + t{j}2 * u2) * f_{y} AS m{j}_{y}"
        for j in (1, 2) for y in responses
    )
    gone = " + ".join(f"(u1 * m1_{y} + u2 * m2_{y}) ** 2" for y in responses)
    now = " + ".join(f"(u1 * m2_{y} - u2 * m1_{y}) ** 2" for y in responses)
    kept = " + ".join(f"f_{y} ** 2" for y in responses)
    first = _P.format("l1 / ((sst - a - d) / df)", "e1 / oe")
    second = _P.format("now / ((sst - kept - gone - now) / df)", "e2 / oe")
    return f""",
    j AS (SELECT ps.*, {seen}, obs.n, obs.sst, obs.df,
                 {gram("o.s", 1, 1)} AS oa, {gram("o.s", 1, 2)} AS ob, {gram("o.s", 2, 2)} AS od
          FROM ps, os AS o, obs),
    k AS (SELECT *, {gram("s", 1, 1)} AS a, {gram("s", 1, 2)} AS bb, {gram("s", 2, 2)} AS d,
                 {top("oa", "ob", "od")} AS e1, (sst - oa - od) / df AS oe FROM j),
    k2 AS (SELECT *, oa + od - e1 AS e2, {top("a", "bb", "d")} AS l1,
                  ob / sqrt(ob ** 2 + (e1 - oa) ** 2) AS u1,
                  (e1 - oa) / sqrt(ob ** 2 + (e1 - oa) ** 2) AS u2 FROM k),
    k3 AS (SELECT *, {fitted} FROM k2),
    k4 AS (SELECT *, {moved} FROM k3),
    k5 AS (SELECT *, {gone} AS gone, {now} AS now, {kept} AS kept FROM k4)
    SELECT 1 AS ord, 'rda1' AS term, CAST(1 AS BIGINT) AS df,
           round(any_value(e1 / (n - 1)), 10) AS variance,
           round(any_value(e1 / oe), 5) AS statistic, {first} AS p_value FROM k5
    UNION ALL SELECT 2, 'rda2', CAST(1 AS BIGINT), round(any_value(e2 / (n - 1)), 10),
           round(any_value(e2 / oe), 5), {second} FROM k5
    UNION ALL SELECT 3, 'Residual', df, round((sst - o1 - o2) / (n - 1), 10), NULL, NULL FROM obs"""


@query("rda_perm_axis", _suppliers_sql(_AXES, crossed=True) + _axis_sql(["y1", "y2", "y3"]))
def rda_perm_axis(spark, folder):
    return _rounded_test(_axes(spark, folder), 10)


def _export_sql():
    """Overall and axis tests as one table, without residuals."""
    overall = _suppliers_sql(_OVERALL) + _overall_sql(10)
    axes = _suppliers_sql(_AXES, crossed=True) + _axis_sql(["y1", "y2", "y3"])
    return f"""SELECT term, df, round_even(variance, 2) AS variance, round_even(statistic, 2) AS statistic,
                      round_even(p_value, 2) AS p_value
               FROM (SELECT * FROM ({overall}) UNION ALL SELECT * FROM ({axes})) WHERE term <> 'Residual'"""


@query("rda_test_export", _export_sql())
def rda_test_export(spark, folder):
    out = permute.test_export(_overall(spark, folder), _axes(spark, folder))
    path = writers.write_result_csv(out, fresh_path(spark, "tests"), files=1)
    return readers.read_csv(spark, path, "term string, df bigint, variance double, statistic double, p_value double")


def _lines(spark, folder):
    c = F.col
    return table(spark, folder, "lineitem").select(
        c("l_quantity").alias("x1"), (c("l_tax") * 100).alias("x2"), (c("l_extendedprice") / 1000).alias("y1"),
        (c("l_discount") * 100).alias("y2"),
    )


def _normal_sql(source, draws):
    """Sums drawn from the normal limit, for two predictors and two responses."""
    def uniform(text, first):
        return f"((('0x' || substr({text}, {first}, 12))::BIGINT + 0.5) / 281474976710656.0)"

    cells = ", ".join(
        f"sqrt(-2 * ln({uniform(m, 1)})) * cos(2 * pi() * {uniform(m, 13)}) AS e{j}{i}"
        for j in (0, 1) for i in (0, 1) for m in [f"md5('{_SEED}-n-' || b || '-{j}-{i}')"])
    responses = ["y1", "y2"]
    sums = ", ".join(f"sum(z{j} * {y}) AS s{j}_{y}" for j in (1, 2) for y in responses)
    squares = {j: " + ".join(f"s{j}_{y} * s{j}_{y}" for y in responses) for j in (1, 2)}
    drawn = ", ".join(
        f"sqrt(a) * e{j}0 AS s{j + 1}_y1, w / sqrt(a) * e{j}0 + sqrt(d - w * w / a) * e{j}1 AS s{j + 1}_y2" for j in (0, 1))
    return f"""
    WITH base AS ({source}),
    c AS (SELECT {", ".join(f"{v} - avg({v}) OVER () AS {v}" for v in ("x1", "x2", "y1", "y2"))} FROM base),
    g AS (SELECT sum(x1 * x1) AS xx, sum(x1 * x2) AS xw FROM c),
    o AS (SELECT x1 / sqrt(xx) AS z1, x2 - xw / xx * x1 AS w, y1, y2 FROM c, g),
    z AS (SELECT z1, w / sqrt(sum(w * w) OVER ()) AS z2, y1, y2 FROM o),
    sy AS (SELECT sum(y1 * y1) / (count(*) - 1) AS a, sum(y1 * y2) / (count(*) - 1) AS w,
                  sum(y2 * y2) / (count(*) - 1) AS d FROM z),
    e AS (SELECT b, {cells} FROM range(1, {draws + 1}) AS numbers(b)),
    ps AS (SELECT b, {drawn} FROM e, sy),
{_tested_sql(sums, squares, "sum(y1 * y1) + sum(y2 * y2)")}"""


_LINES_SQL = _normal_sql(
    """SELECT l_quantity AS x1, l_tax * 100 AS x2, l_extendedprice / 1000 AS y1, l_discount * 100 AS y2
       FROM lineitem""", _TERM_DRAWS)


@query("rda_perm_lines", _LINES_SQL + _terms_sql(6, ["x1", "x2"]))
def rda_perm_lines(spark, folder):
    """Too many rows to permute ten thousand times: the caller asks for the normal limit."""
    fit = ordination.redundancy(_lines(spark, folder), ["y1", "y2"], ["x1", "x2"])
    return _rounded_test(permute.terms_test(fit, permute.normal_sums(fit, _TERM_DRAWS, _SEED)), 6)


@query("rda_perm_blocks", _suppliers_sql(_AXES, strata=True) + _terms_sql(10, ["x1", "x2"]))
def rda_perm_blocks(spark, folder):
    """Suppliers swap within their nation."""
    fit, rows = _supplier_fit(spark, folder)
    sums = permute.permuted_sums(fit, rows, ["l_suppkey"], _AXES, _SEED, strata="s_nationkey")
    return _rounded_test(permute.terms_test(fit, sums), 10)
