"""Statistics against plain numpy on small tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialframe.operators import crossproducts, linmodel, ordination, permute

CONTRASTS = {"ab": {"a": -1.0, "b": 1.0}, "bc": {"b": -1.0, "c": 1.0}}


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": list("a" * 9 + "b" * 10 + "c" * 11), "x": rng.normal(size=30)})
    pdf["x"] += pdf.g.map({"a": 0.0, "b": 1.0, "c": 1.2})
    pdf["flat"] = pdf.g.map({"a": 1.0, "b": 2.0, "c": 2.0})
    pdf["gap"] = pdf.x.where(pdf.index % 4 != 0)
    pdf["two"] = pdf.x.where(pdf.g != "c")
    return pdf


@pytest.fixture(scope="module")
def fitted(spark, groups):
    df = spark.createDataFrame(groups).withColumns(
        {c: F.when(~F.isnan(c), F.col(c)) for c in ("x", "flat", "gap", "two")})
    fit = linmodel.fit_one_way(df, "g", ["x", "flat", "gap", "two"], CONTRASTS)
    return [t.toPandas().set_index(i) for t, i in zip(
        fit, (["var", "grp"], ["var", "contrast"], ["var"]))]


def test_model_summary_equals_least_squares(fitted, groups):
    part = groups.dropna(subset=["gap"])
    x = pd.get_dummies(part.g).to_numpy(float)
    beta, sse = np.linalg.lstsq(x, part.gap, rcond=None)[:2]
    n, row = len(part), fitted[2].loc["gap"]
    log_lik = -n / 2 * (np.log(2 * np.pi) + np.log(sse[0] / n) + 1)
    assert row.nobs == n and row.df_residual == n - 3 and row.df == 2
    assert row.deviance == pytest.approx(sse[0])
    assert row.log_lik == pytest.approx(log_lik)
    assert row.aic == pytest.approx(-2 * log_lik + 8)
    assert row.bic == pytest.approx(-2 * log_lik + 4 * np.log(n))
    assert row.p_value == pytest.approx((1 + 2 * row.statistic / (n - 3)) ** (-(n - 3) / 2))
    assert fitted[0].loc[("gap", "b")].estimate == pytest.approx(beta[1])


def test_means_and_contrasts(fitted, groups):
    sigma = fitted[2].loc["x"].sigma
    b = fitted[0].loc[("x", "b")]
    assert b.std_error == pytest.approx(sigma / np.sqrt(10))
    assert b.upper_cl - b.estimate == pytest.approx(2.0518305 * b.std_error, rel=1e-6)  # t(.975, 27)
    c = fitted[1].loc[("x", "ab")]
    means = groups.groupby("g").x.mean()
    assert c.estimate == pytest.approx(means.b - means.a)
    assert c.std_error == pytest.approx(sigma * np.sqrt(1 / 9 + 1 / 10))
    rng = np.random.default_rng(2)
    e = rng.standard_normal((400_000, 3)) / np.sqrt([9, 10, 11])
    s = np.sqrt(rng.chisquare(27, 400_000) / 27)
    t = np.maximum(abs(e[:, 1] - e[:, 0]) / np.sqrt(1 / 9 + 1 / 10),
                   abs(e[:, 2] - e[:, 1]) / np.sqrt(1 / 10 + 1 / 11)) / s
    assert c.adj_p_value == pytest.approx((t > abs(c.statistic)).mean(), abs=3e-3)
    half = (c.upper_cl - c.lower_cl) / 2 / c.std_error
    assert (t > half).mean() == pytest.approx(0.05, abs=2e-3)


def test_perfect_fit_keeps_means_only(fitted):
    row = fitted[0].loc[("flat", "b")]
    assert row.estimate == 2.0 and np.isnan([row.p_value, row.lower_cl, row.std_error]).all()
    assert np.isnan(fitted[1].loc[("flat", "ab")].adj_p_value)


def test_contrast_without_its_group_is_missing(fitted):
    assert np.isnan(fitted[1].loc[("two", "bc")].estimate)
    assert not np.isnan(fitted[1].loc[("two", "ab")].adj_p_value)


def test_moments_use_complete_rows_and_keep_digits(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(rng.normal(size=(200, 3)) + 1e8, columns=list("xyz"))
    df = spark.createDataFrame(pdf).withColumn("y", F.when(F.rand(1) > 0.3, F.col("y")))
    pdf = df.dropna().toPandas()
    m = crossproducts.moments(df, list("xyz"))
    np.testing.assert_allclose(m.covariance, np.cov(pdf.to_numpy().T), rtol=1e-5)


def test_moments_of_many_columns(spark):
    """Five hundred columns, with gaps: as matrices within tasks, equal to numpy."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(700, 500)) @ np.diag(rng.uniform(0.5, 2, 500)) + 1e6
    names = [f"c{i}" for i in range(500)]
    rows = [(i, [None if (i % 97 == 0 and j == i % 500) else float(v) for j, v in enumerate(r)]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, v array<double>").repartition(6)
    df = df.select("id", *[F.col("v")[i].alias(c) for i, c in enumerate(names)])
    whole = x[np.arange(700) % 97 != 0]
    m = crossproducts.moments(df, names)
    assert m.n == len(whole)
    np.testing.assert_allclose(m.mean, whole.mean(axis=0), rtol=1e-12)
    np.testing.assert_allclose(m.covariance, np.cov(whole.T), atol=1e-8)
    fit = ordination.principal_components(df, names, 2)
    np.testing.assert_allclose(fit.eigenvalues, np.linalg.eigvalsh(np.cov(whole.T))[::-1], atol=1e-7)
    few = names[:3]  # the aggregate of pairs and the matrices agree
    narrow = crossproducts.moments(df, few)
    n, total, cross = crossproducts._summed(crossproducts.complete_rows(df, few).select(*few), narrow.mean)
    assert n == narrow.n
    np.testing.assert_allclose(cross, narrow.cross, rtol=1e-9, atol=1e-6)


def test_terms_of_several_columns_and_aliased_terms(spark):
    rng = np.random.default_rng(14)
    n = 60
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.normal(size=n), "zone": rng.choice(["x", "y", "z"], n)})
    pdf["p"], pdf["q"] = pdf.a + (pdf.zone == "y") * 0.8 + rng.normal(size=n), rng.normal(size=n)
    df, zone = ordination.with_levels(spark.createDataFrame(pdf), "zone", ["x", "y", "z"])
    df = df.withColumns({"twice": F.col("a") * 2 + 1, "mix": F.col("zone[y]") - F.col("a"), "flat": F.lit(3.0)})
    fit = ordination.redundancy(df, ["p", "q"], ["a", "twice", zone, "mix", "flat"])
    terms = {r.term: r for r in fit.terms_table().collect()}
    assert {t: (r.df, r.aliased) for t, r in terms.items()} == {
        "a": (1, False), "twice": (0, True), "zone": (2, False), "mix": (0, True), "flat": (0, True)}
    assert {r.n for r in terms.values()} == {n}
    half = ordination.redundancy(df, ["p"], ["zone[y]", ("pair", ["mix", "a"])])
    assert [(r.term, r.df, r.aliased) for r in half.terms_table().collect()] == [("zone[y]", 1, False), ("pair", 1, False)]
    got = permute.terms_test(fit, permute.permuted_sums(fit, df, ["id"], 999, 3)).toPandas().set_index("term")
    assert list(got.index) == ["a", "twice", "zone", "mix", "flat", "Residual"] and list(got.df) == [1, 0, 2, 0, 0, n - 4]
    assert got.loc[["twice", "mix", "flat"], ["variance", "statistic", "p_value", "prop"]].isna().all().all()
    y = pdf[["p", "q"]].to_numpy() - pdf[["p", "q"]].to_numpy().mean(axis=0)
    design = np.column_stack([np.ones(n), pdf.a, pdf.zone == "y", pdf.zone == "z"]).astype(float)

    def f_zone(y):
        def left(x):
            return ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()

        return (left(design[:, :2]) - left(design)) / 2 / (left(design) / (n - 4))

    assert got.statistic["zone"] == pytest.approx(f_zone(y))
    draws = np.array([f_zone(y[rng.permutation(n)]) for _ in range(999)])
    assert got.p_value["zone"] == pytest.approx((1 + (draws >= f_zone(y)).sum()) / 1000, abs=0.05)
    assert got.prop.sum() == pytest.approx(1)


def test_varimax_of_three_columns():
    rng = np.random.default_rng(15)
    raw = rng.normal(size=(9, 3))
    found = ordination.varimax(raw)
    np.testing.assert_allclose(found @ found.T, raw @ raw.T, atol=1e-10)
    height = np.linalg.norm(raw, axis=1, keepdims=True)

    def simplicity(m):
        return ((m / height) ** 4).mean() - (((m / height) ** 2).mean(axis=0) ** 2).sum() / 3

    best = simplicity(found)
    for _ in range(200):
        turn = np.linalg.qr(np.eye(3) + 0.05 * rng.normal(size=(3, 3)))[0]
        assert simplicity(found @ turn) <= best + 1e-9


def test_principal_components(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd"))).repartition(5)
    fit = ordination.principal_components(df, list("abcd"), 2)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    np.testing.assert_allclose(fit.eigenvalues, values[::-1])
    raw = vectors[:, ::-1][:, :2] * np.sqrt(values[::-1][:2])
    np.testing.assert_allclose(fit.loadings @ fit.loadings.T, raw @ raw.T, atol=1e-9)

    def simplicity(m):
        unit = m / np.linalg.norm(m, axis=1, keepdims=True)
        return (unit**4).mean() - ((unit**2).mean(axis=0) ** 2).mean()

    turns = [raw @ np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
             for t in np.linspace(0, np.pi, 721)]
    assert simplicity(fit.loadings) == pytest.approx(max(map(simplicity, turns)), abs=1e-4)
    assert (fit.loadings.sum(axis=0) > 0).all()
    scores = fit.scores(df, []).toPandas().to_numpy()
    np.testing.assert_allclose(np.cov(scores.T), np.eye(2), atol=1e-8)


def test_parallel_analysis_agrees_with_direct_simulation(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(25, 4))
    x[:, 1] += 2 * x[:, 0]
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")))
    got = ordination.parallel_analysis(df, list("abcd"), 2000).toPandas().sort_values("component")
    draws = np.array([np.corrcoef(rng.normal(size=(25, 4)).T) for _ in range(2000)])
    np.testing.assert_allclose(
        got.random, ordination.common_factor_eigenvalues(draws).mean(axis=0), atol=0.02)
    corr = np.corrcoef(x.T)
    smc = corr - np.diag(1 / np.diag(np.linalg.inv(corr)))
    np.testing.assert_allclose(got.observed, np.sort(np.linalg.eigvalsh(smc))[::-1], atol=1e-9)
    assert got.retained.iloc[0]


@pytest.fixture(scope="module")
def rda(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(40, 3))
    y = x[:, :2] @ rng.normal(size=(2, 3)) + rng.normal(size=(40, 3))
    pdf = pd.DataFrame(np.hstack([x, y]), columns=["a", "b", "c", "p", "q", "r"])
    pdf["id"] = np.arange(40)
    df = ordination.with_interactions(spark.createDataFrame(pdf).repartition(4), ["a:b"])
    df = df.withColumn("copy", F.col("a") * 2 - F.col("b"))
    terms = ["a", "b", "copy", "c", "a:b"]
    fit = ordination.redundancy(df, ["p", "q", "r"], terms)
    design = np.column_stack([pdf.a, pdf.b, pdf.c, pdf.a * pdf.b])
    return fit, df, design - design.mean(axis=0), y - y.mean(axis=0)


def test_redundancy_equals_direct_decomposition(rda):
    fit, df, x, y = rda
    assert fit.aliased == ("copy",) and fit.terms == ("a", "b", "c", "a:b")
    fitted = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    u, s, vt = np.linalg.svd(fitted, full_matrices=False)
    np.testing.assert_allclose(fit.axes[0], s**2)
    row = fit.r_squared().first()
    assert row.r_squared == pytest.approx((fitted**2).sum() / (y**2).sum())
    assert row.adj_r_squared == pytest.approx(1 - (1 - row.r_squared) * 39 / 35)
    sites = fit.site_scores(df, ["id"]).toPandas().sort_values("id")[["rda1", "rda2"]].to_numpy()
    np.testing.assert_allclose(abs(sites), abs((y @ vt.T / s * np.sqrt(39))[:, :2]), atol=1e-8)
    biplot = fit.biplot_scores().toPandas()[["rda1", "rda2"]].to_numpy()
    want = [[np.corrcoef(x[:, i], u[:, a])[0, 1] for a in (0, 1)] for i in range(4)]
    np.testing.assert_allclose(abs(biplot), abs(np.array(want)), atol=1e-8)


def test_term_shares_equal_sequential_refits(rda):
    fit, _, x, y = rda

    def explained(k):
        return (np.linalg.lstsq(x[:, :k], y, rcond=None)[0].T @ x[:, :k].T @ y).trace() if k else 0

    np.testing.assert_allclose(fit.term_ss, [explained(k + 1) - explained(k) for k in range(4)])
    assert fit.term_ss.sum() + fit.residual_ss == pytest.approx((y**2).sum())


def _f_terms(x, y):
    n, q = x.shape
    z = np.linalg.qr(x)[0]
    ss = ((z.T @ y) ** 2).sum(axis=1)
    return ss / (((y**2).sum() - ss.sum()) / (n - q - 1))


@pytest.mark.parametrize("design", ["free", "one stratum", "normal"])
def test_term_test_agrees_with_full_refits(spark, rda, design):
    fit, df, x, y = rda
    if design == "normal":
        sums = permute.normal_sums(fit, 1999, 3)
    else:
        strata = None if design == "free" else "all"
        sums = permute.permuted_sums(fit, df.withColumn("all", F.lit(1)), ["id"], 499, 3, strata)
    got = permute.terms_test(fit, sums).toPandas().set_index("term")
    assert got.df["copy"] == 0 and np.isnan(got.statistic["copy"])
    got = got.drop("copy")
    rng = np.random.default_rng(0)
    observed = _f_terms(x, y)
    draws = np.array([_f_terms(x, y[rng.permutation(40)]) for _ in range(1999)])
    np.testing.assert_allclose(got.statistic.iloc[:4], observed)
    want = (1 + (draws >= observed).sum(axis=0)) / 2000
    np.testing.assert_allclose(got.p_value.iloc[:4], want, atol=0.08)
    assert got.prop.sum() == pytest.approx(1)
    assert np.isnan(got.p_value["Residual"])


def test_axis_test_agrees_with_full_refits(spark, rda):
    fit, df, x, y = rda
    sums = permute.permuted_sums(fit, df, ["id"], 499, 3, with_predictors=True)
    got = permute.axes_test(fit, sums).toPandas().set_index("term")
    z = np.linalg.qr(x)[0]
    u = np.linalg.svd(z @ z.T @ y, full_matrices=False)[0][:, :3]
    rng = np.random.default_rng(1)
    for i in range(3):
        cond = u[:, :i]
        e = y - cond @ cond.T @ y

        def stat(e):
            e = e - cond @ cond.T @ e
            fitted = z @ z.T @ e
            return np.linalg.svd(fitted)[1][0] ** 2 / (((e**2).sum() - (fitted**2).sum()) / 35)

        observed = stat(e)
        hits = sum(stat(e[rng.permutation(40)]) >= observed for _ in range(999))
        assert got.statistic.iloc[i] == pytest.approx(observed)
        assert got.p_value.iloc[i] == pytest.approx((1 + hits) / 1000, abs=0.08)


def test_partitioning_changes_no_permutation(spark, rda):
    fit, df, _, _ = rda

    def result(df, **design):
        rows = permute.permuted_sums(fit, df, ["id"], 5, 3, **design).orderBy("b").toPandas()
        return rows.to_numpy()

    whole = result(df)
    np.testing.assert_allclose(result(df.repartition(1)), whole)
    np.testing.assert_allclose(result(df.repartition(23)), whole)
    np.testing.assert_allclose(result(df.withColumn("all", F.lit("x")), strata="all"), whole)


@pytest.mark.parametrize("strata", [None, "half"])
def test_no_row_of_a_permutation_is_sent(spark, rda, monkeypatch, strata):
    """More predictors than responses: the rows in all permutations are the narrower side, and looked small to a join."""
    fit, df, _, _ = rda
    df = df.withColumn("half", F.col("id") % 2)
    plans = []

    def kept(df, label, stored=permute.stored):
        plans.append((label, df._jdf.queryExecution().optimizedPlan().toString()))
        return stored(df, label)

    monkeypatch.setattr(permute, "stored", kept)
    assert permute.permuted_sums(fit, df, ["id"], 50, 3, strata).count() == 50
    (plan,) = [p for label, p in plans if label == "sums"]
    assert "Join Inner" not in plan and "pos#" not in plan  # with strata, the rows meet their strata's sizes


@pytest.mark.parametrize("strata", [None, "half"])
@pytest.mark.parametrize("held, group, work", [(2**24, 2**18, 2**28), (4 * 15, 11, 40)])
def test_sums_of_small_cells_equal_those_over_placed_rows(spark, rda, monkeypatch, strata, held, group, work):
    fit, df, _, _ = rda
    df = df.withColumn("half", F.expr("CASE WHEN id % 4 > 0 THEN id % 4 > 1 END"))
    draws = 6
    for name, value in (("_HELD", held), ("_GROUP", group), ("_WORK", work)):
        monkeypatch.setattr(permute, name, value)
    got = permute.permuted_sums(fit, df, ["id"], draws, 3, strata, with_predictors=True).orderBy("b").toPandas()
    assert list(got.b) == list(range(1, draws + 1))
    q, m = len(fit.terms), len(fit.responses)
    rows = df.withColumns({"rid": permute.row_key(["id"]), "st": F.lit("") if strata is None else permute.row_key([strata])})
    rows = fit.whitened(rows, ["st", "rid"]).toPandas().sort_values(["st", "rid"], ignore_index=True)
    start = rows.groupby("st").st.transform(lambda s: s.index[0]).astype("int64")
    sized = pd.DataFrame({"start": start, "size": rows.groupby("st").st.transform("size").astype("int64"), "number": rows.index})
    places = permute._with_radices(spark.createDataFrame(sized)).withColumn("b", F.explode(F.expr(f"sequence(1, {draws})")))
    places = permute.placed(places, draws, 3).toPandas()
    z, y = rows[[f"z{j}" for j in range(q)]].to_numpy(), rows[[f"y{i}" for i in range(m)]].to_numpy()
    for row in got.to_dict("records"):
        at = places[places.b == row["b"]].sort_values("number").pos.to_numpy()
        want = np.concatenate([(z[at].T @ y).ravel(), (z[at].T @ z).ravel()])
        np.testing.assert_allclose([v for k, v in row.items() if k != "b"], want, atol=1e-9)


def test_looked_up_turns_equal_the_rounds():
    for start, size, wide, tall in [(0, 1, 1, 1), (5, 1000, 40, 25), (3, 9973, 141, 71), (0, 7, 3, 3)]:
        number = np.arange(size) + start
        one, key = np.ones(size, np.int64), permute._key(4, 9)[None]
        got = permute._moved(number, start * one, size * one, wide * one, tall * one, key) - start
        x = permute._once(number - start, key, start, wide, tall)
        while (out := x >= size).any():
            x[out] = permute._once(x[out], key, start, wide, tall)
        assert (got == x).all() and sorted(got) == list(range(size))


@pytest.mark.parametrize("sizes", [[1, 2, 3, 5, 40], [7, 1031], [4, 4, 4, 4]])
def test_places_are_a_permutation_of_each_stratum(spark, sizes):
    groups = spark.createDataFrame(
        [(sum(sizes[:k]), n) for k, n in enumerate(sizes)], "start long, size long")
    rows = permute._with_radices(groups).withColumn("number", F.explode(F.expr("sequence(start, start + size - 1)")))
    got = permute.placed(rows.withColumn("b", F.explode(F.expr("sequence(1, 40)"))), 40, 11).toPandas()
    for (_, start), part in got.groupby(["b", "start"]):
        assert sorted(part.pos) == list(range(start, start + len(part)))


def test_places_are_spread_evenly(spark):
    """Every number comes to every place about equally often, and pairs of numbers do too."""
    n, draws = 10, 20_000
    rows = permute._with_radices(spark.createDataFrame([(0, n)], "start long, size long"))
    rows = rows.withColumn("number", F.explode(F.expr("sequence(0, size - 1)")))
    rows = rows.withColumn("b", F.explode(F.expr(f"sequence(1, {draws})")))
    pos = permute.placed(rows, draws, 5).toPandas().pivot(index="b", columns="number", values="pos").to_numpy()
    for a in range(n):
        counts = np.bincount(pos[:, a], minlength=n)
        assert ((counts - draws / n) ** 2 / (draws / n)).sum() < 40  # chi-square of 9 degrees
    pairs = np.bincount(pos[:, 3] * n + pos[:, 8], minlength=n * n).reshape(n, n)[~np.eye(n, dtype=bool)]
    expected = draws / (n * (n - 1))
    assert ((pairs - expected) ** 2 / expected).sum() < 160  # 89 degrees


def test_numbers_are_dense_and_nothing_is_ordered_in_a_permutation(spark, rda):
    fit, df, _, _ = rda
    rows = permute.numbered(df.select("id"), ["id"])
    assert [r.number for r in rows.orderBy("id").collect()] == list(range(40))
    assert permute.numbered(df.select("id").limit(0), ["id"]).count() == 0
    sized = rows.withColumns({c: F.lit(v).cast("bigint") for c, v in {"start": 0, "size": 40, "wide": 8, "tall": 5}.items()})
    plan = permute.placed(sized.withColumn("b", F.lit(1)), 1, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_strata_keep_rows_inside(spark, rda):
    fit, df, x, y = rda
    alone = permute.permuted_sums(fit, df, ["id"], 3, 3, strata="id").toPandas()
    observed = fit.z_y.ravel()
    for row in alone.drop(columns="b").to_numpy():
        np.testing.assert_allclose(row, observed, atol=1e-9)


def test_row_keys_tell_missing_and_separated_values_apart(spark, rda):
    rows = [("1", "2", None), ("1", None, "2"), ("1-2", None, None), ("1:2", "", None), ("", "1:2", None), (None, None, None)]
    keys = spark.createDataFrame(rows, "a string, b string, c string").select(permute.row_key(["a", "b", "c"]).alias("k"))
    assert keys.distinct().count() == len(rows)
    fit, df, _, _ = rda
    with pytest.raises(ValueError, match="identify"):
        permute.permuted_sums(fit, df.withColumn("same", F.lit(1)), ["same"], 3)


def test_normal_sums_have_the_moments_of_permutation(spark, rda):
    fit, df, x, y = rda
    got = permute.normal_sums(fit, 20_000, 1, with_predictors=True).drop("b").toPandas()
    free = permute.permuted_sums(fit, df, ["id"], 4000, 1, with_predictors=True).drop("b").toPandas()
    scale = np.sqrt(np.diag(free.cov()))
    assert (abs(got.mean()) / scale < 0.05).all()
    np.testing.assert_allclose(got.cov() / np.outer(scale, scale), free.cov() / np.outer(scale, scale), atol=0.12)
