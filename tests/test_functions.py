"""Edge rows of the column functions."""

import math
import random
import statistics
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialframe.functions import coding, edits, missing, numeric, rules, tails, text
from trialframe.sources import readers


def one(spark, schema, rows, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_membership_and_missing(spark):
    x = F.col("x")
    got = one(spark, "x string", [("a",), ("b",), (None,), ("",)],
              missing.in_set(x, ["a"]), missing.not_in_set(x, ["a"]), missing.present(x),
              missing.matches(x, "^a"))
    assert got == [(True, False, True, True), (False, True, True, False),
                   (False, True, False, False), (False, True, False, False)]


def test_if_else_keeps_missing(spark):
    x = F.col("x")
    got = one(spark, "x double", [(1.0,), (-1.0,), (None,)], missing.presence(x),
              numeric.mark_or_ns(x), numeric.mark_or_blank(x))
    assert got == [(1, "ns", ""), (0, "*", "*"), (None, None, "")]


def test_strict_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 1.0), ("b", 2.0)], "g string, x double")
    x = F.col("x")
    got = df.groupBy("g").agg(missing.strict_sum(x), missing.strict_mean(x),
                              missing.share_missing(x), missing.share_missing(x, 4)).collect()
    assert {tuple(r) for r in got} == {("a", None, None, 50.0, 25.0), ("b", 3.0, 1.5, 0.0, 0.0)}


def test_keys(spark):
    p = F.col("p")
    got = one(spark, "p string", [("LT03-17",), ("L_10_C",), ("",), (None,)],
              text.extract(p, "^[A-Z]{2}"), text.extract(p, r"(?<=^[A-Z]{2})\d+"),
              text.to_number(text.extract(p, "(?<=-).*$")), text.extract(p, "(?<=[0-9]_)[CT]"),
              text.extract(p, r"(?<=^[LGCT]_)\d+"))
    assert got == [("LT", "03", 17.0, None, None), (None, None, None, "C", "10"),
                   (None,) * 5, (None,) * 5]


def test_numbers_from_text(spark):
    t = F.col("t")
    got = one(spark, "t string", [("plot 1,234.5 x",), ("-3",), ("abc",), ("12,5",), (None,), ("NaN",)],
              text.parse_number(t), text.to_number(t), text.decimal_comma(t))
    assert got == [(1234.5, None, None), (-3.0, -3.0, -3.0), (None, None, None),
                   (125.0, None, 12.5), (None, None, None), (None, None, None)]


def test_replicate_code(spark):
    got = one(spark, "n double", [(1.0,), (10.0,), (11.0,), (1.5,), (0.0,), (None,)],
              text.replicate_code(F.col("n")))
    assert got == [("01",), ("10",), (None,), (None,), (None,), (None,)]


def test_dates_and_paste(spark):
    t = F.col("t")
    got = one(spark, "t string", [("03/07/2021 10:00",), ("31/02/2021",), (None,)],
              text.parse_day(t), text.paste(F.lit("L"), text.extract(t, "^0")))
    assert got == [(date(2021, 7, 3), "L0"), (None, "LNA"), (None, "LNA")]


def test_codes(spark):
    c = F.col("c")
    codes = {"x": "X", "y": "Y"}
    got = one(spark, "c string", [("x",), ("q",), (None,)], coding.translate(c, codes),
              coding.recode(c, codes), coding.level_order(c, ["y", "x"]),
              coding.as_level(c, ["x"]), coding.indicator(c, ["x"]))
    assert got == [("X", "X", 2, "x", 0.0), (None, "q", None, None, 1.0),
                   (None, None, None, None, 1.0)]


def test_rounding_and_division(spark):
    x = F.col("x")
    got = one(spark, "x double", [(2.5,), (3.5,), (0.0,)], numeric.half_even(x),
              numeric.ratio(F.lit(1.0), x), F.ln(x))
    assert [r[0] for r in got] == [2.0, 4.0, 0.0]
    assert got[2][1] is None and got[2][2] is None


def test_total_decomposition_precedence(spark):
    got = one(spark, "a double", [(4.0,)], numeric.total_decomposition(*[F.lit(v) for v in (4.0, 1.0, 2.0, 2.0)]),
              numeric.joint_mass_loss(*[F.lit(v) for v in (4.0, 1.0, 2.0, 2.0)]))
    assert got == [(6.0 - 3.0 / 6.0, 0.5)]


def test_outlier_rule_three_valued(spark):
    df = spark.createDataFrame(
        [("s", 90.0), ("s", None), ("s", 10.0), ("t", None), (None, 90.0), (None, 10.0)],
        "species string, h double")
    kept = df.filter(rules.not_both(F.col("species") == "s", F.col("h") > 80)).collect()
    assert {tuple(r) for r in kept} == {("s", 10.0), ("t", None), (None, 10.0)}


@pytest.mark.parametrize("most", [1, 2])
def test_texts_within_the_edits_share_a_key(spark, most):
    rng = random.Random(most)
    pairs = []
    for _ in range(300):
        name = "".join(rng.choices("abc", k=rng.randint(1, 12)))
        text = list(name)
        for _ in range(rng.randint(0, most)):
            kind, at = rng.choice("ids"), rng.randint(0, len(text))
            text[at : at + (kind != "i")] = [] if kind == "d" else [rng.choice("abcd")]
        pairs.append(("".join(text), name))
    df = spark.createDataFrame(pairs, "text string, name string")
    shared = F.arrays_overlap(edits.probe_keys(F.col("text"), most), edits.segment_keys(F.col("name"), most))
    got = df.select(shared.alias("shared"), F.levenshtein("text", "name").alias("d")).collect()
    assert all(r.shared for r in got if r.d <= most) and any(r.d for r in got)
    size = df.select(F.max(F.size(edits.probe_keys(F.repeat("text", 1000), most)))).first()[0]
    assert size <= (2 * most + 1) ** 2 * (most + 1)


def test_clean_names():
    assert readers.clean_name("Moisture......") == "moisture"
    assert readers.clean_name("soil.tea_bag_green.mass.air_dry.2020") == "soil_tea_bag_green_mass_air_dry_2020"


def test_nan_becomes_null(spark):
    df = readers.normalise_missing(spark.createDataFrame([(float("nan"),), (1.0,)], "x double"))
    assert [r[0] for r in df.collect()] == [None, 1.0]


# Known values: quadrature against 4e6 Monte Carlo draws, rho -0.5, 27 degrees of freedom.
@pytest.mark.parametrize("t, p", [(1.0, 0.5108), (2.1, 0.0814), (2.5, 0.0347), (3.5, 0.00314)])
def test_joint_t_tail(t, p):
    assert tails.SimultaneousT([[1, -0.5], [-0.5, 1]], 27).upper(t) == pytest.approx(p, abs=6e-5)


def test_joint_t_critical():
    assert tails.SimultaneousT([[1, -0.5], [-0.5, 1]], 27).critical() == pytest.approx(2.3334, abs=1e-4)


def test_joint_t_of_three_against_monte_carlo():
    corr = np.array([[1, -0.5, 0.2], [-0.5, 1, -0.3], [0.2, -0.3, 1]])
    rng = np.random.default_rng(1)
    z = rng.standard_normal((400_000, 3)) @ np.linalg.cholesky(corr).T
    t = np.abs(z / np.sqrt(rng.chisquare(12, 400_000) / 12)[:, None]).max(axis=1)
    assert tails.SimultaneousT(corr, 12).upper(2.2) == pytest.approx((t > 2.2).mean(), abs=3e-3)


# Known values: for equal correlations, a double integral over the common part and the scale.
@pytest.mark.parametrize("k, rho, df, c", [(3, 0.5, 12, 2.2), (4, 0.5, 20, 2.5), (5, 0.3, 8, 3.0), (6, 0.5, 60, 2.4), (3, 0.0, 200, 2.4)])
def test_joint_t_against_quadrature(k, rho, df, c):
    z, w = np.polynomial.hermite_e.hermegauss(70)
    w = w / w.sum()
    # scale s with df s^2 chi-square, over a fine grid
    s = np.linspace(1e-4, 3, 1201)
    density = np.exp(np.log(2) + df / 2 * np.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2)
    phi = np.vectorize(statistics.NormalDist().cdf)
    inside = np.zeros_like(s)
    for x, weight in zip(z, w):
        if weight > 1e-14:
            at = math.sqrt(rho) * x
            both = phi((c * s - at) / math.sqrt(1 - rho)) - phi((-c * s - at) / math.sqrt(1 - rho))
            inside += weight * both**k
    want = 1 - np.trapezoid(inside * density, s)
    corr = np.full((k, k), rho) + (1 - rho) * np.eye(k)
    found = tails.SimultaneousT(corr, df, precision=2e-5)
    assert found.upper(c) == pytest.approx(want, abs=2e-5) and found.error <= 2e-5
    assert tails.SimultaneousT(corr, df).critical(1 - want) == pytest.approx(c, abs=3e-3)


def test_joint_t_of_dependent_contrasts_and_unmet_precision():
    corr = np.array([[1, -0.5, 0.5], [-0.5, 1, 0.5], [0.5, 0.5, 1.0]])  # the third is the sum of two
    assert tails.SimultaneousT(corr, 27).rank == 2
    four = np.full((4, 4), 0.2) + 0.8 * np.eye(4)
    with pytest.raises(ArithmeticError, match="known to"):
        tails.SimultaneousT(four, 9, precision=1e-9, most=4096).upper(2.0)


def test_single_tails():
    assert tails.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.f_upper(4.0, 2, 10) == pytest.approx((1 + 8 / 10) ** -5, rel=1e-12)
    assert tails.t_critical(10) == pytest.approx(2.228138852, abs=1e-8)
    assert tails.t_two_sided(1.959963985, 1e12) == pytest.approx(0.05, abs=1e-9)
    assert tails.f_upper(3, 3, 3.99e5) == pytest.approx(tails.f_upper(3, 3, 4.01e5), rel=1e-4)
    assert math.isclose(tails.t_two_sided(0, 5), 1)
