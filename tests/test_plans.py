"""The experiment's pipelines on small hand-made sources."""

import pytest
from pyspark.sql import functions as F

from trialframe.plans import effects, partition, plots, traits, vocabulary as v


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def names(spark):
    submitted = spark.createDataFrame(
        [("Scorzo",), ("Viola calcarta",), ("nothing like it",), ("ribes",), (None,), ("",)],
        "comments string")
    taxonomy = spark.createDataFrame(
        [("Viola calcarata", "Viola calcarata"), ("Ribes", "Ribes"), (None, "x")],
        "name string, accepted string")
    return traits.reconcile_names(submitted, taxonomy)


def test_names(names):
    assert rows(names) == {
        ("Scorzo", "Scorzoneroides pyrenaica var. helvetica"), ("Viola calcarta", "Viola calcarata")}


def test_long_texts_are_matched(spark):
    long = "ab" * 10_000
    submitted = spark.createDataFrame([(long[:14_000] + "x" + long[14_001:],), ("y" * 20_000,)], "comments string")
    taxonomy = spark.createDataFrame([(long, "the long one"), ("Viola", "Viola")], "name string, accepted string")
    got = {r.comments[:1]: r.species for r in traits.closest_names(submitted, taxonomy).collect()}
    assert got == {"a": "the long one", "y": None}


def test_trait_table_and_means(spark, names):
    long = "subplotmaincode string, num_point double, year int, comments string, lb_nom string, " \
           "cd_ref string, code_unite string, code_trait string, value double"
    base = ("L_01_T", 1.0, 2021, "Viola calcarta", "other", "7", "u")
    sparse = ("G_10_C", 2.0, 2021, None, "Patzkea", "8", "u")
    lone = ("L_02_C", 3.0, 2021, "zz", "aaa +++ En attente de détermination", "9", "u")
    data = [(*base, "D_Mass", 2.0), (*base, "F_Mass", 8.0), (*base, "L_Area", 4.0),
            (*base, "H_Veg", 15.0), (*base, "H_Repr", 99.0),
            (*sparse, "H_Veg", 5.0), (*lone, "H_Veg", 6.0), (*lone, "D_Mass", 0.0)]
    nutrients = traits.nutrient_table(spark.createDataFrame(
        [("LT01-1", 20.0), ("??", 1.0)], "plot string, n double"))
    assert rows(nutrients) == {("AlpineWarmed", "01", 1.0, 2021, 2.0), (None, None, None, 2021, 0.1)}
    table = traits.trait_table(spark.createDataFrame(data, long), names, nutrients)
    got = {r.num_point: r for r in table.collect()}
    assert set(got) == {1.0, 3.0}  # the Patzkea at the alpine control is an outlier
    first = got[1.0]
    assert (first.species, first.combi_fac, first.rep) == ("Viola calcarata", "AlpineWarmed", "01")
    assert first.sla == pytest.approx(200.0) and first.lma == pytest.approx(1 / 200)
    assert first.ldmc == pytest.approx(250.0) and first.lnc == 2.0
    assert got[3.0].species == "Undetermined" and got[3.0].sla is None and got[3.0].lnc is None
    means = {r.combi_fac: r.vheight for r in traits.trait_means(table).collect()}
    assert means == {"AlpineWarmed": 15.0, "SubalpineControl": 6.0}
    gaps = {r.combi_fac: r.lnc for r in traits.trait_gaps(table, individuals=4.0).collect()}
    assert gaps == {"AlpineWarmed": 0.0, "SubalpineControl": 25.0}


def test_moisture(spark):
    readings = plots.moisture_readings(spark.createDataFrame(
        [("03/07/2021 10", "P1", "GC", "D", 1.0), ("03/07/2021 10", "P1", "GC", "X", 2.0),
         ("bad", "P1", "GC", "C", 50.0), ("x", "P10", "GT", "C", 3.0), ("x", "P11", "GT", "C", 4.0),
         ("x", "P2", "LT", "D", None)],
        "timestamp string, plot string, site string, subplot string, moisture double"))
    assert rows(plots.plot_moisture(readings)) == {
        ("AlpineControl", "01", 1.5), ("SubalpineCooled", "10", 3.0),
        ("SubalpineCooled", None, 4.0), ("AlpineWarmed", "02", None)}


def test_colonisation(spark):
    counts = spark.createDataFrame(
        [("LT01", 1, 2.0, 0.0), ("LT01", 1, 0.0, 1.0), ("LT01", 2, 3.0, None), ("LA01", 1, 1.0, 1.0),
         ("XX02", 1, 1.0, 0.0)],
        "sample string, sample_no int, arbuscule double, hypha double")
    assert rows(plots.root_colonisation(counts, 4)) == {
        ("AlpineWarmed", "01", 25.0, None), ("XX", "02", 25.0, 0.0)}


def test_site_differences(spark):
    env = spark.createDataFrame([("alpine", 10.0, 100.0), ("subalpine", 12.5, 160.2)],
                                "site string, soil_temperature_shallow_july double, length_gs_annual double")
    assert rows(plots.site_differences(env)) == {(2.0, 60.0)}


def test_annotation_defaults(spark):
    df = spark.createDataFrame([("lma", 1), ("soil_temperature", 2), ("new one", 3)], "var string, x int")
    assert rows(effects.annotate(df)) == {
        ("LMA", 1, "Conservation gradient", 2, "Aboveground", "Functional traits"),
        ("Soil temperature", 2, None, None, "soil", "ES"), ("new one", 3, None, None, "soil", "ES")}


def test_effect_table_repeats_the_shared_group(spark):
    means = spark.createDataFrame([("x", g, 1.0) for g in v.TREATMENTS], "var string, grp string, estimate double")
    tests = spark.createDataFrame(
        [("x", "Warming effect", -2.0, 0.01), ("x", "Warming lag", 3.0, None)],
        "var string, contrast string, estimate double, adj_p_value double")
    out = effects.effect_table(means, tests).select("grp", "contrast", "magnitude", "mark", "grp_order")
    assert rows(out) == {
        ("AlpineControl", "Warming effect", 2.0, "*", 1), ("AlpineWarmed", "Warming effect", 2.0, "*", 2),
        ("AlpineWarmed", "Warming lag", 3.0, None, 2), ("SubalpineControl", "Warming lag", 3.0, None, 3)}
    arrow = effects.segments(effects.effect_table(means, tests), "Warming lag", ("AlpineWarmed", "SubalpineControl"))
    assert arrow.count() == 2


def test_variance_partition_labels(spark):
    terms = spark.createDataFrame(
        [(1, "soil_p", 3.0, 0.01), (2, "moisture", 0.005, 0.5), (3, "Residual", 6.995, None)],
        "ord int, term string, variance double, p_value double")
    got = {r.term: r for r in partition.variance_partition(
        terms, v.STRESS_TERM_LABELS, v.STRESS_TERM_LEVELS).collect()}
    assert got["P concentration"].label == "P concentration * \n 30.00%"
    assert got["Moisture"].label is None and got["Residuals"].mark == ""
    assert got["Residuals"].cumsum == pytest.approx(0.6995)
    assert got["Moisture"].cumsum == pytest.approx(1.0)


def test_contributions_sum_to_a_hundred(spark):
    df = spark.createDataFrame([("b", 1.0, 2.0), ("a", 3.0, -2.0)], "var string, rda1 double, rda2 double")
    assert [tuple(r) for r in partition.contributions(df, "var", ["rda1", "rda2"]).collect()] == [
        ("a", 90.0, 50.0), ("b", 10.0, 50.0)]


def test_climate_indicator(spark):
    df = spark.createDataFrame([("AlpineControl",), ("AlpineWarmed",), (None,)], "combi_fac string")
    assert rows(plots.climate_change_indicator(df)) == {
        ("AlpineControl", 0.0), ("AlpineWarmed", 1.0), (None, 1.0)}
