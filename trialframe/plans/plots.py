"""Plot-level sources, the integrated plot table and its standardised form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.coding import recode
from ..functions.missing import in_set
from ..functions.numeric import half_even, mass_loss, ratio, total_decomposition
from ..functions.rules import any_pairing
from ..functions.text import characters, parse_day, parse_number, replicate_code
from ..operators.aggregates import presence_rate
from ..operators.columns import lookup_value
from ..operators.joins import class_lookup, left_join
from ..operators.medians import group_median
from ..operators.standardize import standardize
from . import vocabulary as v


def moisture_readings(raw: DataFrame) -> DataFrame:
    """Parse the day and the decimal-comma reading of the logger table."""
    return raw.select(
        parse_day(F.col("timestamp")).alias("doy"), "plot", "site", "subplot", "moisture"
    )


def plot_moisture(readings: DataFrame) -> DataFrame:
    """Median moisture per treatment and replicate, from the subplots that count."""
    kept = readings.filter(
        any_pairing(F.col("site"), F.col("subplot"), v.SUBPLOTS_BY_SITE)
    ).select(
        recode(F.col("site"), v.TREATMENT_CODES).alias("combi_fac"),
        parse_number(F.col("plot")).alias("number"),  # its own step: used several times next
        "moisture",
    ).select("combi_fac", replicate_code(F.col("number")).alias("rep"), "moisture")
    return group_median(kept, ["combi_fac", "rep"], ["moisture"])


def root_colonisation(counts: DataFrame, fields: int = v.MICROSCOPE_FIELDS) -> DataFrame:
    """Colonised fields in percent: per sample, then the strict median per plot."""
    samples = presence_rate(
        counts, ["sample", "sample_no"],
        {"arbuscule_occ": "arbuscule", "hypha_occ": "hypha"}, fields,
    ).select(
        recode(characters(F.col("sample"), 1, 2), v.TREATMENT_CODES).alias("combi_fac"),
        characters(F.col("sample"), 3, 4).alias("rep"),
        "arbuscule_occ", "hypha_occ",
    ).filter(F.col("combi_fac") != v.EXCLUDED_SAMPLE_CODE)
    return group_median(
        samples, ["combi_fac", "rep"], ["arbuscule_occ", "hypha_occ"], strict=True,
        store_input=True,
    )


def site_differences(env: DataFrame) -> DataFrame:
    """One row: warming and season difference between the sites, rounded."""
    def gap(value):
        low = lookup_value(env, "site", "subalpine", value)
        return half_even(low - lookup_value(env, "site", "alpine", value))

    return env.sparkSession.range(1).select(
        gap("soil_temperature_shallow_july").alias("warming"),
        gap("length_gs_annual").alias("gsl"),
    )


def integrate(
    base: DataFrame, traits: DataFrame, moisture: DataFrame, colonisation: DataFrame,
    env: DataFrame,
) -> DataFrame:
    """Base plots with traits, moisture, root colonisation and site constants.

    Treatments that are left out at the end are already dropped on the way in.
    """
    plots = base.filter(F.col("combi_fac") != v.EXCLUDED_TREATMENT).withColumn(
        "year", F.lit(v.YEAR)
    )
    out = left_join(plots, traits, ["combi_fac", "rep", "year"])
    out = left_join(
        out, moisture.withColumn("year", F.lit(v.YEAR)), ["combi_fac", "rep", "year"]
    )
    out = left_join(out, colonisation, ["combi_fac", "rep"])
    return class_lookup(
        out, "combi_fac", v.ALPINE_SITE_TREATMENTS, env, "site", "alpine", "subalpine",
        {"soil_temperature": "soil_temperature_shallow_july",
         "growing_season_length": "length_gs_annual"},
    )


def _measures() -> tuple[dict[str, Column], set[str]]:
    """Every variable as an expression over the plot table, and the log-scaled ones.

    Unit factors are left out: they cancel in a z-score of logs, and the
    unscaled variables do not carry them.
    """
    c = F.col
    green = c("soil_tea_bag_green_mass_air_dry_2020"), c("soil_tea_bag_green_mass_dry_2021")
    red = c("soil_tea_bag_red_mass_air_dry_2020"), c("soil_tea_bag_red_mass_dry_2021")
    root = c("plant_below_qpcr_rdna_16s_copies_matrix_concentration")
    sand = c("soil_qpcr_rdna_16s_copies_matrix_concentration")
    logged = {
        "lma": c("lma"),
        "lnc": c("lnc"),
        "rnc": c("plant_below_n_concentration"),
        "rtd": c("plant_below_winrhizo_rtd"),
        "srl": c("plant_below_winrhizo_srl"),
        "rd": c("plant_below_winrhizo_diameter_average"),
        "vh": c("vheight"),
        "above_productivity": c("plant_up_aun"),
        "below_productivity": c("plant_below_whole_sample_mass_dry"),
        "rate_green_teabag": mass_loss(*green),
        "rate_red_teabag": mass_loss(*red),
        "tot_decomp": total_decomposition(*green, *red),
        "ratio_decomp": ratio(mass_loss(*green), mass_loss(*red)),
        "qpcr_root": root,
        "qpcr_soil": sand,
        "tot_qpcr": root + sand,
    }
    plain = {
        "arbuscule": c("arbuscule_occ"),
        "moisture": c("moisture"),
        "soil_nitrate": c("soil_nitrate_concentration"),
        "soil_p": c("soil_p_concentration"),
        "soil_om": c("soil_om_concentration"),
        "soil_temperature": c("soil_temperature"),
    }
    return {**logged, **plain}, set(logged)


def derive(plots: DataFrame, scaled: bool = True) -> DataFrame:
    """The 24-column analysis table: derived variables, standardised, gaps imputed.

    With ``scaled`` every variable is a z-score, most of them of logs; without,
    it stays in its own unit. Rows without a treatment are dropped, after they
    have counted towards means and deviations.
    """
    measures, logged = _measures()
    if scaled:
        measures = {k: F.ln(x) if k in logged else x for k, x in measures.items()}
    out = standardize(plots, measures, "combi_fac", v.IMPUTED, scaled)
    return out.filter(F.col("combi_fac").isNotNull()).select("combi_fac", "rep", *measures)


def analysis_groups(derived: DataFrame) -> DataFrame:
    """Rows of the treatments that are compared."""
    return derived.filter(F.col("combi_fac") != v.EXCLUDED_TREATMENT)


def climate_change_indicator(df: DataFrame) -> DataFrame:
    """``ecc``: 0 for the two control groups, 1 otherwise."""
    controls = in_set(F.col("combi_fac"), ["AlpineControl", "SubalpineControl"])
    return df.withColumn("ecc", F.when(controls, 0.0).otherwise(1.0))
