"""Tables behind the ordinations: variance partition, contributions, scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..functions.coding import recode
from ..functions.numeric import half_even, mark_or_blank, percent_label
from ..functions.text import paste
from ..operators.aggregates import centroids
from ..operators.ordination import Redundancy, principal_components, redundancy, with_interactions
from ..operators.reshape import longer, wider
from ..operators.windows import partition_share, running_share
from . import vocabulary as v
from .plots import climate_change_indicator


class Ordination(NamedTuple):
    """What is exported of a redundancy analysis."""

    sites: DataFrame
    centroids: DataFrame
    responses: DataFrame
    biplot: DataFrame
    response_contributions: DataFrame
    term_contributions: DataFrame


class Components(NamedTuple):
    """What is exported of rotated components."""

    loadings: DataFrame
    scores: DataFrame
    centroids: DataFrame


def control_components(derived: DataFrame, components: int = 2) -> Components:
    """Rotated components of the traits over the two control groups, with the groups' centroids."""
    rows = derived.filter(F.col("combi_fac").isin("SubalpineControl", "AlpineControl"))
    fit = principal_components(rows, v.TRAITS, components)
    above, below = v.TRAIT_KINDS
    scores = fit.scores(rows, ["combi_fac", "rep"])
    return Components(
        fit.loadings_table({t: above for t in v.ABOVE_GROUND}, below), scores,
        centroids(scores, ["combi_fac"], fit.names),
    )


def variance_partition(
    terms: DataFrame, labels: Mapping[str, str], levels: Sequence[str], at_least: float = 0.01
) -> DataFrame:
    """Share of each term with its mark, running position and label.

    ``terms`` is the result of the per-term test. Shares under ``at_least`` get
    no label.
    """
    named = terms.select(
        recode(F.col("term"), labels).alias("term"), "variance", "p_value"
    ).withColumn("mark", mark_or_blank(F.col("p_value")))
    placed = running_share(named.withColumnRenamed("variance", "value"), "term", levels, "value")
    marks = named.groupBy("term").agg(F.max("mark").alias("mark"))
    text = paste(F.col("term"), F.col("mark"), F.lit("\n"), percent_label(F.col("prop")), sep=" ")
    return placed.join(marks, "term", "left").select(
        "term", "level_order", "prop", "mark", "cumsum", "pos",
        F.when(F.col("prop") >= at_least, text).alias("label"),
    )


def contributions(loadings: DataFrame, variable: str, axes: Sequence[str]) -> DataFrame:
    """Percent of each axis's squared loadings that falls on each variable, sorted."""
    squared = longer(loadings, [variable], axes, "axis", "loading").withColumn(
        "squared", F.col("loading") ** 2
    )
    shares = partition_share(squared, ["axis"], "squared").select(
        variable, "axis", half_even(F.col("share") * 100, 2).alias("contribution")
    )
    return wider(shares, [variable], "axis", "contribution", axes).orderBy(variable)


def stress_model(derived: DataFrame) -> tuple[Redundancy, DataFrame]:
    """Traits explained by site conditions, warmed against control alpine plots."""
    rows = derived.filter(F.col("combi_fac").isin("AlpineWarmed", "AlpineControl"))
    return redundancy(rows, v.TRAITS, v.SITE_CONDITIONS), rows


def function_model(derived: DataFrame) -> tuple[Redundancy, DataFrame]:
    """Ecosystem functions explained by traits, climate change and their interactions."""
    terms = [*v.TRAITS, "ecc", *[f"{t}:ecc" for t in v.TRAITS]]
    rows = derived.filter(F.col("combi_fac").isin(v.TREATMENTS))
    rows = with_interactions(climate_change_indicator(rows), terms)
    return redundancy(rows, v.FUNCTIONS, terms), rows


def ordination_tables(
    fit: Redundancy, rows: DataFrame, group: str, key: Sequence[str] = ()
) -> Ordination:
    """Scores on the first two axes, group centroids and contributions."""
    sites = fit.site_scores(rows, [group, *key])
    species, biplot = fit.species_scores(), fit.biplot_scores()
    axes = [c for c in species.columns if c != "var"]
    return Ordination(
        sites, centroids(sites, [group], axes), species, biplot,
        contributions(species, "var", axes), contributions(biplot, "var", axes),
    )
