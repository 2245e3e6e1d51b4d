"""Leaf nutrients, taxon names and individual traits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.coding import recode, translate
from ..functions.edits import probe_keys, segment_keys
from ..functions.missing import in_set, matches, present
from ..functions.numeric import dry_matter_content, ratio, specific_leaf_area
from ..functions.rules import not_both
from ..functions.text import extract, paste, to_number
from ..operators.aggregates import group_means, group_share, missing_profile
from ..operators.joins import correct_by_dictionary, left_join
from ..operators.reshape import wider
from ..sources.scratch import stored
from . import vocabulary as v


def nutrient_table(raw: DataFrame) -> DataFrame:
    """``plot, n`` to ``combi_fac, rep, num_point, year, lnc``.

    A plot reads like ``LT03-17``: site and treatment code, replicate, individual.
    """
    plot = F.col("plot")
    return raw.select(
        translate(extract(plot, v.NUTRIENT_PLOT["group"]), v.TREATMENT_CODES).alias("combi_fac"),
        extract(plot, v.NUTRIENT_PLOT["rep"]).alias("rep"),
        to_number(extract(plot, v.NUTRIENT_PLOT["individual"])).alias("num_point"),
        F.lit(v.YEAR).alias("year"),
        (F.col("n") / 10).alias("lnc"),
    )


def closest_names(
    submitted: DataFrame, taxonomy: DataFrame, edits: int = 1
) -> DataFrame:
    """Resolve ``comments`` against the taxonomy's ``name, accepted``.

    Rows ``comments, species`` for every distinct submitted text: the accepted
    name of the same name, else of the closest one within ``edits`` edits (ties
    to the first in text order), else NULL. Case and outer blanks are ignored.

    Texts meet names by a segment they have in common, at nearly the same place and length, and
    are then compared within ``edits``. A text has a fixed number of keys, made in proportion
    to its length; only the comparison of a pair that meets takes Spark's own, longer time.
    The distinct texts are stored first: the measurements are scanned once.
    """
    def plain(c):
        return F.lower(F.trim(F.col(c)))

    texts = stored(submitted.select("comments").distinct(), "texts").withColumn(
        "__text", plain("comments")
    )
    names = (
        taxonomy.filter(present(F.col("name")))
        .groupBy(plain("name").alias("__name"))
        .agg(F.min("accepted").alias("accepted"))
    )
    exact = texts.join(names, texts["__text"] == names["__name"], "left")
    found = exact.filter(F.col("__name").isNotNull()).select("comments", "accepted")
    open_texts = exact.filter(F.col("__name").isNull()).select("comments", "__text")

    near = (
        open_texts.withColumn("__key", F.explode(probe_keys(F.col("__text"), edits)))
        .join(names.withColumn("__key", F.explode(segment_keys(F.col("__name"), edits))), "__key")
        .withColumn("__edits", F.levenshtein("__text", "__name", edits))
        .filter(F.col("__edits") >= 0)
        .groupBy("comments")
        .agg(F.min(F.struct("__edits", "__name", "accepted")).alias("__best"))
        .select("comments", F.col("__best.accepted").alias("accepted"))
    )
    rest = left_join(open_texts.select("comments"), near, ["comments"])
    return found.unionByName(rest).withColumnRenamed("accepted", "species")


def reconcile_names(
    submitted: DataFrame, taxonomy: DataFrame, edits: int = 1,
    overrides: Mapping[str, str] = v.NAME_OVERRIDES,
    rejected: Sequence[str] = v.REJECTED_NAMES,
) -> DataFrame:
    """Dictionary ``comments, species``: resolved, corrected by hand, bad and blank left out."""
    species = F.col("species")
    by_hand = translate(F.col("comments"), overrides)
    return (
        closest_names(submitted, taxonomy, edits)
        .withColumn(
            "species", F.coalesce(by_hand, F.when(~in_set(species, rejected), species))
        )
        .filter(present(species))
    )


def trait_table(measured: DataFrame, names: DataFrame, nutrients: DataFrame,
                merge: str | None = None) -> DataFrame:
    """Long trait measurements to one row per individual with derived traits.

    The pivot comes first, so names and keys are worked out once per individual.
    The name dictionary is stored: of known size, it is broadcast when small.
    """
    kept = measured.filter(F.col("code_trait") != v.UNUSED_TRAIT).drop("code_unite")
    ids = [c for c in kept.columns if c not in ("code_trait", "value")]
    wide = wider(kept, ids, "code_trait", "value", v.TRAIT_CODES, merge)
    named = correct_by_dictionary(
        wide, "comments", stored(names, "names"), "comments", "species"
    )
    plot, species = F.col("subplotmaincode"), F.col("species")
    site = paste(extract(plot, v.TRAIT_PLOT["site"]), extract(plot, v.TRAIT_PLOT["treatment"]))
    sla = specific_leaf_area(F.col("L_Area"), F.col("D_Mass"))
    individuals = named.select(
        "num_point", "year",
        recode(F.coalesce(species, F.col("lb_nom")), v.SYNONYMS).alias("species"),
        translate(site, v.TREATMENT_CODES).alias("combi_fac"),
        extract(plot, v.TRAIT_PLOT["rep"]).alias("rep"),
        F.col("H_Veg").alias("height"),
        sla.alias("sla"),
        ratio(F.lit(1.0), sla).alias("lma"),
        dry_matter_content(F.col("D_Mass"), F.col("F_Mass")).alias("ldmc"),
    )
    joined = left_join(individuals, nutrients, ["combi_fac", "rep", "num_point", "year"])
    return joined.filter(
        not_both(matches(species, v.MISPLACED["species"]), F.col("combi_fac") == v.MISPLACED["group"])
        & reduce(
            lambda a, b: a & b,
            [not_both(species == name, F.col(trait) > most) for name, trait, most in v.OUTLIERS],
        )
    )


def trait_means(traits: DataFrame, year: int = v.YEAR) -> DataFrame:
    """Mean traits per treatment, year and replicate, for one year."""
    kept = traits.filter((F.col("year") == year) & (F.col("species") != v.EXCLUDED_SPECIES))
    means = group_means(
        kept, ["combi_fac", "year", "rep"], ["ldmc", "sla", "lma", "height", "lnc"]
    )
    return means.withColumnRenamed("height", "vheight")


def trait_gaps(
    traits: DataFrame, year: int = v.YEAR, individuals: float | None = None
) -> DataFrame:
    """Percent missing per treatment and trait, out of ``individuals`` if given."""
    kept = traits.filter((F.col("year") == year) & F.col("combi_fac").isin(v.TREATMENTS))
    columns = ["height", "sla", "lma", "ldmc", "lnc"]
    return missing_profile(kept, ["combi_fac"], columns, individuals)


def growth_form_shares(species: DataFrame) -> DataFrame:
    """Whole percent of species per growth form."""
    return group_share(species, ["growth_form"])
