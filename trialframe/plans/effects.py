"""Effect-size tables: group means next to the contrasts they take part in."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.coding import as_level, first_match, level_order, recode
from ..functions.numeric import mark_or_ns
from ..operators.joins import left_join
from . import vocabulary as v


def annotate(df: DataFrame, variables: Sequence[tuple] = v.VARIABLES) -> DataFrame:
    """Add ``type, type_order, plant, es`` and replace ``var`` by its label.

    The dimension table is program text, which bounds the broadcast. An unlisted
    variable keeps its name and takes the default plant part and class.
    """
    dims = df.sparkSession.createDataFrame(
        list(variables), "var string, label string, type string, plant string, es string"
    )
    return df.join(F.broadcast(dims), "var", "left").select(
        F.coalesce("label", "var").alias("var"),
        *[c for c in df.columns if c != "var"],
        "type",
        level_order(F.col("type"), v.TYPE_LEVELS).alias("type_order"),
        F.coalesce("plant", F.lit(v.DEFAULT_PLANT)).alias("plant"),
        F.coalesce("es", F.lit(v.DEFAULT_CLASS)).alias("es"),
    )


def contrast_members(
    contrasts: DataFrame,
    groups: Mapping[str, tuple[str, str]] = v.CONTRAST_GROUPS,
    otherwise: tuple[str, str] = v.OTHER_CONTRAST_GROUPS,
) -> DataFrame:
    """Each contrast once per group it compares: magnitude and significance mark."""
    name = F.col("contrast")
    pair = [
        first_match([(name == c, F.lit(g[side])) for c, g in groups.items()],
                    F.lit(otherwise[side]))
        for side in (0, 1)
    ]
    return contrasts.select(
        "var", "contrast", F.abs("estimate").alias("magnitude"),
        mark_or_ns(F.col("adj_p_value")).alias("mark"),
        F.explode(F.array(*pair)).alias("grp"),
    )


def effect_table(
    means: DataFrame, contrasts: DataFrame, levels: Sequence[str] = v.TREATMENTS,
    groups: Mapping[str, tuple[str, str]] = v.CONTRAST_GROUPS,
    otherwise: tuple[str, str] = v.OTHER_CONTRAST_GROUPS,
) -> DataFrame:
    """Group means and intervals with every contrast the group takes part in."""
    joined = left_join(means, contrast_members(contrasts, groups, otherwise), ["var", "grp"])
    return joined.filter(F.col("grp").isin(list(levels))).withColumn(
        "grp_order", level_order(F.col("grp"), levels)
    )


def label_stress_conditions(effects: DataFrame) -> DataFrame:
    """Labels with units and their order; other variables become NULL."""
    labels = list(v.STRESS_LABELS.values())
    renamed = as_level(recode(F.col("var"), v.STRESS_LABELS), labels)
    return effects.withColumn("var", renamed).withColumn(
        "var_order", level_order(F.col("var"), labels)
    )


def segments(effects: DataFrame, contrast: str, groups: tuple[str, str]) -> DataFrame:
    """The rows that one arrow of a contrast connects."""
    return effects.filter(F.col("grp").isin(*groups) & (F.col("contrast") == contrast))
