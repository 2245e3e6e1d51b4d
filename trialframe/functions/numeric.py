"""Arithmetic that returns NULL where the result is undefined."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .missing import if_else


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def half_even(c: Column, digits: int = 0) -> Column:
    """Round halves to the even neighbour."""
    return F.bround(c, digits)


def percent_label(share: Column) -> Column:
    """Percent with two decimals, halves rounded to even."""
    return F.format_string("%.2f%%", F.bround(share * 100, 2))


def mark_or_ns(p: Column, alpha: float = 0.05) -> Column:
    """``ns`` or ``*``; a missing p-value stays missing."""
    return if_else(p >= alpha, F.lit("ns"), F.lit("*"))


def mark_or_blank(p: Column, alpha: float = 0.05) -> Column:
    """``*`` or blank; a missing p-value is blank."""
    return F.coalesce(if_else(p < alpha, F.lit("*"), F.lit("")), F.lit(""))


def specific_leaf_area(area: Column, dry_mass: Column) -> Column:
    """Area in cm2 and mass in mg to m2 per kg."""
    return ratio(area * F.lit(1e-4), dry_mass / F.lit(1e6))


def dry_matter_content(dry_mass: Column, fresh_mass: Column) -> Column:
    return ratio(dry_mass, fresh_mass * F.lit(1e-3))


def mass_loss(start: Column, end: Column) -> Column:
    """Share of the starting mass that was lost."""
    return ratio(start - end, start)


def total_decomposition(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Summed start mass minus the remaining share.

    The quotient binds before the difference, so this is not a fraction of the
    start mass. It is kept as the established definition of the variable;
    ``joint_mass_loss`` is the fraction.
    """
    start = start_a + start_b
    return start - ratio(end_a + end_b, start)


def joint_mass_loss(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    return mass_loss(start_a + start_b, end_a + end_b)
