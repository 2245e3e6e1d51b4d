"""Predicates and aggregates with explicit missing-value rules.

NULL is the only missing value past ingest; ``sources.readers`` turns NaN,
empty text and the text ``NA`` into NULL.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F


def in_set(c: Column, values: Iterable) -> Column:
    """Membership that is false, not NULL, for a missing value."""
    return F.coalesce(c.isin(list(values)), F.lit(False))


def not_in_set(c: Column, values: Iterable) -> Column:
    """Negated membership; rows with a missing value are kept."""
    return ~in_set(c, values)


def matches(c: Column, pattern: str) -> Column:
    """Regex search that is false for a missing value."""
    return F.coalesce(c.rlike(pattern), F.lit(False))


def present(c: Column) -> Column:
    """Neither missing nor blank text."""
    return c.isNotNull() & (c != "")


def if_else(test: Column, yes, no) -> Column:
    """Two-way choice where a missing test gives a missing result."""
    return F.when(test, yes).when(~test, no)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def _complete(c: Column) -> Column:
    return F.count(c) == F.count(F.lit(1))


def strict_mean(c: Column) -> Column:
    """Group mean, NULL as soon as one value of the group is missing."""
    return F.when(_complete(c), F.avg(c))


def strict_sum(c: Column) -> Column:
    """Group sum, NULL as soon as one value of the group is missing."""
    return F.when(_complete(c), F.sum(c))


def share_missing(c: Column, out_of: Column | float | None = None) -> Column:
    """Percent of rows where ``c`` is missing, out of the group's rows by default."""
    total = F.count(F.lit(1)) if out_of is None else F.lit(out_of)
    return F.try_divide(F.count_if(c.isNull()).cast("double"), total.cast("double")) * 100


def presence(c: Column) -> Column:
    """1 for a positive value, 0 for any other, NULL for a missing one."""
    return if_else(c > 0, 1, 0)
