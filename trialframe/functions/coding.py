"""Recoding of categories."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, functions as F

from .missing import in_set


def first_match(cases: Sequence[tuple[Column, object]], default=None) -> Column:
    """Value of the first true condition, else ``default`` (NULL unless given)."""
    out = None
    for test, value in cases:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out if default is None else out.otherwise(default)


def translate(c: Column, codes: Mapping[str, object]) -> Column:
    """Look each value up; unknown codes become NULL.

    A literal map, so an expensive ``c`` is worked out once and not once per code.
    """
    entries = [F.lit(x) for pair in codes.items() for x in pair]
    return F.create_map(*entries)[c]


def recode(c: Column, codes: Mapping[str, str]) -> Column:
    """Look each value up; unknown codes pass through unchanged."""
    return F.coalesce(translate(c, codes), c)


def level_order(c: Column, levels: Sequence[str]) -> Column:
    """1-based place of the value among ordered levels, NULL outside them."""
    return translate(c, {level: place for place, level in enumerate(levels, start=1)})


def as_level(c: Column, levels: Iterable[str]) -> Column:
    """The value itself when it is one of the levels, else NULL."""
    return F.when(in_set(c, levels), c)


def indicator(c: Column, zero_groups: Iterable[str]) -> Column:
    """0 for the named groups, 1 for every other one, a missing group included."""
    return F.when(in_set(c, zero_groups), F.lit(0.0)).otherwise(F.lit(1.0))
