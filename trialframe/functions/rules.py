"""Row rules built from several conditions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column

from .missing import in_set


def any_pairing(
    first: Column, second: Column, pairings: Sequence[tuple[Sequence[str], Sequence[str]]]
) -> Column:
    """Rows whose (first, second) codes fall into one of the allowed pairings.

    One predicate instead of a union of filtered copies, so one scan.
    """
    return reduce(
        lambda a, b: a | b,
        [in_set(first, firsts) & in_set(second, seconds) for firsts, seconds in pairings],
    )


def not_both(a: Column, b: Column) -> Column:
    """Keep rows unless both hold; rows where this cannot be told are dropped by a filter."""
    return ~(a & b)
