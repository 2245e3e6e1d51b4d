"""Key parsing and text conversion. None of these throws under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# First number inside a text: optional sign, digits with grouping commas, decimals.
_FIRST_NUMBER = r"-?(?:\d[\d,]*\.?\d*|\.\d+)"


def extract(c: Column, pattern: str) -> Column:
    """First match of ``pattern`` (look-behind allowed), NULL where none."""
    return F.regexp_substr(c, F.lit(pattern))


def characters(c: Column, first: int, last: int) -> Column:
    """Characters ``first`` to ``last``, both counted from 1 and included."""
    return F.substring(c, first, last - first + 1)


def paste(*cols: Column, sep: str = "") -> Column:
    """Join texts; a missing part shows as the text ``NA``."""
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("NA")) for c in cols])


def to_number(c: Column) -> Column:
    """Text as a number; text that is none, or reads NaN, becomes NULL."""
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def decimal_comma(c: Column) -> Column:
    """Number written with a decimal comma."""
    return to_number(F.replace(c, F.lit(","), F.lit(".")))


def parse_number(c: Column) -> Column:
    """First number found in a text, grouping commas dropped."""
    return to_number(F.replace(extract(c, _FIRST_NUMBER), F.lit(","), F.lit("")))


def replicate_code(n: Column, last: int = 10) -> Column:
    """Whole numbers 1..``last`` as two-character text, anything else NULL."""
    return F.when(
        n.between(1, last) & (n == F.floor(n)), F.lpad(n.cast("int").cast("string"), 2, "0")
    )


def parse_day(c: Column, pattern: str = "dd/MM/yyyy", width: int = 10) -> Column:
    """Date from the first ``width`` characters, NULL for an impossible date."""
    return F.try_to_date(F.substring(c, 1, width), pattern)
