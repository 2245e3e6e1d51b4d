"""Keys for joining texts a few edits apart, of a number that does not grow with the text.

A name of length l is cut into ``edits`` + 1 segments. ``edits`` insertions, deletions or
substitutions touch ``edits`` of them at most, so a text within that distance holds one
segment unchanged, moved by ``edits`` places at most (Li, Deng, Wang and Feng 2011).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and size of segment i; the last ones take what division leaves."""
    base = F.floor(length / parts)
    short = parts - length % parts
    return i * base + F.greatest(F.lit(0), F.lit(i) - short), base + F.when(F.lit(i) >= short, 1).otherwise(0)


def _key(c: Column, length: Column, i: int, start: Column, size: Column) -> Column:
    """A 64-bit hash, so that keys of long texts stay short; pairs are compared in full anyway."""
    return F.xxhash64(length.cast("int"), F.lit(i), F.substring(c, start.cast("int") + 1, size.cast("int")))


def segment_keys(c: Column, edits: int) -> Column:
    """The keys of a name: one for each of its segments."""
    length, parts = F.length(c), edits + 1
    return F.array(*[_key(c, length, i, *_segment(length, i, parts)) for i in range(parts)])


def probe_keys(c: Column, edits: int) -> Column:
    """The keys of a text: those of every name within ``edits`` edits are met by one of them."""
    own, parts, keys = F.length(c), edits + 1, []
    for more in range(-edits, edits + 1):
        length = own + more
        for i in range(parts):
            start, size = _segment(length, i, parts)
            for shift in range(-edits, edits + 1):
                fits = (length >= 0) & (start + shift >= 0) & (start + shift + size <= own)
                keys.append(F.when(fits, _key(c, length, i, start + shift, size)))
    return F.array_distinct(F.array_compact(F.array(*keys)))
