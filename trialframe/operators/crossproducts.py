"""Means and centred cross products of numeric columns over complete rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Beyond so many columns the pairs are too many expressions for one aggregate.
_WIDE = 24


class Moments(NamedTuple):
    """Summary of ``n`` complete rows: a vector and a matrix the size of the column list."""

    columns: tuple[str, ...]
    n: int
    mean: np.ndarray
    cross: np.ndarray  # sum of (x_i - mean_i)(x_j - mean_j)

    @property
    def covariance(self) -> np.ndarray:
        return self.cross / (self.n - 1)

    @property
    def correlation(self) -> np.ndarray:
        d = np.sqrt(np.diag(self.cross))
        return self.cross / np.outer(d, d)


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where none of the columns is missing, so every pair uses the same rows."""
    held = [F.col(c).isNotNull() for c in columns]
    while len(held) > 1:  # joined in pairs, so that many columns make no deep expression
        held = [reduce(lambda a, b: a & b, held[i : i + 2]) for i in range(0, len(held), 2)]
    return df.filter(held[0])


def covariance_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows ``var_i, var_j, cov`` for every pair i <= j.

    Few columns: one aggregate, whose only shuffle carries one row per task. Many: the
    blocks of ``moments``.
    """
    if len(columns) > _WIDE:
        m = moments(df, columns)
        cells = [(a, b, float(m.covariance[i, j])) for i, a in enumerate(m.columns) for j, b in enumerate(m.columns) if i <= j]
        return df.sparkSession.createDataFrame(cells, "var_i string, var_j string, cov double")
    rows = complete_rows(df, columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    cells = [
        F.struct(
            F.lit(columns[i]).alias("var_i"),
            F.lit(columns[j]).alias("var_j"),
            F.covar_samp(columns[i], columns[j]).alias("cov"),
        ).alias(f"p{k}")
        for k, (i, j) in enumerate(pairs)
    ]
    return rows.agg(*cells).select(F.inline(F.array(*[f"p{k}" for k in range(len(pairs))])))


def _summed(rows: DataFrame, mean: np.ndarray | None) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, column sums, and cross products of the columns less ``mean`` (none without it).

    Each task packs its rows into matrices and hands on one line of sums per column; the lines of a
    column meet in one task, which adds them. So the driver gets one line a column.
    """
    p = len(rows.columns)
    width = 0 if mean is None else p

    def partial(batches):
        n, total, cross = 0, np.zeros(p), np.zeros((p, width))
        for batch in batches:
            x = np.column_stack([np.asarray(c) for c in batch.columns]) if batch.num_rows else np.zeros((0, p))
            if mean is not None:
                x = x - mean
                cross += x.T @ x
            n, total = n + len(x), total + x.sum(axis=0)
        yield lines(np.arange(p), np.full(p, n), total, cross)

    def lines(at, n, total, cross):
        ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * width)
        return pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(n), pa.array(total), pa.ListArray.from_arrays(ends, pa.array(cross.ravel()))],
            names=["at", "n", "total", "line"])

    def added(batches):
        held: dict[int, list] = {}
        for batch in batches:
            cross = np.asarray(batch.column(3).flatten()).reshape(batch.num_rows, width)
            for k, (at, n, total) in enumerate(zip(*(np.asarray(batch.column(c)) for c in range(3)))):
                if at in held:
                    held[at][0] += n
                    held[at][1] += total
                    held[at][2] += cross[k]
                else:
                    held[at] = [n, total, cross[k].copy()]
        if held:
            yield lines(np.array(list(held)), *(np.array([h[k] for h in held.values()]) for k in range(3)))

    schema = "at long, n long, total double, line array<double>"
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.mapInArrow(partial, schema).repartition(min(parts, p), "at").mapInArrow(added, schema)
    found = sorted(found.collect(), key=lambda r: r["at"])  # one line a column
    return found[0]["n"], np.array([r["total"] for r in found]), np.array([r["line"] for r in found]).reshape(p, width)


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Bring n, means and cross products to the driver: p + p(p+1)/2 numbers.

    Two passes, means first and then sums of centred products: each pair costs
    one plain sum, and centring keeps the digits that raw products would lose. Up to
    two dozen columns a pair is an expression; more are multiplied as matrices within tasks.
    """
    columns = list(columns)
    rows = complete_rows(df, columns).select(*[F.col(c).cast("double").alias(c) for c in columns])
    if len(columns) > _WIDE:
        n, total, _ = _summed(rows, None)
        if n < 2:
            raise ValueError("fewer than two complete rows")
        mean = total / n
        _, rest, cross = _summed(rows, mean)
        return Moments(tuple(columns), n, mean + rest / n, cross - np.outer(rest, rest) / n)
    first = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in columns]).first()
    n = first[0]
    if n < 2:
        raise ValueError("fewer than two complete rows")
    mean = np.array(first[1:], dtype=float)
    d = [F.col(c) - F.lit(float(m)) for c, m in zip(columns, mean)]
    upper = np.triu_indices(len(columns))
    sums = rows.agg(
        *[F.sum(d[i] * d[j]) for i, j in zip(*upper)], *[F.sum(x) for x in d]
    ).first()
    cross = np.zeros((len(columns), len(columns)))
    cross[upper] = sums[: len(upper[0])]
    cross = cross + np.triu(cross, 1).T
    # what rounding left of the mean
    rest = np.array(sums[len(upper[0]):], dtype=float)
    return Moments(tuple(columns), n, mean + rest / n, cross - np.outer(rest, rest) / n)
