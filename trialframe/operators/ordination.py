"""Principal components, parallel analysis and redundancy analysis.

Fitting brings a matrix the size of the variable list to the driver; scoring
goes back to the rows as a projection with literal coefficients.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .crossproducts import Moments, complete_rows, moments


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(
        [tuple(v.item() if isinstance(v, np.generic) else v for v in r) for r in rows], schema
    )


def _projection(
    columns: Sequence[str], mean: np.ndarray, weights: np.ndarray, names: Sequence[str]
) -> dict[str, Column]:
    """Columns (x - mean) . weights, one per weight column."""
    out = {}
    for a, name in enumerate(names):
        total = F.lit(0.0)
        for c, m, w in zip(columns, mean, weights[:, a]):
            total = total + (F.col(c) - F.lit(float(m))) * F.lit(float(w))
        out[name] = total
    return out


def _positive_columns(m: np.ndarray) -> np.ndarray:
    """Signs that make each column's sum positive."""
    signs = np.sign(m.sum(axis=0))
    return np.where(signs == 0, 1.0, signs)


def varimax(loadings: np.ndarray, tolerance: float = 1e-10, rounds: int = 1000) -> np.ndarray:
    """Varimax rotation with row normalisation (Kaiser 1958); returns the rotated loadings.

    Columns are turned in pairs, each by the angle that is best for the pair, until no angle is
    left. Two columns take one turn.
    """
    p, k = loadings.shape
    height = np.sqrt((loadings**2).sum(axis=1))
    height = np.where(height > 0, height, 1.0)
    unit = loadings / height[:, None]
    for _ in range(rounds):
        largest = 0.0
        for i in range(k):
            for j in range(i + 1, k):
                x, y = unit[:, i], unit[:, j]
                u, w = x * x - y * y, 2 * x * y
                above = 2 * (u * w).sum() - 2 * u.sum() * w.sum() / p
                below = (u * u - w * w).sum() - (u.sum() ** 2 - w.sum() ** 2) / p
                angle = np.arctan2(above, below) / 4
                c, s = np.cos(angle), np.sin(angle)
                unit[:, i], unit[:, j] = x * c + y * s, y * c - x * s
                largest = max(largest, abs(angle))
        if largest <= tolerance:
            return unit * height[:, None]
    raise ArithmeticError(f"the rotation did not settle in {rounds} rounds")


@dataclass(frozen=True)
class PrincipalComponents:
    """Rotated components of a covariance matrix."""

    moments: Moments
    eigenvalues: np.ndarray  # all of them, descending
    loadings: np.ndarray  # rotated, one column per kept component
    weights: np.ndarray
    spark: SparkSession

    @property
    def names(self) -> list[str]:
        return [f"rc{a + 1}" for a in range(self.loadings.shape[1])]

    def loadings_table(self, kinds: Mapping[str, str] | None = None, other=None) -> DataFrame:
        """Rows ``variable, rc1, rc2, ..., type``."""
        rows = [
            (v, *self.loadings[i], (kinds or {}).get(v, other))
            for i, v in enumerate(self.moments.columns)
        ]
        columns = "".join(f"{n} double, " for n in self.names)
        return _table(self.spark, rows, f"variable string, {columns}type string")

    def scores(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Scores of every complete row next to its own key columns."""
        m = self.moments
        scored = _projection(m.columns, m.mean, self.weights, self.names)
        return complete_rows(df, m.columns).select(
            *keep, *[c.alias(n) for n, c in scored.items()]
        )


def principal_components(
    df: DataFrame, columns: Sequence[str], components: int = 2
) -> PrincipalComponents:
    """PCA on the covariance matrix, varimax rotated.

    Signs make each loading column sum positive; columns are ordered by their
    sum of squares. Scores use the regression weights S^-1 L.
    """
    m = moments(df, columns)
    values, vectors = np.linalg.eigh(m.covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    loadings = vectors[:, :components] * np.sqrt(np.clip(values[:components], 0, None))
    loadings = varimax(loadings * _positive_columns(loadings))
    loadings = loadings[:, np.argsort(-(loadings**2).sum(axis=0), kind="stable")]
    loadings = loadings * _positive_columns(loadings)
    weights = np.linalg.pinv(m.covariance, hermitian=True) @ loadings
    return PrincipalComponents(m, values, loadings, weights, df.sparkSession)


def common_factor_eigenvalues(corr: np.ndarray) -> np.ndarray:
    """Descending eigenvalues with squared multiple correlations on the diagonal.

    Works on one matrix or a stack of them.
    """
    inverse = np.linalg.pinv(corr, hermitian=True)
    unique = 1.0 / np.diagonal(inverse, axis1=-2, axis2=-1)
    reduced = corr - unique[..., None] * np.eye(corr.shape[-1])
    return np.linalg.eigvalsh(reduced)[..., ::-1]


def _random_correlations(rng: np.random.Generator, count: int, n: int, p: int) -> np.ndarray:
    """Correlation matrices of ``n`` iid normal rows, via Wishart draws (Bartlett).

    Draws p(p+1)/2 numbers per matrix instead of n * p, whatever n is.
    """
    a = np.zeros((count, p, p))
    rows, cols = np.tril_indices(p, -1)
    a[:, rows, cols] = rng.standard_normal((count, len(rows)))
    for i in range(p):
        a[:, i, i] = np.sqrt(rng.chisquare(n - 1 - i, count))
    w = a @ np.swapaxes(a, 1, 2)
    d = np.sqrt(np.diagonal(w, axis1=1, axis2=2))
    return w / (d[:, :, None] * d[:, None, :])


def parallel_analysis(
    df: DataFrame, columns: Sequence[str], iterations: int = 5000, seed: int = 0,
    percentile: float = 0.0, chunk: int = 250,
) -> DataFrame:
    """Horn's parallel analysis on common-factor eigenvalues.

    Rows ``component, observed, random, bias, adjusted, retained``. The random
    side is the mean over ``iterations`` simulated tables of the same shape, or
    their ``percentile`` when that is above 0. Components are retained up to the
    first whose adjusted eigenvalue is not positive.

    Each simulated chunk is one row of ``range``, seeded by its number, so the
    draw does not depend on how Spark spreads the chunks.
    """
    m = moments(df, columns)
    p, n = len(columns), m.n
    observed = common_factor_eigenvalues(m.correlation)

    def simulate(batches):
        for batch in batches:
            for start in batch["id"]:
                count = min(chunk, iterations - int(start))
                rng = np.random.default_rng([seed, int(start)])
                values = common_factor_eigenvalues(_random_correlations(rng, count, n, p))
                yield pd.DataFrame(
                    {"component": np.tile(np.arange(1, p + 1), count), "value": values.ravel()}
                )

    spark = df.sparkSession
    simulated = spark.range(0, iterations, chunk).mapInPandas(
        simulate, "component int, value double"
    )
    centre = F.percentile("value", percentile / 100) if percentile else F.avg("value")
    random = simulated.groupBy("component").agg(centre.alias("random"))
    table = _table(
        spark, [(i + 1, v) for i, v in enumerate(observed)], "component int, observed double"
    )
    joined = random.join(F.broadcast(table), "component")  # p rows
    adjusted = F.col("observed") - F.col("random")
    out = joined.select("component", "observed", "random", F.col("random").alias("bias"),
                        adjusted.alias("adjusted"))
    failed = out.filter(F.col("adjusted") <= 0).agg(F.min("component")).scalar()
    return out.withColumn("retained", F.coalesce(F.col("component") < failed, F.lit(True)))


@dataclass(frozen=True)
class Redundancy:
    """A fitted redundancy analysis: responses explained by predictors."""

    moments: Moments  # kept predictors first, then responses
    terms: tuple[str, ...]  # columns of the kept predictors
    aliased: tuple[str, ...]  # columns left out
    blocks: tuple[tuple[str, tuple[int, ...]], ...]  # each term, with the places of its kept columns
    responses: tuple[str, ...]
    whiten: np.ndarray  # z = (x - mean) . whiten has identity cross products
    z_y: np.ndarray  # cross products of z with the responses
    total_ss: float
    spark: SparkSession

    @property
    def n(self) -> int:
        return self.moments.n

    @property
    def df_residual(self) -> int:
        return self.n - len(self.terms) - 1

    @property
    def term_ss(self) -> np.ndarray:
        """Sequential sum of squares of each term."""
        return (self.z_y**2).sum(axis=1)

    @property
    def residual_ss(self) -> float:
        return max(self.total_ss - float(self.term_ss.sum()), 0.0)

    @property
    def axes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Axis sums of squares, response directions, and z directions."""
        u, s, vt = np.linalg.svd(self.z_y, full_matrices=False)
        rank = int((s > 1e-9 * s[0]).sum()) if s.size and s[0] > 0 else 0
        v = vt[:rank].T
        signs = _positive_columns(v)
        return s[:rank] ** 2, v * signs, u[:, :rank] * signs

    def terms_table(self) -> DataFrame:
        """Rows ``ord, term, df, aliased, n``: rank of each term given the earlier ones, complete rows.

        A term is aliased where no column of it is left, that is where earlier terms determine it.
        """
        rows = [(i, name, len(own), not own, self.n) for i, (name, own) in enumerate(self.blocks, 1)]
        return _table(self.spark, rows, "ord int, term string, df long, aliased boolean, n long")

    def axes_table(self) -> DataFrame:
        """Rows ``axis, eigenvalue, share_total, share_constrained``."""
        ss = self.axes[0]
        rows = [
            (f"rda{a + 1}", e / (self.n - 1), e / self.total_ss, e / ss.sum())
            for a, e in enumerate(ss)
        ]
        return _table(
            self.spark, rows,
            "axis string, eigenvalue double, share_total double, share_constrained double",
        )

    def r_squared(self) -> DataFrame:
        """One row: constrained and total inertia, R2 and Ezekiel's adjusted R2."""
        r2 = 1 - self.residual_ss / self.total_ss
        left = self.df_residual
        adjusted = 1 - (1 - r2) * (self.n - 1) / left if left > 0 else None
        inertia = [v / (self.n - 1) for v in (self.total_ss - self.residual_ss, self.total_ss)]
        return _table(
            self.spark, [(*inertia, r2, adjusted)],
            "constrained double, total double, r_squared double, adj_r_squared double",
        )

    def species_scores(self, choices: int = 2) -> DataFrame:
        """Response scores, axis direction times root eigenvalue (scaling 2, no constant)."""
        ss, v, _ = self.axes
        scores = (v * np.sqrt(ss / (self.n - 1)))[:, :choices]
        return self._scores(self.responses, scores)

    def biplot_scores(self, choices: int = 2) -> DataFrame:
        """Correlation of each predictor with the fitted axes."""
        q = len(self.terms)
        cross = self.moments.cross[:q, :q]
        scores = (cross @ self.whiten @ self.axes[2]) / np.sqrt(np.diag(cross))[:, None]
        return self._scores(self.terms, scores[:, :choices])

    def _scores(self, labels, scores) -> DataFrame:
        axes = "".join(f", rda{a + 1} double" for a in range(scores.shape[1]))
        return _table(
            self.spark, [(v, *row) for v, row in zip(labels, scores)], f"var string{axes}"
        )

    def site_scores(self, df: DataFrame, keep: Sequence[str], choices: int = 2) -> DataFrame:
        """Rows projected on the response directions, one root eigenvalue divided out.

        A distributed select: key columns stay with their row, nothing is joined.
        """
        ss, v, _ = self.axes
        q = len(self.terms)
        v = v[:, :choices] / np.sqrt(ss[:choices] / (self.n - 1))
        names = [f"rda{a + 1}" for a in range(v.shape[1])]
        scored = _projection(self.responses, self.moments.mean[q:], v, names)
        rows = complete_rows(df, self.moments.columns + self.aliased)
        return rows.select(*keep, *[c.alias(n) for n, c in scored.items()])

    def whitened(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Orthonormal predictors ``z0..`` and centred responses ``y0..`` of every complete row."""
        q = len(self.terms)
        mean = self.moments.mean
        z = _projection(self.terms, mean[:q], self.whiten, [f"z{j}" for j in range(q)])
        y = {f"y{i}": F.col(c) - F.lit(float(m))
             for i, (c, m) in enumerate(zip(self.responses, mean[q:]))}
        rows = complete_rows(df, self.moments.columns + self.aliased)
        return rows.select(*keep, *[c.alias(n) for n, c in {**z, **y}.items()])


def _cholesky_with_aliasing(gram: np.ndarray, tolerance: float = 1e-9):
    """Positions of independent columns, in order, and R with R'R their Gram matrix.

    Columns are scaled to length one before, so the tolerance is a share of a column's own
    variance that earlier ones leave over. A column that fails is passed over, and the later
    ones are reduced by the kept ones only.
    """
    size = np.sqrt(np.clip(np.diag(gram), 0, None))
    varies = size > 0
    unit = np.where(varies, size, 1.0)
    left = gram / np.outer(unit, unit)
    kept: list[int] = []
    rows: list[np.ndarray] = []
    for j in range(len(gram)):
        if not varies[j] or left[j, j] <= tolerance:
            continue
        row = left[j] / np.sqrt(left[j, j])
        row[:j] = 0.0
        left = left - np.outer(row, row)
        kept.append(j)
        rows.append(row * unit)
    return kept, np.array([row[kept] for row in rows]).reshape(len(kept), len(kept))


def with_interactions(df: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Add a product column for every term written ``a:b``."""
    products = {}
    for term in terms:
        if ":" in term:
            a, b = term.split(":")
            products[term] = F.col(a) * F.col(b)
    return df.withColumns(products)


def with_levels(df: DataFrame, factor: str, levels: Sequence[str]) -> tuple[DataFrame, tuple[str, list[str]]]:
    """Indicator columns of all levels but the first, and the term made of them.

    NULL stays NULL in each; a value that is no level is like the first.
    """
    names = {f"{factor}[{level}]": level for level in levels[1:]}
    marks = {name: (F.col(factor) == F.lit(level)).cast("double") for name, level in names.items()}
    return df.withColumns(marks), (factor, list(names))


def redundancy(
    df: DataFrame, responses: Sequence[str], terms: Sequence[str | tuple[str, Sequence[str]]]
) -> Redundancy:
    """Redundancy analysis of the responses on the terms, in the order given.

    A term is a column (see ``with_interactions``), or a name with its columns (see
    ``with_levels``), which enter and are tested together. A column that is a
    combination of earlier ones is left out and listed in ``aliased``.
    """
    named = [(t, [t]) if isinstance(t, str) else (t[0], list(t[1])) for t in terms]
    columns = [c for _, own in named for c in own]
    if len(set(columns)) < len(columns):
        raise ValueError("a column stands in two terms")
    m = moments(df, [*columns, *responses])
    q = len(columns)
    kept, r = _cholesky_with_aliasing(m.cross[:q, :q])
    if not kept:
        raise ValueError("no predictor varies")
    order = [*kept, *range(q, q + len(responses))]
    sub = Moments(tuple(m.columns[i] for i in order), m.n, m.mean[order],
                  m.cross[np.ix_(order, order)])
    whiten = np.linalg.inv(r)
    k = len(kept)
    place = {columns[i]: at for at, i in enumerate(kept)}
    return Redundancy(
        moments=sub,
        terms=sub.columns[:k],
        aliased=tuple(c for c in columns if c not in place),
        blocks=tuple((name, tuple(place[c] for c in own if c in place)) for name, own in named),
        responses=tuple(responses),
        whiten=whiten,
        z_y=whiten.T @ sub.cross[:k, k:],
        total_ss=float(np.trace(sub.cross[k:, k:])),
        spark=df.sparkSession,
    )
