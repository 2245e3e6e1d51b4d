"""Tail probabilities of t, F and equicoordinate multivariate t, plain numpy.

Only ever called on summary rows (one per variable or contrast).
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

# Steps of a continued fraction; its length grows with the root of the larger shape.
_MOST_STEPS = 20_000_000


def _stirling_rest(x: float) -> float:
    """What Stirling's formula leaves of log gamma, for x of 10 or more."""
    y = 1 / (x * x)
    return (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / x


def _log_gamma_ratio(a: float, b: float) -> float:
    """log(gamma(a + b) / gamma(a)) without the difference of two large numbers."""
    shift = 0.0
    while a < 10:  # gamma(a + 1) = a gamma(a)
        shift += math.log(a) - math.log(a + b)
        a += 1
    rest = _stirling_rest(a + b) - _stirling_rest(a)
    return shift + (a - 0.5) * math.log1p(b / a) + b * (math.log(a + b) - 1) + rest


def _beta_fraction(a: float, b: float, x: float, y: float) -> float:
    """Continued fraction of the incomplete beta, two steps in one, with y = 1 - x given.

    Taken in pairs the steps need ``a y - b x``, which keeps its digits where x is
    close to 1 and a is huge (DiDonato and Morris 1992).
    """
    tiny = 1e-300
    excess = a * y - b * x
    value, c, d = tiny, tiny, 0.0
    for n in range(_MOST_STEPS):
        step = a + 2 * n
        up = 1.0 if n == 0 else (a + n - 1) * (a + b + n - 1) * n * (b - n) * (x / (step - 1)) ** 2
        down = n + n * (b - n) * x / (step - 1 if n else 1) + (a + n) / (step + 1) * (excess + 1 + n * (1 + y))
        d = down + up * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = down + up / c
        c = c if abs(c) > tiny else tiny
        value *= c * d
        if abs(c * d - 1) < 1e-15:
            return value
    raise ArithmeticError(f"the incomplete beta did not converge for {a}, {b}, {x}")


def _beta_lower(a: float, b: float, log_x: float) -> float:
    """Regularised incomplete beta I_x(a, b), x given by its logarithm."""
    if log_x >= 0:
        return 1.0
    x, y = math.exp(log_x), -math.expm1(log_x)
    # the smaller shape's gamma alone, the larger one's in the ratio
    small, large = min(a, b), max(a, b)
    front = math.exp(
        _log_gamma_ratio(large, small) - math.lgamma(small) + a * log_x + b * math.log(y)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x, y)
    return 1 - front * _beta_fraction(b, a, y, x)


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    return _beta_lower(df / 2, 0.5, -math.log1p(t * t / df))


def f_upper(f: float, df1: float, df2: float) -> float:
    """P(F > f)."""
    if f <= 0:
        return 1.0
    return _beta_lower(df2 / 2, df1 / 2, -math.log1p(df1 * f / df2))


def _solve_decreasing(tail, target: float, start: float) -> float:
    low, high = 0.0, start
    while tail(high) > target:
        low, high = high, high * 2
    for _ in range(2000):  # more than the halvings from any number to the next one
        mid = (low + high) / 2
        if mid in (low, high):
            return mid
        low, high = (mid, high) if tail(mid) > target else (low, mid)
    raise ArithmeticError(f"no number has the tail {target}")


def t_critical(df: float, level: float = 0.95) -> float:
    """c with P(|T| < c) = level."""
    start = NormalDist().inv_cdf(0.5 + level / 2)
    return _solve_decreasing(lambda c: t_two_sided(c, df), 1 - level, start)


_PRIMES = [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71]
# The normal distribution function on a grid; between its points a straight line is off by 3e-8 at most.
_GRID = np.linspace(-9, 9, 18 * 1024 + 1)
_NORMAL = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in _GRID])


def _pivoted_root(corr: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Rows of L with L L' = corr, each with the place of its last entry, in the order of these.

    Statistics that earlier ones determine share a place with one of them.
    """
    left, rows, done = corr.copy(), np.zeros((len(corr), 0)), []
    while (free := np.clip(np.diag(left), 0, None)).max() > 1e-10:
        k = int(np.argmax(free))
        column = left[:, k] / math.sqrt(left[k, k])
        rows, left = np.column_stack([rows, column]), left - np.outer(column, column)
        done.append(k)
    last = [int(np.flatnonzero(np.abs(r) > 1e-7).max()) for r in rows]
    return sorted(((m, r) for m, r in zip(last, rows)), key=lambda x: x[0])


class SimultaneousT:
    """Largest of several correlated |t| statistics.

    With one or two independent statistics, T = r * L u with u uniform on the circle; along
    a direction u the square |T_i| < c is left at r = c / max|L u|, and r^2 / rank follows
    F(rank, df), so a smooth sum over directions is left. With more, variables are
    separated (Genz and Bretz 2002): given the scale and the earlier ones, each variable is
    drawn from its normal distribution within the cube, and the share of it there multiplies
    up. The mean is taken over randomly shifted low-discrepancy sequences, which grow until the
    spread of their means puts the error under ``precision``; where ``most`` points each do not
    reach it, it is an error. ``error`` is the bound of the last tail.
    """

    _SHIFTS, _ERRORS = 12, 3.5

    def __init__(self, corr, df: float, seed: int = 0, precision: float = 1e-4, most: int = 1 << 18):
        corr = np.asarray(corr, dtype=float)
        values, vectors = np.linalg.eigh(corr)
        keep = values > 1e-10 * values.max()
        self.rank, self.df = int(keep.sum()), float(df)
        self.seed, self.precision, self.most, self.points, self.error = seed, precision, most, 1 << 11, 0.0
        if self.rank <= 2:
            # |T| is symmetric, so half a turn of the plane covers every case
            angle = (np.arange(40_000) + 0.5) * math.pi / 40_000
            around = np.ones((1, 1)) if self.rank == 1 else np.column_stack([np.cos(angle), np.sin(angle)])
            reach = np.abs(around @ (vectors[:, keep] * np.sqrt(values[keep])).T).max(axis=1)
            self.inverse_square = 1.0 / np.maximum(reach, 1e-300) ** 2
            return
        if self.rank >= len(_PRIMES):
            raise ValueError(f"more than {len(_PRIMES) - 1} independent statistics")
        self.rows = _pivoted_root(corr)
        # inverse of the distribution of the scale, s^2 being chi-square over its degrees
        s = np.linspace(0, 1 + 12 / math.sqrt(self.df), 40_001)[1:]
        density = (self.df - 1) * np.log(s) - self.df * s * s / 2
        mass = np.cumsum(np.exp(density - density.max()))
        self.scale = s + (s[1] - s[0]) / 2, mass / mass[-1]  # a cell reaches half a step beyond its point

    def _outside(self, c: float, points: int) -> np.ndarray:
        """The tail by each shifted sequence."""
        steps = np.sqrt(np.array(_PRIMES[: self.rank + 1]))
        shifts = np.random.default_rng(self.seed).uniform(size=(self._SHIFTS, self.rank + 1))
        out = []
        for shift in shifts:
            x = np.abs(2 * ((np.arange(1, points + 1)[:, None] * steps + shift) % 1) - 1)
            bound = c * np.interp(x[:, self.rank], self.scale[1], self.scale[0])
            y, inside = np.zeros((points, self.rank)), np.ones(points)
            for k in range(self.rank):
                low, high = np.full(points, -np.inf), np.full(points, np.inf)
                for last, row in self.rows:
                    if last == k:
                        middle = y[:, :k] @ row[:k]
                        ends = (-bound - middle) / row[k], (bound - middle) / row[k]
                        low, high = np.maximum(low, np.minimum(*ends)), np.minimum(high, np.maximum(*ends))
                a, b = np.interp(low, _GRID, _NORMAL), np.interp(high, _GRID, _NORMAL)
                share = np.maximum(b - a, 0)
                inside *= share
                y[:, k] = np.interp(a + x[:, k] * share, _NORMAL, _GRID)
            out.append(1 - inside.mean())
        return np.array(out)

    def upper(self, c: float) -> float:
        """P(max |T_i| > |c|)."""
        if c == 0:
            return 1.0
        if self.rank == 1:
            return t_two_sided(math.sqrt(c * c * self.inverse_square[0]), self.df)
        if self.rank == 2:
            return float(np.exp(-self.df / 2 * np.log1p(c * c * self.inverse_square / self.df)).mean())
        while True:
            means = self._outside(abs(c), self.points)
            self.error = self._ERRORS * float(means.std(ddof=1)) / math.sqrt(self._SHIFTS)
            if self.error <= self.precision:
                return float(means.mean())
            if self.points * 2 > self.most:
                raise ArithmeticError(f"the joint tail at {c} is known to {self.error:.1e} only, not {self.precision:.1e}")
            self.points *= 2

    def critical(self, level: float = 0.95) -> float:
        """c with P(max |T_i| > c) = 1 - level."""
        low, high = 0.0, t_critical(self.df, level)
        if self.rank <= 2:
            return _solve_decreasing(self.upper, 1 - level, high)
        self.upper(high)  # settles the number of points, so that the tail falls steadily in c
        over, under = level, self.upper(high) - (1 - level)
        while under > 0:
            low, high, over = high, high * 2, under
            under = self.upper(high) - (1 - level)
        # false position; the end that stays counts half (Illinois)
        while high - low > 1e-9 * high:
            mid = low + (high - low) * over / (over - under)
            now = self.upper(mid) - (1 - level)
            if abs(now) < self.precision / 1000:
                return mid
            if now > 0:
                low, over, under = mid, now, under / 2
            else:
                high, under, over = mid, now, over / 2
        return (low + high) / 2
