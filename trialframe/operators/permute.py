"""Seeded permutation tests of a redundancy analysis.

With orthonormal predictors z and centred responses y, every statistic of
permutation b follows from the cross products S_b = sum_i z_i y'_{b(i)}, plus
z against permuted z for the axis tests. Those are group sums, so permuted rows
are never collected; the tests then work on one row per permutation (Legendre,
Oksanen and ter Braak 2011).

Three designs, named by the caller and never chosen by the table's size:

* free: every row may swap with every other.
* within strata: rows swap with rows of the same value of a column (blocks of an
  experiment).
* normal: the sums are drawn from the normal distribution that free permutation tends
  to, with its exact mean and covariance. Cost free of the number of rows.

The first two cost (rows x permutations) products, but nothing is ordered in a permutation and
no row is moved: rows are numbered once, and the place of a row in permutation b is a keyed
bijection of its number, computed where it is needed (``placed``, ``_crossed``). So a stratum with
most of the rows is spread like any other. A task takes a bounded block of standing rows, a
bounded group of moved ones and a range of permutations; their cross products are added up.

Every draw follows from md5 of seed, permutation and round, so any engine can repeat it.
The sums, one row per permutation, are stored, and all tests read them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.scratch import stored
from .joins import left_join
from .ordination import Redundancy

# Rounds of the bijection, and the prime its round functions compute in.
_ROUNDS = 6
_PRIME = 2**31 - 1
# Ties with the observed statistic count, whatever the last digits say.
_TIE = 1 - 1e-9
# What a task of a permutation test holds at most: numbers of standing rows, and moved rows. It
# multiplies about so many rows in all its permutations together, so many at a time.
_HELD, _GROUP, _WORK, _PIECE = 2**24, 2**18, 2**28, 2**13


def row_key(key: Sequence[str]) -> Column:
    """Text that differs for different keys: each part with its length, NULL as ``N``."""
    parts = [F.col(k).cast("string") for k in key]
    return F.concat(*[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("N")) for c in parts])


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """Even partitions by ``key`` for work that is heavy per row.

    A fixed number, because run-time coalescing goes by bytes and would put
    little data with much work into one task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, key)


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``number``, 0 up to n - 1 in the order of the columns, which must identify a row.

    Rows are sorted once, over all tasks, and stored; what reaches the driver is the number of
    rows of each sorted part.
    """
    ordered = stored(rows.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("place", 33)
    sizes = {r.part: r.n for r in ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = 0, []
    for k in range(max(sizes, default=-1) + 1):
        offsets.append(before)
        before += sizes.get(k, 0)
    first = F.get(F.lit(offsets or [0]), part.cast("int"))
    return ordered.withColumn("number", first + F.col("place").bitwiseAND(2**33 - 1)).drop("place")


def _with_radices(sized: DataFrame) -> DataFrame:
    """Add ``wide`` and ``tall`` to rows with ``size``: the two radices that numbers are written in.

    Their product covers the size with the least excess among near-square choices.
    """
    low = F.ceil(F.sqrt("size")).cast("bigint")
    high = F.greatest(low, F.least(4 * low, F.expr("size div 2")))
    each = F.transform(F.sequence(low, high), lambda a: F.struct(
        (a * F.ceil(F.col("size") / a) - F.col("size")).alias("excess"), a.alias("wide")))
    best = sized.withColumn("best", F.array_min(each))
    return best.select(
        *sized.columns, F.col("best.wide").alias("wide"),
        F.ceil(F.col("size") / F.col("best.wide")).cast("bigint").alias("tall"))


def _key(b: int, seed: int) -> np.ndarray:
    """Coefficients of the round functions of permutation ``b`` (from 1): round, power."""
    texts = [hashlib.md5(f"{seed}-{b}-{r}".encode()).hexdigest() for r in range(_ROUNDS)]
    return np.array([[int(t[i : i + 8], 16) % _PRIME for i in range(0, 32, 8)] for t in texts], np.int64)


@lru_cache(maxsize=4)
def _keys(permutations: int, seed: int) -> np.ndarray:
    """Coefficients of all permutations; number 0 is none."""
    return np.stack([np.zeros((_ROUNDS, 4), np.int64), *[_key(b, seed) for b in range(1, permutations + 1)]])


def _polynomial(k, r, at):
    """Round function r with keys k; a Horner step stays under 2^62 + 2^31."""
    value = k[:, r, 3]
    for i in (2, 1, 0):
        value = (value * at + k[:, r, i]) % _PRIME
    return value


def _once(x, k, start, wide, tall):
    """Each number x under the permutation of two digits with keys k."""
    digits = [x // tall, x % tall]
    for r in range(_ROUNDS):
        own, other, radix = (0, 1, wide) if r % 2 == 0 else (1, 0, tall)
        digits[own] = (digits[own] + _polynomial(k, r, (digits[other] + start) % _PRIME)) % radix
    return digits[0] * tall + digits[1]


def _turns(k, start: int, wide: int, tall: int) -> list[np.ndarray]:
    """What each round of one stratum adds to a digit, for every value of the other digit."""
    radices = [(wide, tall), (tall, wide)]
    return [_polynomial(k, r, (np.arange(radices[r % 2][1]) + start) % _PRIME) % radices[r % 2][0] for r in range(_ROUNDS)]


def _turned(x, turns, wide: int, tall: int):
    """As ``_once`` for numbers of one stratum, with its turns looked up."""
    digits, radices = list(np.divmod(x, tall)), (wide, tall)
    for r, turn in enumerate(turns):
        own = digits[r % 2] + turn[digits[1 - r % 2]]
        digits[r % 2] = own - radices[r % 2] * (own >= radices[r % 2])
    return digits[0] * tall + digits[1]


def _moved(number, start, size, wide, tall, k):
    """Places of the numbers in the permutation with keys k (one, round, power); the design is sorted by start."""
    x = number - start
    if start[0] == start[-1]:
        w, t = int(wide[0]), int(tall[0])
        turns = _turns(k, int(start[0]), w, t)

        def mapped(x, at):
            return _turned(x, turns, w, t)
    else:
        def mapped(x, at):
            return _once(x, k, start[at], wide[at], tall[at])

    x = np.concatenate([mapped(x[i : i + _PIECE], slice(i, i + _PIECE)) for i in range(0, len(x), _PIECE)])
    while len(out := np.flatnonzero(x >= size)):
        x[out] = mapped(x[out], out)
    return x + start


def _crossed(z, first, y, design, k):
    """Sums of z y' over the moved rows y whose place in one permutation is among the standing rows z.

    The numbers of z run from ``first``; ``design`` has number, start, size, wide and tall of y.
    """
    at = _moved(*design, k) - first
    total = np.zeros((y.shape[1], z.shape[1]))
    for i in range(0, len(at), _PIECE):
        place, own = at[i : i + _PIECE], y[i : i + _PIECE]
        if first or place.max() >= len(z):
            near = (place >= 0) & (place < len(z))
            place, own = place[near], own[near]
        total += own.T @ np.take(z, place, axis=0)
    return total.T


def placed(rows: DataFrame, permutations: int, seed: int) -> DataFrame:
    """Add ``pos``, the place of a row's ``number`` in permutation ``b``.

    The row's number within its stratum is written as two digits, and each round adds to one
    digit a random polynomial of the other (a Feistel network over unequal radices, Black and
    Rogaway 2002), which permutes all numbers of two digits. A result outside the stratum is
    mapped again until it is inside. Arithmetic on whole columns in Arrow batches: as Spark
    expressions the rounds make a method too long for the JVM to compile.
    """

    @F.pandas_udf("bigint")
    def place(b: pd.Series, number: pd.Series, start: pd.Series, size: pd.Series, wide: pd.Series, tall: pd.Series) -> pd.Series:
        b, number, start, size, wide, tall = (c.to_numpy() for c in (b, number, start, size, wide, tall))
        keys = _keys(permutations, seed)
        x = _once(number - start, keys[b], start, wide, tall)
        while len(out := np.flatnonzero(x >= size)):
            x[out] = _once(x[out], keys[b[out]], start[out], wide[out], tall[out])
        return pd.Series(x + start)

    # never NULL, so that a join by it filters nothing and the function runs once
    at = F.coalesce(place("b", "number", "start", "size", "wide", "tall"), F.lit(-1).cast("bigint"))
    return rows.withColumn("pos", at)


def _sum_names(q: int, m: int, with_predictors: bool) -> list[str]:
    names = [f"s_{j}_{i}" for j in range(q) for i in range(m)]
    return names + [f"t_{j}_{k}" for j in range(q) for k in range(q)] if with_predictors else names


def permuted_sums(
    fit: Redundancy, df: DataFrame, key: Sequence[str], permutations: int, seed: int = 0,
    strata: str | None = None, with_predictors: bool = False,
) -> DataFrame:
    """One row per permutation ``b`` with its cross products ``s_j_m`` (and ``t_j_l``).

    ``key`` must identify a row, else it is an error. With ``strata`` rows swap within
    equal values of that column (NULL is one of them). No task holds more than a block of
    standing rows and a group of moved ones, however many rows there are. Where the rows are
    more than a block, places are computed once for each block.
    """
    q, m = len(fit.terms), len(fit.responses)
    z, y = [f"z{j}" for j in range(q)], [f"y{i}" for i in range(m)]
    keyed = df.withColumn("rid", row_key(key))
    keyed = keyed.withColumn("stratum", F.lit("") if strata is None else row_key([strata]))
    rows = numbered(fit.whitened(keyed, ["stratum", "rid"]), ["stratum", "rid"])
    if rows.select("rid").distinct().count() != fit.n:
        raise ValueError(f"{list(key)} does not identify a row")
    if strata is None:
        sized = df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("start"), F.lit(fit.n).cast("bigint").alias("size"))
        one = _with_radices(sized).first().asDict()
        rows = rows.withColumns({c: F.lit(v).cast("bigint") for c, v in one.items()})
    else:
        sized = rows.groupBy("stratum").agg(F.min("number").alias("start"), F.count(F.lit(1)).alias("size"))
        rows = left_join(rows, stored(_with_radices(sized), "strata"), ["stratum"])

    moved, n = y + (z if with_predictors else []), fit.n
    block = max(_HELD // q, 1)
    blocks, groups = math.ceil(n / block), math.ceil(n / _GROUP)
    least = math.ceil(2 * df.sparkSession.sparkContext.defaultParallelism / (blocks * groups))
    chunks = min(max(math.ceil(min(n, _GROUP) * permutations / _WORK), least), permutations)
    cells = blocks * groups * chunks  # one for each block, group and range of permutations

    def numbers(count):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    def doubles(names):
        return F.array(*[F.col(c).cast("double") for c in names]).alias("held")

    spread = _spread(rows, "number")
    stay = spread.withColumn("other", numbers(groups * chunks)).select(
        (F.expr(f"number div {block}") * (groups * chunks) + F.col("other")).cast("int").alias("cell"),
        F.lit(True).alias("stays"), F.array("number").alias("design"), doubles(z))
    swap = spread.withColumn("block", numbers(blocks)).withColumn("chunk", numbers(chunks)).select(
        ((F.col("block") * groups + F.expr(f"number div {_GROUP}")) * chunks + F.col("chunk")).cast("int").alias("cell"),
        F.lit(False).alias("stays"), F.array("number", "start", "size", "wide", "tall").alias("design"), doubles(moved))
    names = _sum_names(q, m, with_predictors)

    def summed(batches):
        """The sums of one cell."""
        held, y, design = None, [], []
        for batch in batches:
            if held is None:
                cell = batch.column("cell")[0].as_py()
                first = cell // (groups * chunks) * block
                held = np.empty((min(block, n - first), q))
            stays = batch.column("stays")
            still, moving = batch.filter(stays), batch.filter(pc.invert(stays))
            at = np.asarray(still.column("design").flatten()) - first
            held[at] = np.asarray(still.column("held").flatten()).reshape(-1, q)
            y.append(np.asarray(moving.column("held").flatten()).reshape(-1, len(moved)))
            design.append(np.asarray(moving.column("design").flatten()).reshape(-1, 5))
        if held is None:
            return
        y, design = np.concatenate(y), np.concatenate(design)
        order = np.argsort(design[:, 0])  # by number, so by stratum
        y, design = y[order], np.ascontiguousarray(design[order].T)
        chunk = cell % chunks
        draws = range(chunk * permutations // chunks + 1, (chunk + 1) * permutations // chunks + 1)
        sums = np.array([_crossed(held, first, y, design, _key(b, seed)[None]) for b in draws])
        parts = [sums[:, :, :m].reshape(len(draws), -1), sums[:, :, m:].reshape(len(draws), -1)]
        columns = [pa.array(c) for c in np.hstack(parts).T]
        yield pa.RecordBatch.from_arrays([pa.array(draws, pa.int32()), *columns], names=["b", *names])

    partial = stay.unionByName(swap).repartitionById(cells, F.col("cell")).mapInArrow(
        summed, "b int, " + ", ".join(f"{c} double" for c in names))
    return stored(partial.groupBy("b").agg(*[F.sum(c).alias(c) for c in names]), "sums")


def _normal(seed: int, j: int, i: int) -> Column:
    """A standard normal number for permutation ``b`` and cell (j, i), from md5 by Box and Muller."""
    text = F.md5(F.concat_ws("-", F.lit(f"{seed}-n"), F.col("b").cast("string"), F.lit(f"{j}-{i}")))

    def uniform(first):
        return (F.conv(F.substring(text, first, 12), 16, 10).cast("double") + 0.5) / float(16**12)

    return F.sqrt(-2 * F.ln(uniform(1))) * F.cos(2 * math.pi * uniform(13))


def _root(matrix: np.ndarray) -> np.ndarray:
    """Lower Cholesky factor; a column of zeros where nothing is left of the pivot."""
    left, out = matrix.astype(float).copy(), np.zeros_like(matrix, float)
    for k in range(len(left)):
        if left[k, k] > 1e-12 * max(matrix[k, k], 1e-300):
            out[k:, k] = left[k:, k] / math.sqrt(left[k, k])
            left[k:, k:] -= np.outer(out[k:, k], out[k:, k])
    return out


def normal_sums(fit: Redundancy, permutations: int, seed: int = 0, with_predictors: bool = False) -> DataFrame:
    """As ``permuted_sums``, drawn from the normal limit of free permutation.

    Under it the sums of a predictor have mean 0 and the covariance of the responses'
    cross products over n - 1, and predictors are independent of each other.
    """
    q, m = len(fit.terms), len(fit.responses)
    kept = len(fit.moments.columns) - m
    cross = fit.moments.cross[kept:, kept:]
    if with_predictors:
        cross = np.block([[cross, fit.z_y.T], [fit.z_y, np.eye(q)]])
    root = _root(cross / (fit.n - 1))
    drawn = fit.spark.range(1, permutations + 1).select(F.col("id").cast("int").alias("b")).select(
        "b", *[_normal(seed, j, i).alias(f"e_{j}_{i}") for j in range(q) for i in range(len(root))]
    )

    def cell(j, i):
        return sum((F.lit(float(root[i, k])) * F.col(f"e_{j}_{k}") for k in range(i + 1)), F.lit(0.0))

    cells = [cell(j, i) for j in range(q) for i in range(m)]
    if with_predictors:
        cells += [cell(j, m + k) for j in range(q) for k in range(q)]
    names = _sum_names(q, m, with_predictors)
    return stored(drawn.select("b", *[c.alias(n) for c, n in zip(cells, names)]), "sums")


def _p_value(hits: Column) -> Column:
    return (hits + 1) / (F.count(F.lit(1)) + 1)


def _result(df: DataFrame, fit: Redundancy, tested: list[tuple]) -> DataFrame:
    """Turn one row of p-values into a row per term, the residual last.

    A term of no rank has NULL in all but its df, which is 0.
    """
    inertia = fit.n - 1
    none = F.lit(None).cast("double")

    def cell(place, term, df_term, ss, f, p):
        def number(v):
            return none if v is None else F.lit(float(v))

        return F.struct(
            F.lit(place).alias("ord"), F.lit(term).alias("term"), F.lit(df_term).cast("long").alias("df"),
            number(None if ss is None else ss / inertia).alias("variance"), number(f).alias("statistic"),
            (none if p is None else p).alias("p_value"),
        )

    cells = [cell(i, *t) for i, t in enumerate(tested, 1)]
    cells.append(cell(len(tested) + 1, "Residual", fit.df_residual, fit.residual_ss, None, None))
    return df.select(F.inline(F.array(*cells)))


def _term_ss(fit: Redundancy) -> list[Column]:
    """Sum of squares of each kept predictor column."""
    return [
        sum((F.col(f"s_{j}_{i}") ** 2 for i in range(len(fit.responses))), F.lit(0.0))
        for j in range(len(fit.terms))
    ]


def overall_test(fit: Redundancy, sums: DataFrame) -> DataFrame:
    """Test of all terms together: rows ``Model`` and ``Residual``."""
    q, left = len(fit.terms), fit.df_residual
    explained = sum(_term_ss(fit), F.lit(0.0))
    f = (explained / q) / ((F.lit(fit.total_ss) - explained) / left)
    ss = float(fit.term_ss.sum())
    observed = (ss / q) / (fit.residual_ss / left)
    p = sums.agg(_p_value(F.count_if(f >= observed * _TIE)).alias("p"))
    return _result(p, fit, [("Model", q, ss, observed, F.col("p"))])


def terms_test(fit: Redundancy, sums: DataFrame) -> DataFrame:
    """Sequential test of each term, with its share ``prop`` of the total variance.

    A term of several columns is tested as one, with its rank as df. A term that earlier ones
    determine has df 0 and NULL for the rest.
    """
    left = fit.df_residual
    each = _term_ss(fit)
    error = (F.lit(fit.total_ss) - sum(each, F.lit(0.0))) / left
    mean_square = fit.residual_ss / left
    hits, rows = [], []
    for j, (term, own) in enumerate(fit.blocks):
        if not own:
            rows.append((term, 0, None, None, None))
            continue
        ss = float(fit.term_ss[list(own)].sum())
        f = ss / len(own) / mean_square
        permuted = sum((each[k] for k in own), F.lit(0.0)) / len(own) / error
        hits.append(_p_value(F.count_if(permuted >= f * _TIE)).alias(f"p{j}"))
        rows.append((term, len(own), ss, f, F.col(f"p{j}")))
    total = fit.total_ss / (fit.n - 1)
    return _result(sums.agg(*hits), fit, rows).withColumn("prop", F.col("variance") / F.lit(total))


def axes_test(fit: Redundancy, sums: DataFrame) -> DataFrame:
    """Test of each axis given the earlier ones.

    Residuals of the model with the earlier axes are permuted and made
    orthogonal to those axes again; the statistic is the largest remaining
    eigenvalue over the residual mean square. ``sums`` must carry predictors.
    """
    q, m, left = len(fit.terms), len(fit.responses), fit.df_residual
    axis_ss, _, directions = fit.axes
    base, total, count = fit.z_y, fit.total_ss, len(axis_ss)
    splits = []
    for i in range(count):
        whole = np.linalg.qr(np.hstack([directions[:, :i], np.eye(q)]))[0]
        splits.append((directions[:, :i], whole[:, i:q]))
    s_names = [f"s_{j}_{i}" for j in range(q) for i in range(m)]
    t_names = [f"t_{j}_{k}" for j in range(q) for k in range(q)]

    def statistics(batches):
        for batch in batches:
            s = batch[s_names].to_numpy().reshape(-1, q, m)
            t = batch[t_names].to_numpy().reshape(-1, q, q)
            out = pd.DataFrame({"b": batch["b"]})
            for i, (earlier, rest) in enumerate(splits):
                fitted = earlier.T @ base
                moved = s - t @ earlier @ fitted
                gone = ((earlier.T @ moved) ** 2).sum(axis=(1, 2))
                now = rest.T @ moved
                top = np.linalg.svd(now, compute_uv=False)[:, 0] ** 2
                error = total - (fitted**2).sum() - gone - (now**2).sum(axis=(1, 2))
                out[f"f{i}"] = top / (error / left)
            yield out

    schema = "b int, " + ", ".join(f"f{i} double" for i in range(count))
    per_draw = sums.mapInPandas(statistics, schema)
    observed = axis_ss / (fit.residual_ss / left)
    p = per_draw.agg(
        *[
            _p_value(F.count_if(F.col(f"f{i}") >= float(f) * _TIE)).alias(f"p{i}")
            for i, f in enumerate(observed)
        ]
    )
    return _result(
        p, fit,
        [(f"rda{i + 1}", 1, axis_ss[i], observed[i], F.col(f"p{i}")) for i in range(count)],
    )


def test_export(overall: DataFrame, axes: DataFrame, digits: int = 2) -> DataFrame:
    """The overall test and the axis tests as one table without residuals, rounded."""
    both = overall.select("term", "df", "variance", "statistic", "p_value").unionByName(
        axes.select("term", "df", "variance", "statistic", "p_value")
    ).where("term <> 'Residual'")
    return both.withColumns({c: F.bround(c, digits) for c in ("variance", "statistic", "p_value")})


test_export.__test__ = False  # a table of tests, not a test
