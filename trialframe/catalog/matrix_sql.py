"""SQL for what the operators do with small matrices, as common table expressions for ``WITH RECURSIVE``.

A matrix is a list of lists in one row, indices from 1. Elimination and rotations are
recursive queries, one step a row.
"""

from __future__ import annotations

from collections.abc import Sequence

_TOLERANCE = 1e-9


def _each(n: int, body: str, var: str) -> str:
    return f"list_transform(range(1, {n + 1}), lambda {var}: {body})"


def moments(source: str, columns: Sequence[str], name: str = "mo") -> str:
    """``name(n, mean, c)``: complete rows of a table, their means and covariance matrix."""
    full = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    rows = ", ".join("[" + ", ".join(f"covar_samp({a}, {b})" for b in columns) + "]" for a in columns)
    means = ", ".join(f"avg({c})" for c in columns)
    return f"{name} AS (SELECT count(*) AS n, [{means}] AS mean, [{rows}] AS c FROM {source} WHERE {full})"


def eliminated(q: int, p: int, source: str = "mo", name: str = "el") -> str:
    """``name(n, mean, c, m, t)``: the first q of p variables made orthogonal one after the other.

    Row j of ``m`` holds the covariances of variable j, less its predecessors, with all that
    follow; row j of ``t`` its coefficients. A variable that its predecessors determine is passed over.
    """
    k = "(k + 1)"
    passed = f"m[{k}][{k}] <= {_TOLERANCE} * c[{k}][{k}]"

    def less(matrix, width):
        entry = f"{matrix}[i][j] - m[i][{k}] / m[{k}][{k}] * {matrix}[{k}][j]"
        row = _each(width, entry, "j")
        return _each(p if matrix == "m" else q, f"CASE WHEN i <= {k} OR {passed} THEN {matrix}[i] ELSE {row} END", "i")

    one = _each(q, _each(q, "(i = j)::DOUBLE", "j"), "i")
    return f"""{name}_steps AS (
      SELECT 0 AS k, n, mean, c, c AS m, {one} AS t FROM {source}
      UNION ALL SELECT k + 1, n, mean, c, {less("m", p)}, {less("t", q)} FROM {name}_steps WHERE k < {q}),
    {name} AS (SELECT n, mean, c, m, t FROM {name}_steps WHERE k = {q})"""


def fitted(q: int, p: int, source: str = "el", name: str = "fi") -> str:
    """``name(j, y, s)``: covariance of each orthonormal predictor j with response y (1..p - q); ``name_matrix(a)``."""
    m = p - q
    cell = f"list_sum({_each(q, f'CASE WHEN m[j][j] > {_TOLERANCE} * c[j][j] THEN m[j][{q} + x] * m[j][{q} + y] / m[j][j] ELSE 0 END', 'j')})"
    return f"""{name} AS (
      SELECT j, y, m[j][{q} + y] / sqrt(m[j][j]) AS s
      FROM {source}, range(1, {q + 1}) AS predictors(j), range(1, {m + 1}) AS responses(y)
      WHERE m[j][j] > {_TOLERANCE} * c[j][j]),
    {name}_matrix AS (SELECT {_each(m, _each(m, cell, 'y'), 'x')} AS a FROM {source})"""


def eigen(n: int, source: str, name: str = "ei", sweeps: int = 9) -> str:
    """``name(axis, value, v)``: eigenvalues, largest first, and vectors of the matrix ``a``, by Jacobi's rotations.

    Vectors are signed so that their components sum to a positive number.
    """
    pairs = [(i, j) for i in range(1, n + 1) for j in range(i + 1, n + 1)]
    if not pairs:
        return f"{name} AS (SELECT 1 AS axis, a[1][1] AS value, [1.0::DOUBLE] AS v FROM {source})"
    text = "[" + ", ".join(f"[{i}, {j}]" for i, j in pairs) + "]"
    turned = "CASE WHEN {0} = pq[1] THEN co * {1}[pq[1]] - si * {1}[pq[2]] WHEN {0} = pq[2] THEN si * {1}[pq[1]] + co * {1}[pq[2]] ELSE {1}[{0}] END"
    right = _each(n, _each(n, turned.format("j", "{0}[i]"), "j"), "i")
    # rows of J' B: row p is c B_p - s B_q
    rows = _each(n, _each(n, "CASE WHEN i = pq[1] THEN co * b[pq[1]][j] - si * b[pq[2]][j] WHEN i = pq[2] THEN si * b[pq[1]][j] + co * b[pq[2]][j] ELSE b[i][j] END", "j"), "i")
    return f"""{name}_steps AS (
      SELECT 0 AS s, a, {_each(n, _each(n, "(i = j)::DOUBLE", "j"), "i")} AS v FROM {source}
      UNION ALL
      SELECT s + 1, {rows}, w FROM (
        SELECT s, pq, co, si, {right.replace("{0}", "a")} AS b, {right.replace("{0}", "v")} AS w FROM (
          SELECT *, tn / sqrt(tn * tn + 1) AS si, 1 / sqrt(tn * tn + 1) AS co FROM (
            SELECT *, CASE WHEN a[pq[1]][pq[2]] = 0 THEN 0.0::DOUBLE
                           ELSE (CASE WHEN th < 0 THEN -1 ELSE 1 END) / (abs(th) + sqrt(th * th + 1)) END AS tn
            FROM (SELECT s, a, v, pq, (a[pq[2]][pq[2]] - a[pq[1]][pq[1]]) / (2 * a[pq[1]][pq[2]]) AS th
                  FROM (SELECT s, a, v, {text}[s % {len(pairs)} + 1] AS pq FROM {name}_steps WHERE s < {sweeps * len(pairs)})))))),
    {name}_raw AS (SELECT (a[i])[i] AS value, {_each(n, "(v[r])[i]", "r")} AS v
                   FROM {name}_steps, range(1, {n + 1}) AS axes(i) WHERE s = {sweeps * len(pairs)}),
    {name} AS (SELECT CAST(row_number() OVER (ORDER BY value DESC) AS INTEGER) AS axis, value,
                      list_transform(v, lambda e: e * CASE WHEN list_sum(v) < 0 THEN -1 ELSE 1 END) AS v FROM {name}_raw)"""


def two_components(source: str, columns: Sequence[str]) -> str:
    """``rc(i, l1, l2, w1, w2)``: loadings and score weights of the first two components of the
    covariance matrix, turned by the varimax angle of the plane, signed and in order of their squares."""
    p = len(columns)
    return f"""{moments(source, columns)},
    cov AS (SELECT c AS a FROM mo),
    {eigen(p, "cov")},
    two AS (SELECT any_value(v) FILTER (axis = 1) AS v1, any_value(v) FILTER (axis = 2) AS v2,
                   any_value(value) FILTER (axis = 1) AS e1, any_value(value) FILTER (axis = 2) AS e2 FROM ei),
    plain AS (SELECT i, v1[i] * sqrt(e1) AS x, v2[i] * sqrt(e2) AS y FROM two, range(1, {p + 1}) AS variables(i)),
    unit AS (SELECT x / sqrt(x * x + y * y) AS x, y / sqrt(x * x + y * y) AS y FROM plain),
    uw AS (SELECT x * x - y * y AS u, 2 * x * y AS w FROM unit),
    angle AS (SELECT atan2(2 * sum(u * w) - 2 * sum(u) * sum(w) / {p},
                           sum(u * u - w * w) - (sum(u) * sum(u) - sum(w) * sum(w)) / {p}) / 4 AS f FROM uw),
    turned AS (SELECT i, x * cos(f) + y * sin(f) AS x, y * cos(f) - x * sin(f) AS y,
                      v1[i] / sqrt(e1) * cos(f) + v2[i] / sqrt(e2) * sin(f) AS wx,
                      v2[i] / sqrt(e2) * cos(f) - v1[i] / sqrt(e1) * sin(f) AS wy FROM plain, two, angle),
    signs AS (SELECT sign(sum(x)) AS sx, sign(sum(y)) AS sy, sum(x * x) >= sum(y * y) AS keep FROM turned),
    rc AS (SELECT i, CASE WHEN keep THEN sx * x ELSE sy * y END AS l1, CASE WHEN keep THEN sy * y ELSE sx * x END AS l2,
                  CASE WHEN keep THEN sx * wx ELSE sy * wy END AS w1, CASE WHEN keep THEN sy * wy ELSE sx * wx END AS w2
           FROM turned, signs)"""


def places(source: str, permutations: int, seed: int, moved: Sequence[str], rounds: int = 6, walks: int = 3) -> str:
    """``swap(b, pos, ...)``: the ``moved`` columns of each row at its place in each permutation; ``stay(pos, ...)``.

    ``source`` has ``st`` (stratum) and ``rid`` (row). Numbers are written in two digits, to
    which random polynomials of each other are added; results outside a stratum are mapped again.
    """
    prime = 2**31 - 1
    cells = ", ".join(
        f"('0x' || substr(md5('{seed}-' || b || '-{r}'), {8 * i + 1}, 8))::BIGINT % {prime} AS k_{r}_{i}"
        for r in range(rounds) for i in range(4))
    keys = ", ".join(f"k_{r}_{i}" for r in range(rounds) for i in range(4))
    held = ", ".join(["b", "num", "start", "size", "wide", "tall", *moved])
    out = f"""numbered AS (SELECT *, row_number() OVER (ORDER BY st, rid) - 1 AS num FROM {source}),
    sized AS (SELECT st, min(num) AS start, count(*) AS size FROM numbered GROUP BY st),
    bounds AS (SELECT *, CAST(ceil(sqrt(size)) AS BIGINT) AS low FROM sized),
    choices AS (SELECT st, start, size, unnest(range(low, greatest(low, least(4 * low, size // 2)) + 1)) AS wide FROM bounds),
    radices AS (SELECT *, CAST(ceil(size / wide) AS BIGINT) AS tall FROM choices
                QUALIFY row_number() OVER (PARTITION BY st ORDER BY wide * CAST(ceil(size / wide) AS BIGINT), wide) = 1),
    known AS (SELECT numbered.*, start, size, wide, tall FROM numbered JOIN radices USING (st)),
    coefficients AS (SELECT b, {cells} FROM range(1, {permutations + 1}) AS numbers(b)),
    f0 AS (SELECT {held}, {keys}, num - start AS pos FROM known, coefficients)"""
    last = "f0"
    for w in range(walks + 1):
        out += f",\n    f{w}_0 AS (SELECT {held}, {keys}, pos, pos // tall AS major, pos % tall AS minor FROM {last})"
        for r in range(rounds):
            by, radix = ("minor", "wide") if r % 2 == 0 else ("major", "tall")
            at, value = f"(({by} + start) % {prime})", f"k_{r}_3"
            for i in (2, 1, 0):
                value = f"(({value} * {at} + k_{r}_{i}) % {prime})"
            new = [f"(major + {value}) % {radix} AS major, minor", f"major, (minor + {value}) % {radix} AS minor"][r % 2]
            out += f",\n    f{w}_{r + 1} AS (SELECT {held}, {keys}, pos, {new} FROM f{w}_{r})"
        keep = "major * tall + minor" if w == 0 else "CASE WHEN pos < size THEN pos ELSE major * tall + minor END"
        last = f"g{w}"
        out += f",\n    {last} AS (SELECT {held}, {keys}, {keep} AS pos FROM f{w}_{rounds})"
    return f"""{out},
    swap AS (SELECT b, pos + start AS pos, {", ".join(moved)} FROM {last}),
    stay AS (SELECT num AS pos, * EXCLUDE (num) FROM numbered)"""
