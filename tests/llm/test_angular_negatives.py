"""Hard negatives against all pairs, and bounds that hold."""

import numpy as np
import pytest

from trialframe.llm import angular_negatives as mine


def slow(rows, anchor, positives=5, negatives=3):
    usable = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        own = ([int(np.floor(256 * x)) for x in v], label)
        usable[i] = min(usable.get(i, own), own)
    out = []
    for a, (va, la) in usable.items():
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, (v, label) in usable.items() if i != a and len(v) == len(va))
        for p, pid, _ in [s for s in scored if s[2] == la][:positives]:
            inside = [(-s, i) for s, i, label in scored if label != la and 50 * -p <= 100 * -s <= 95 * -p]
            out += [(a, pid, k, i, -p, s) for k, (s, i) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, id string, cell int")


def result(df, **how):
    got = mine.mine(df, "id % 5 = 0", **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def clustered(rng, n, dim, spread):
    middle = rng.normal(size=(6, dim))
    v = (middle[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, dim))).astype(np.float32)
    return v * rng.uniform(0.2, 3, (n, 1)).astype(np.float32)


@pytest.mark.parametrize("spread", [0.15, 1.0])
def test_against_all_pairs(spark, spread):
    rng = np.random.default_rng(3)
    v = clustered(rng, 300, 8, spread)
    rows = [(i, [float(x) for x in v[i]], int(rng.integers(0, 3))) for i in range(300)]
    rows += [(1000 + i, rows[10][1], i % 3) for i in range(40)]  # copies tie
    rows += [(2000, [0.0] * 8, 1), (2005, [0.0] * 8, 1), (2001, None, 1), (2002, [1.0] * 8, None), (None, [1.0] * 8, 1),
             (2003, [float("nan")] + [1.0] * 7, 1), (2010, [float("inf")] + [1.0] * 7, 1), (2015, [None] + [1.0] * 7, 1),
             (3000, [1.0, 2.0, 3.0], 1), (3005, [1.0, 2.0, 2.5], 1), (3001, [0.9, 1.0, 2.5], 2), (3010, [5.0], 1), (4000, [], 1),
             (20, rows[20][1], rows[20][2]), (25, rows[30][1], rows[25][2])]
    want = slow(rows, lambda i: i % 5 == 0)
    assert len(want) > 300
    df = frame(spark, rows)
    assert result(df) == want
    assert result(df, block_rows=17, count=3, sample=20) == want


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 3)) * 8e5 + 1.5e6  # within the documented length
    rows = [(i, [float(np.float32(x)) for x in v[i]], i % 2) for i in range(60)]
    assert result(frame(spark, rows)) == slow(rows, lambda i: i % 5 == 0)


def test_empty(spark):
    df = frame(spark, [(1, [1.0, 2.0], 0), (5, [1.0, 2.0], 0)])
    assert result(df.limit(0)) == [] and result(df) == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    x = np.floor(256 * clustered(rng, 400, 16, 0.1)).astype(float)
    x[0] = 0
    refs = x[[5, 50, 100, 150]] / np.linalg.norm(x[[5, 50, 100, 150]], axis=1, keepdims=True)
    norm = np.linalg.norm(x, axis=1)
    angles = mine._unit_angles(x, norm, refs)
    block = mine._Block.__new__(mine._Block)
    block.x, block.norm, block.angles = x, norm, angles
    low, high = block.bounds(angles, norm)
    exact = x @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high < 0.5 * np.outer(norm, norm)).mean() > 0.2  # clusters far apart are told apart unscored
