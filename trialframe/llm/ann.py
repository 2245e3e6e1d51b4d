"""Nearest neighbours by inner product, over partitions that a classifier has learned.

On a bounded sample (``sample`` distinct vectors, least hash first) a graph joins each
vector to those with the largest inner products. The graph is cut into ``parts`` parts
of equal size, first by halving along its slowest mode and then by moves that lower
the cut within the size limit. A small network learns from a vector which parts its neighbours
lie in. It places every row of the index into its most probable part and sends each
query to its most probable ones, as many as reach ``coverage`` together, where
candidates are scored. Where vectors form groups that is a few parts; where they are
spread evenly it is most, since no partition tells neighbours from others there.

Rows of a part are dealt into blocks of about ``block_rows`` by a hash of their id,
and queries into blocks likewise, so a part with a third of all rows is many tasks'
work. Scores are double-precision sums of products, in one order of the components
for all rows, so equal vectors tie exactly; ties go to the smaller id. Candidates
that a faster product puts near the last place are all scored that way.

Vectors that are NULL, zero, or hold a NULL or non-finite component, and rows without
an id, take no part; nor do vectors of another length than the most frequent one. Rows that
repeat an id are one row, the least vector. Where a query has fewer candidates in its
parts than neighbours are asked for, it is scored against all rows.
"""

from __future__ import annotations



import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..sources.scratch import stored
from .arrow import append_columns

SAMPLE = 8192
PARTS = 64
#: Probability that a query's probed parts hold a neighbour, by the router's own estimate.
COVERAGE = 0.95
DEGREE = 16
HIDDEN = 128
BLOCK_ROWS = 8192
NEAREST = 20


def clean(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) rows that take part, each id once."""
    v = F.col(f"`{vector}`").cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    )
    length = usable.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return usable.where(F.size("v") == (length.n if length else 0)).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """For each row the rows with the largest inner products, itself left out."""
    n, k = len(x), min(degree, len(x) - 1)
    out = np.empty((n, k), np.int64)
    for at in range(0, n, 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(graph: np.ndarray, parts: int, slack: float = 0.1, rounds: int = 8) -> np.ndarray:
    """A part for each node, of equal size up to the slack, with few edges between parts."""
    n = len(graph)
    a = np.repeat(np.arange(n), graph.shape[1])
    b = graph.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    part = np.zeros(n, np.int64)
    rng = np.random.default_rng(7)
    width = 1
    while width < parts:
        # one power iteration for all current parts: edges between parts are left out
        own = part[a] == part[b]
        ea, eb = a[own], b[own]
        degree = np.maximum(np.bincount(ea, minlength=n), 1)
        size = np.maximum(np.bincount(part, minlength=width), 1)
        f = rng.standard_normal(n)
        for _ in range(60):
            f = 0.5 * f + 0.5 * np.bincount(ea, f[eb], minlength=n) / degree
            f -= (np.bincount(part, f, minlength=width) / size)[part]
            f /= np.sqrt(np.bincount(part, f * f, minlength=width) + 1e-30)[part]
        order = np.lexsort((f, part))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        begin = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=width))])[:-1]
        part = part * 2 + ((rank - begin[part]) * 2 >= np.bincount(part, minlength=width)[part])
        width *= 2
    limit = int(np.ceil(n / width * (1 + slack)))
    for _ in range(rounds):
        ties = np.bincount(a * width + part[b], minlength=n * width).reshape(n, width)
        target = ties.argmax(axis=1)
        gain = ties[np.arange(n), target] - ties[np.arange(n), part]
        size = np.bincount(part, minlength=width)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[target[i]] < limit:
                size[part[i]] -= 1
                size[target[i]] += 1
                part[i] = target[i]
                moved += 1
        if moved < n // 200:
            break
    return part


class Router:
    """One hidden layer from a vector, by its direction, to the probabilities of parts."""

    def __init__(self, w1, b1, w2, b2) -> None:
        self.w1, self.b1, self.w2, self.b2 = w1, b1, w2, b2

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) * np.sqrt(x.shape[1])
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def train_router(x: np.ndarray, target: np.ndarray, hidden: int = HIDDEN, epochs: int = 30) -> Router:
    """Cross entropy against each row's distribution over parts, by Adam in minibatches."""
    rng = np.random.default_rng(11)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) * np.sqrt(x.shape[1])
    d, p = x.shape[1], target.shape[1]
    w = [rng.standard_normal((d, hidden)) * np.sqrt(2 / d), np.zeros(hidden), rng.standard_normal((hidden, p)) * np.sqrt(1 / hidden), np.zeros(p)]
    m, v, step = [np.zeros_like(t) for t in w], [np.zeros_like(t) for t in w], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        rate = 3e-3 * (1 - epoch / epochs) + 1e-4
        for at in range(0, len(x), 256):
            i = order[at : at + 256]
            h = np.maximum(x[i] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            dz = (z / z.sum(axis=1, keepdims=True) - target[i]) / len(i)
            dh = (dz @ w[2].T) * (h > 0)
            step += 1
            for j, g in enumerate((x[i].T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0))):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                w[j] = w[j] - rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    return Router(*w)


def learn(rows: DataFrame, sample: int = SAMPLE, parts: int = PARTS, degree: int = DEGREE) -> Router | None:
    """Fit the router on a sample of distinct vectors; None where there are too few to cut."""
    chosen = rows.select(F.xxhash64("v").alias("h"), "v").groupBy("h").agg(F.min("v").alias("v")).orderBy("h").limit(sample)
    x = np.array([r.v for r in chosen.collect()])
    if len(x) < 4 * parts:
        return None
    x = x[np.lexsort(x.T)]
    graph = neighbour_graph(x, degree)
    part = balanced_parts(graph, parts)
    near = np.column_stack([np.arange(len(x)), graph])
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x))[:, None], part[near]), 1.0 / near.shape[1])
    return train_router(x, target)


def _top_parts(rows: DataFrame, router: Router | None, coverage: float, out: str) -> DataFrame:
    """Append the most probable parts, best first, until they reach the coverage."""

    def make():
        def work(vectors):
            x = np.array(vectors, float)
            if router is None or not len(x):
                return [[[0] for _ in vectors]]
            z = router.logits(x)
            z = np.exp(z - z.max(axis=1, keepdims=True))
            order = np.argsort(-z, axis=1, kind="stable")
            share = np.cumsum(np.take_along_axis(z, order, 1), axis=1) / z.sum(axis=1, keepdims=True)
            n = (share < coverage).sum(axis=1) + 1
            return [[row[:k] for row, k in zip(order.tolist(), n.tolist())]]

        return work

    return append_columns(rows, ["v"], [T.StructField(out, T.ArrayType(T.IntegerType()))], make)


_FOUND = "query_id long, vec_id long, score double"


def _score_block(queries: np.ndarray, qid: np.ndarray, index: np.ndarray, vid: np.ndarray, k: int) -> tuple:
    """The k best of one index block for each query of one query block."""
    out_q, out_v, out_s = [], [], []
    scale = np.linalg.norm(index, axis=1).max() if len(index) else 0.0
    for at in range(0, len(queries), 256):
        q = queries[at : at + 256]
        s = q @ index.T
        s[qid[at : at + 256, None] == vid[None, :]] = -np.inf
        if s.shape[1] > k:
            last = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            # rounding differs between ways to sum; whatever may reach the last place is scored again
            last = last - 1e-12 * scale * np.linalg.norm(q, axis=1)
        else:
            last = np.full(len(q), -np.inf)
        row, col = np.nonzero((s >= last[:, None]) & (s > -np.inf))
        for part in np.array_split(np.arange(len(row)), len(row) // 100_000 + 1):
            exact = (q[row[part]] * index[col[part]]).sum(axis=1)
            out_q.append(qid[at + row[part]])
            out_v.append(vid[col[part]])
            out_s.append(exact)
    a, b, c = (np.concatenate(x) if x else np.empty(0) for x in (out_q, out_v, out_s))
    order = np.lexsort((b, -c, a))
    a, b, c = a[order], b[order], c[order]
    first = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.empty(0, bool)
    place = np.arange(len(a)) - np.maximum.accumulate(np.where(first, np.arange(len(a)), 0)) if len(a) else np.empty(0, int)
    keep = place < k
    return a[keep], b[keep], c[keep]


def _join_blocks(index: DataFrame, queries: DataFrame, k: int, block_rows: int) -> DataFrame:
    """index (part, id, v) and queries (part, id, v): every query against all index rows of its part."""
    n_index = index.groupBy("part").agg(F.count("*").alias("rows"))
    n_query = queries.groupBy("part").agg(F.count("*").alias("asked"))
    blocks = n_index.join(n_query, "part").select(
        "part", F.ceil(F.col("rows") / block_rows).alias("ib"), F.ceil(F.col("asked") / block_rows).alias("qb")
    )
    blocks = stored(blocks, "blocks")
    own, other = F.pmod(F.xxhash64("id"), F.col("ib")), F.pmod(F.xxhash64("id"), F.col("qb"))
    left = index.join(blocks, "part").select("part", own.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("qb") - 1)).alias("q"), "id", "v")
    right = queries.join(blocks, "part").select("part", other.alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("ib") - 1)).alias("i"), "id", "v")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        else:
            x, y = (_matrix(t.column(c).combine_chunks()) for t, c in ((a, "v"), (b, "qv")))
            found = _score_block(y, np.asarray(b.column("qid")), x, np.asarray(a.column("id")), k)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    # both sides come from one table: new names keep their columns apart
    right = right.toDF("part", "q", "i", "qid", "qv")
    keys = ["part", "i", "q"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(
    vectors: DataFrame, is_query, k: int = NEAREST, key: str = "vec_id", vector: str = "embedding",
    sample: int = SAMPLE, parts: int = PARTS, coverage: float = COVERAGE, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row with ``is_query`` (a condition on id) its k best others."""
    rows = stored(clean(vectors, key, vector), "vectors")
    router = learn(rows, sample, parts)
    placed = stored(_top_parts(rows, router, coverage, "parts"), "placed")
    index = placed.select(F.col("parts")[0].alias("part"), "id", "v")
    asked = placed.where(is_query)
    queries = asked.select(F.explode("parts").alias("part"), "id", "v")
    found = stored(_join_blocks(index, queries, k, block_rows), "found")
    if router is not None:
        # too few candidates in its parts: all rows, for those queries
        full = found.groupBy("query_id").count().where(F.col("count") >= k)
        short = stored(asked.join(full, asked.id == full.query_id, "left_anti").select("id", "v"), "short")
        everything = placed.select(F.lit(0).alias("part"), "id", "v")
        rest = _join_blocks(everything, short.select(F.lit(0).alias("part"), "id", "v"), k, block_rows)
        found = found.join(short, found.query_id == short.id, "left_anti").unionByName(rest)
    return _best(found, k).select("query_id", "rank", "vec_id", "score")
