"""Neighbours over learned partitions: recall against brute force, exact scores, edges."""

import numpy as np
import pytest

from trialframe.llm import ann
from trialframe.llm.catalog import QUERIES, table

FOLDER = "/root/testdata/sf0.1"


def slow(ids, x, query, k=20):
    scores = x @ x[query]
    scores[ids == ids[query]] = -np.inf
    order = np.lexsort((ids, -scores))[:k]
    return [int(i) for i in ids[order] if True][: int((scores > -np.inf).sum())]


def test_recall_and_scores_on_the_table(spark):
    rows = table(spark, FOLDER, "embeddings").select("vec_id", "embedding").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float)
    place = {int(v): i for i, v in enumerate(ids)}
    got = QUERIES["op3_learned_partitions"](spark, FOLDER).toPandas()
    assert set(got.query_id) == {int(v) for v in ids if v % 20 == 0}
    hits = total = 0
    for q, found in got.groupby("query_id"):
        found = found.sort_values("rank")
        assert found["rank"].tolist() == list(range(1, 21)) and q not in set(found.vec_id)
        exact = [float((x[place[q]] * x[place[v]]).sum()) for v in found.vec_id]
        assert np.allclose(found.score, exact, rtol=0, atol=1e-15)
        assert [(-s, v) for s, v in zip(found.score, found.vec_id)] == sorted((-s, v) for s, v in zip(found.score, found.vec_id))
        truth = set(slow(ids, x, place[q]))
        hits += len(truth & set(found.vec_id))
        total += len(truth)
    assert hits / total >= 0.9


def test_parts_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((16, 24))
    x = np.repeat(centres, 64, axis=0) + 0.2 * rng.standard_normal((1024, 24))
    graph = ann.neighbour_graph(x, 8)
    part = ann.balanced_parts(graph, 16)
    sizes = np.bincount(part, minlength=16)
    assert sizes.max() <= 1024 / 16 * 1.2 and (part[graph] != part[:, None]).mean() < 0.3


@pytest.mark.parametrize("block_rows", [7, 8192])
def test_hot_vectors_tie_exactly_and_blocks_lose_nothing(spark, block_rows):
    rng = np.random.default_rng(4)
    same = rng.standard_normal(8)
    rows = [(i, (same if i % 3 == 0 else rng.standard_normal(8)).astype("float32").tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df, "id % 20 = 0", parts=1024, block_rows=block_rows).toPandas()
    ids, x = np.arange(300), np.array([v for _, v in rows], float)
    for q, found in got.groupby("query_id"):
        assert found.sort_values("rank").vec_id.tolist() == slow(ids, x, q)


def test_short_parts_fall_back_to_all_rows(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.standard_normal(4).tolist()) for i in range(90)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, "id % 10 = 0", parts=16, coverage=1e-9).groupBy("query_id").count().collect()
    assert [r["count"] for r in got] == [20] * 9


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (20, [2.0, 1.0]), (8, [])]
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "vec_id long, embedding array<float>, score double, part string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, "id % 20 = 0").collect())
    assert got == [(0, 1, 20, 2.0), (0, 2, 1, 0.5), (20, 1, 0, 2.0), (20, 2, 1, 1.5)]
    assert ann.nearest(df.limit(0), "id % 20 = 0").count() == 0
