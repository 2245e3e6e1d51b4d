"""The toxicity machine: held-out rows, misspellings, and edges."""

import numpy as np
from pyspark.sql import functions as F

from trialframe.llm import toxicity as x
from trialframe.llm.catalog import QUERIES, table


def test_kernel_is_the_sum_over_common_subsequences():
    from itertools import combinations

    words = ["abcab", "aabcc", "bcaab"]
    space = x.Subsequences("abc")

    def slow(s, t):
        return sum(
            x.DECAY ** (i[2] - i[0] + 1 + j[2] - j[0] + 1)
            for i in combinations(range(len(s)), 3) for j in combinations(range(len(t)), 3)
            if all(s[a] == t[b] for a, b in zip(i, j))
        )

    norms = space.norms(words)
    assert np.allclose(norms, [np.sqrt(slow(w, w)) for w in words])
    code, weight = space.codes(space.letters(words))
    kept = sorted(set(code.ravel().tolist()) - {0})
    place = np.full(space.size**3, len(kept))
    place[kept] = np.arange(len(kept))
    got = x._kernels(space, words, place, x._vectors(space, words, place, len(kept)))
    assert np.allclose(got, [[slow(a, b) / np.sqrt(slow(a, a) * slow(b, b)) for b in words] for a in words], atol=1e-6)


def _corpus():
    rng = np.random.default_rng(1)
    syllables = ["ba", "lo", "min", "tek", "ru", "sha", "von", "di", "par", "es"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    texts, labels = [], []
    for i in range(400):
        words = [word() for _ in range(rng.integers(5, 60))]
        if i % 4 == 0:
            for insult in rng.choice(["grizzlob", "fnordling", "wuzzit"], 2):
                words.insert(rng.integers(len(words)), insult)
        texts.append(" ".join(words) + ".")
        labels.append(int(i % 4 == 0))
    return texts, labels


def test_learns_words_and_their_misspellings():
    texts, labels = _corpus()
    model = x.fit(texts[:300], labels[:300])
    scorer = model.scorer()
    p = model.probability(scorer.margins(texts[300:]))
    assert ((p >= 0.5) == np.array(labels[300:])).all()
    for text in ("ba lo GRIZZLOB!", "f.n.o.r.d.l.i.n.g", "es g r i z z l o b ru", "grizzlobb", "fnnordling", "you wuzz1t"):
        assert model.probability(scorer.margins([text]))[0] >= 0.5, text
    for text in ("", "12 345", "shatek vondi", "b l m"):
        assert model.probability(scorer.margins([text]))[0] < 0.5, text
    # the cache may be emptied in between without harm
    x_before = x._CACHE_WORDS
    try:
        x._CACHE_WORDS = 10
        assert np.array_equal(model.probability(model.scorer().margins(texts[300:])), p)
    finally:
        x._CACHE_WORDS = x_before


def test_tables_and_edges(spark):
    texts, labels = _corpus()
    rows = [(i, t) for i, t in enumerate(texts)] + [(5000, None), (5001, ""), (None, "ba wuzzit grizzlob"), (1, texts[1]), (5002, "lo " * 90000 + "wuzzit grizzlob")]
    docs = spark.createDataFrame([(*r, 0.5, "p") for r in rows], "doc_id long, text string, score double, predicted string")
    marks = spark.createDataFrame([(i, y, 1) for i, y in enumerate(labels)] + [(7, None, 1), (None, 1, 1), (8, 5, 0)], "doc_id long, toxic int, quality int")
    got = x.held_out_scores(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by_id = {r.doc_id: r.predicted for r in got}
    assert [by_id[i] for i in (5000, 5001, 5002, None)] == [0, 0, 1, 1]
    assert all(by_id[i] == y for i, y in enumerate(labels))
    kept = x.without_toxic(docs, marks)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if i is not None and not by_id[i])
    # nothing to learn from: all keep the prior
    assert x.without_toxic(docs, marks.limit(0)).count() == len(rows)
    assert x.held_out_scores(docs.limit(0), marks).count() == 0


def test_held_out_rows_of_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op6_toxicity"](spark, folder).join(table(spark, folder, "labels"), "doc_id")
    r = got.where("held_out").agg(
        F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("right"), F.count_if(F.expr("toxic = 0 and predicted = 1")).alias("wrong")).first()
    assert r.right >= 0.95 and r.wrong <= 1
