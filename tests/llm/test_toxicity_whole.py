"""The toxicity machine where words are many."""

import numpy as np
from pyspark.sql import functions as F

from trialframe.llm import toxicity as x
from trialframe.llm.catalog import QUERIES, table


def test_held_out_rows_of_the_larger_tables(spark):
    folder = "/root/testdata/sf0.1"
    got = QUERIES["op6_toxicity"](spark, folder).join(table(spark, folder, "labels"), "doc_id").where("held_out")
    r = got.agg(
        F.count_if(F.expr("toxic = 1 and predicted = 0")).alias("missed"), F.count_if(F.expr("toxic = 1")).alias("toxic"),
        F.count_if(F.expr("toxic = 0 and predicted = 1")).alias("rejected"), F.count_if(F.expr("toxic = 0")).alias("clean")).first()
    print(r)
    assert r.missed <= 0.15 * r.toxic and r.rejected <= 0.03 * r.clean


def test_insults_of_many_scripts():
    """More letters than any fixed alphabet holds, and some beyond U+FFFF."""
    rng = np.random.default_rng(2)
    scripts = [(0x61, 26), (0xE0, 30), (0x3B1, 24), (0x430, 32), (0x627, 28), (0x915, 36), (0xE01, 44), (0x4E00, 500), (0x10A0, 38), (0x10400, 70)]
    word = lambda: "".join(chr(first + c) for first, n in [scripts[rng.integers(len(scripts))]] for c in rng.integers(0, n, rng.integers(4, 8)))
    insults = ["".join(chr(first + c) for c in rng.permutation(n)[:5]) for first, n in scripts for _ in range(3)]
    texts, labels = [], []
    for i in range(900):
        words = [word() for _ in range(20)] + ([insults[i % len(insults)]] if i % 3 == 0 else [])
        texts.append(" ".join(words) + ".")
        labels.append(int(i % 3 == 0))
    for i in range(900):
        texts.append(" ".join([word() for _ in range(20)] + [insults[i % len(insults)]]) + ".")
        labels.append(1)
    model = x.fit(texts, labels)
    p = model.probability(model.scorer().margins([f"{word()} {w} {word()}" for w in insults]))
    assert (p >= 0.5).all()
