"""Quality rules: counts against a plain count, the list against its expression, held-out labels."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialframe.llm import quality_rules as rules
from trialframe.llm.catalog import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    found = WORD.findall(text)
    windows = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines, seen, repeated = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return [len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), repeated, len(inside)]


TEXTS = [None, "", "  \n\t", "a", "a b", "a a a a", "a b c a b c", "x y z\nx y z\nx y z ", "été \U0001f600 <b>|</b>   z\x85w",
         "one\n\none\n one", "w " * 200, "# * $ % & | < >", " ".join(map(str, range(60)))]


def test_counts(spark):
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choices("abcde\n", k=40)) for _ in range(200)]
    for text in texts:
        assert rules.counts(text)[:5] == plain(text)
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, n_words string, rule int")
    out = rules.judged(df, rules.DecisionList((), True), ["doc_id"])
    assert out.columns == ["doc_id", *rules.BASE_COUNTS, "base_failed", "kept", "rule"]
    for r in out.collect():
        want = plain(texts[r.doc_id])
        assert list(r)[1:6] == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)
    assert rules.judged(df.limit(0), rules.DecisionList((), True), ["doc_id"]).count() == 0


def test_a_planted_rule_is_found():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(900, len(rules.STATISTICS)))
    names = list(rules.STATISTICS)
    a, b, c = names.index("upper_share"), names.index("words"), names.index("digit_share")
    good = ~(((x[:, a] > 0.7) & (x[:, b] <= 0.5)) | (x[:, c] > 0.95))
    found = rules.learn(x, good)
    fresh = rng.uniform(size=(4000, len(names)))
    want = ~(((fresh[:, a] > 0.7) & (fresh[:, b] <= 0.5)) | (fresh[:, c] > 0.95))
    assert (found.verdicts(fresh) == want).mean() > 0.97 and found.default
    assert {k.name for r in found.rules for k in r.conditions} == {"upper_share", "words", "digit_share"}
    noise = rules.learn(x, rng.uniform(size=900) < 0.8)
    assert len(noise.rules) <= 1  # nothing to learn
    assert rules.learn(x[:0], good[:0]) == rules.DecisionList((), True)
    assert rules.learn(x, np.ones(900, bool)) == rules.DecisionList((), True)
    assert rules.learn(x, np.zeros(900, bool)) == rules.DecisionList((), False)


@pytest.mark.parametrize("low, high, short", [(0.1234, 0.1301, 0.13), (3.0, 4.0, 3.0), (0.5, 0.5000001, 0.5), (7.0, 900.0, 454.0)])
def test_thresholds_are_short(low, high, short):
    t = rules.shortest_between(low, high)
    assert low <= t < high and len(repr(t)) <= max(len(repr(short)), 5)


def test_held_out_texts_and_expression(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    found = rules.fit_on(docs, labels)
    print(found)
    assert found.rules and found.default and all(len(r.conditions) <= rules.MAX_CONDITIONS for r in found.rules)
    out = rules.judged(docs, found, ["doc_id"]).where(rules.HELD_OUT).join(labels, "doc_id").where("NOT base_failed").toPandas()
    bad, good = out[out.quality == 0], out[out.quality == 1]
    assert len(bad) > 40 and (~bad.kept).mean() >= 0.95 and good.kept.mean() >= 0.99
    # the Spark expression says what the list says
    sample = docs.where("doc_id < 800")
    got = {r.doc_id: (r.kept, r.rule) for r in rules.judged(sample, found, ["doc_id"]).collect()}
    for r in sample.collect():
        count = dict(zip(rules.COUNTS, rules.counts(r.text)))
        x = np.array([[count[a] / (count[b] or 1) if b else float(count[a]) for a, b in rules.STATISTICS.values()]])
        x = np.where([b is not None and count[b] == 0 for _, b in rules.STATISTICS.values()], 0.0, x)
        failed = count["n_words"] < 50 or 100 * count["n_repeat_words"] > 50 * count["n_words"]
        first = next((k for k, rule in enumerate(found.rules, 1) if rule.holds(x)[0]), 0)
        assert got[r.doc_id] == ((False, None) if failed else (bool(found.verdicts(x)[0]), first))


def test_odd_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (3, None), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (3, None, 0), (9, 1, 0), (4, 5, 0)], "doc_id long, quality int, toxic int")
    assert rules.fit_on(docs, labels.limit(0)) == rules.DecisionList((), True)
    assert rules.fit_on(docs, labels, training="true") == rules.DecisionList((), False)  # one text, labelled 0 and 1
    assert rules.quality(docs.limit(0), labels).count() == 0
    assert rules.quality(docs, labels).count() == 5


def test_the_sample_is_bounded(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    seen = []
    whole = rules.learn
    try:
        rules.learn = lambda x, good, **k: seen.append(len(x)) or whole(x, good, **k)
        rules.fit_on(docs, labels, rows=100)
    finally:
        rules.learn = whole
    assert 80 <= seen[0] <= 100
