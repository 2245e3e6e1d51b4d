"""Ranked search against a plain count of terms."""

import math
import random
import re
from collections import Counter

from trialframe.llm import automaton_search as search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ROWS = "item_id long, rank int, doc_id long, score long"


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items, top=10):
    counts = [(i, Counter(words(t))) for i, t in docs]
    sized = [(i, c, sum(c.values())) for i, c in counts if c]
    n, total = len(sized), sum(s for _, _, s in sized)
    wanted = {}
    for item, text in items:
        if item is not None:
            wanted.setdefault(item, set()).update(words(text))
    out = []
    for item, own in wanted.items():
        df = {t: sum(t in c for _, c, _ in sized) for t in own}
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in own}
        scores = []
        for i, c, size in sized:
            m = 10 + 90 * size * n // total
            s = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def made(spark, docs, items):
    return (spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, n int"),
            spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string"))


def test_against_plain_counts(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(30)] + ["Ünder", "naïve", "日本", "x_y", "A1", "a1", "tail's"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for i in range(150)]
    docs += [(i + 1000, docs[3][1]) for i in range(14)]  # copies tie
    docs += [(None, docs[3][1]), (None, None), (2000, None), (2001, ""), (2002, " .,;\n"), (2003, "w1 " * 50_000), (7, docs[7][1]), (7, docs[7][1])]
    rng.shuffle(docs)
    items = [(k, " ".join(rng.choices(vocabulary, k=6))) for k in range(12)] + [(3, "w29 w28"), (None, "w1"), (50, None), (51, "..."), (52, "nowhere"), (53, "w1")]
    frames = made(spark, docs, items)
    want = slow(docs, items)
    for size in (search.TERM_BYTES, 60):  # one slice, and several
        got = search.search(*frames, term_bytes=size)
        assert got.schema.simpleString() == "struct<item_id:bigint,rank:int,doc_id:bigint,score:bigint>"
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert sorted((tuple(r) for r in search.search(*frames, top=3).collect()), key=repr) == slow(docs, items, 3)


def test_empty_tables(spark):
    docs, items = made(spark, [(1, "a b")], [(1, "a")])
    assert search.search(docs.limit(0), items).count() == 0
    assert search.search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in search.search(docs, items).collect()] == slow([(1, "a b")], [(1, "a")])


def test_terms_are_whole():
    assert search.terms("The THEME, the theme's\x7fÄpfel_2") == [w.encode() for w in words("The THEME, the theme's\x7fÄpfel_2")]
    automaton = search.Automaton([b"the", b"a", b"a1"])
    assert automaton.counts(search.guarded("the theme a a a1, bathe THE")) == {0: 2, 1: 2, 2: 1}
    assert search.n_terms(search.guarded("")) == 0 and search.n_terms(search.guarded("a  b-c")) == 3
