"""Leaks against a plain edit-distance scan."""

import random

import numpy as np

from trialframe.llm import decontaminate as d
from trialframe.llm.catalog import QUERIES, table

FOLDER = "/root/testdata/sf0.001"


def slow_best(item, text):
    """Fewest edits of the item against any region of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_grams():
    codes = d._codes("abcdefghijklm")
    for q in range(1, 9):
        hashed = d.gram_hashes(codes, q)
        assert len(hashed) == 14 - q and len(set(hashed.tolist())) == 14 - q
    assert (d.gram_hashes(d._codes("xxabcdefgh"), 8)[2] == d.gram_hashes(d._codes("abcdefgh"), 8)[0])


def test_whole_items_and_edits():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]
    item = lambda n: " ".join(rng.choice(words) + str(rng.randrange(100)) for _ in range(n))
    items = [(i, item(rng.randrange(6, 40))) for i in range(25)]
    index = d.Index(items, d.Q, d.RATE)
    texts, expected = [], []
    for trial in range(120):
        j = rng.randrange(25)
        piece = list(items[j][1])
        for _ in range(rng.randrange(0, int(index.budget[j]) * 2 + 1)):
            at = rng.randrange(len(piece))
            kind = rng.randrange(3)
            if kind == 0:
                piece[at] = rng.choice("xyz")
            elif kind == 1:
                piece.insert(at, rng.choice("xyz"))
            elif len(piece) > 1:
                del piece[at]
        texts.append(d.normal(item(rng.randrange(0, 30)) + " " + "".join(piece) + " " + item(rng.randrange(0, 30))))
        expected.append({k for k in range(25) if slow_best(items[k][1], texts[-1]) <= index.budget[k]})
    found = d.matches(index, texts)
    assert [{h[0] for h in row} for row in found] == expected
    for text, row in zip(texts, found):
        for k, start, end, edits in row:
            assert edits <= index.budget[k] and slow_best(items[k][1], text[start:end]) == edits


def test_long_texts_are_scanned_in_blocks(monkeypatch):
    monkeypatch.setattr(d, "_BLOCK", 64)
    monkeypatch.setattr(d, "_COUNTS", 16)
    items = [(1, "the quick brown fox jumps over the lazy dog again")]
    text = "pad " * 300 + items[0][1] + " pad" * 300
    assert d.matches(d.Index(items, 8, 0.1), [text])[0][0][1:] == (1200, 1200 + len(items[0][1]), 0)


def test_tables_and_edges(spark):
    bench = spark.createDataFrame(
        [(1, "The quick  brown fox jumps over the lazy dog"), (2, None), (3, "short"), (None, "a second item of some useful length"), (1, "The quick  brown fox jumps over the lazy dog")],
        "item_id long, text string")
    rows = [(1, "x THE QUICK\nbrown fox jumps over the lazy dog y"), (1, "x THE QUICK\nbrown fox jumps over the lazy dog y"), (2, None), (3, ""),
            (None, "before a second item of some usefull length"), (4, "clean words only " * 9000), (5, "the quick brown fox sleeps")]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, leaks string, item_id int")
    found = d.leaks(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.edits) for r in found) == [(0, -1, 1)] + [(1, 1, 0)] * 4
    assert not [r for r in found if r.item_id == 3]  # no text holds the short item
    kept = d.without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5]
    sliced = d.leaks(docs, bench, slice_chars=30).collect()
    assert sorted(map(repr, sliced)) == sorted(map(repr, found))
    assert d.without_leaks(docs, bench.limit(0)).count() == len(rows)
    assert d.leaks(docs.limit(0), bench).count() == 0


def test_small_blocks_find_the_same(monkeypatch):
    rng = random.Random(9)
    words = ["ab", "abab", "ba", "cab"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randrange(8, 24))) for i in range(6)]
    texts = [text(rng.randrange(0, 60)) for _ in range(8)] + [i[1] for i in items] + [""]
    index = d.Index(items, d.Q, d.RATE)
    whole = d.matches(index, texts)
    for t, row in zip(texts, whole):
        assert {h[0] for h in row} == {k for k in range(6) if slow_best(items[k][1], t) <= index.budget[k]}
    for block, counts in [(16, 8), (100, 64), (1 << 17, 50)]:
        monkeypatch.setattr(d, "_BLOCK", block)
        monkeypatch.setattr(d, "_COUNTS", counts)
        assert [{h[0] for h in row} for row in d.matches(index, texts)] == [{h[0] for h in row} for row in whole]


def test_a_repetitive_megabyte_needs_little_memory():
    import tracemalloc

    index = d.Index([(1, "word " * 179 + "word"), (2, "another item of some length that never occurs")], d.Q, d.RATE)
    text = "word " * 199_999 + "word"
    tracemalloc.start()
    found = d.matches(index, [text])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found and {h[0] for h in found} == {0} and peak < 1 << 29


def test_short_items_at_word_borders(spark):
    bench = spark.createDataFrame([(1, "Is it so?"), (2, "ten chars!"), (2, "ten chars!"), (3, " \n"), (4, "7")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "He asked: is  IT so? Yes."), (2, "this it so? 77"), (3, "ten chars! ten chars!"), (4, "often chars!"), (5, "(7)")], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start, r.end, r.edits) for r in d.leaks(docs, bench).collect())
    assert got == [(1, 1, 10, 19, 0)] + [(3, 2, 0, 10, 0)] * 2 + [(3, 2, 11, 21, 0)] * 2 + [(5, 4, 1, 2, 0)]


def test_slices_run_one_after_the_other(spark):
    bench = spark.createDataFrame([(i, f"item number {i} of this small benchmark table") for i in range(6)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before item number {i} of this small benchmark table after") for i in range(4)], "doc_id long, text string")
    sliced = d.with_leaks(docs, bench, slice_chars=120)
    plan = sliced._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    whole = d.with_leaks(docs, bench)
    rows = lambda df: sorted((r.doc_id, r.text, sorted(r.leaks)) for r in df.collect())
    assert sliced.columns == whole.columns and rows(sliced) == rows(whole)


def test_whole_table(spark):
    docs = {r.doc_id: d.normal(r.text) for r in table(spark, FOLDER, "documents").collect()}
    bench = {r.item_id: d.normal(r.text) for r in table(spark, FOLDER, "benchmark").collect()}
    got = QUERIES["op4_qgram_decontamination"](spark, FOLDER).collect()
    exact = {(i, j) for i, t in docs.items() for j, b in bench.items() if b in t}
    assert exact <= {(r.doc_id, r.item_id) for r in got}
    for r in got:
        assert slow_best(bench[r.item_id], docs[r.doc_id][r.start : r.end]) == r.edits
