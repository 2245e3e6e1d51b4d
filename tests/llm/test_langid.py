"""Language masks: the table itself, held-out rows, and edges."""

import numpy as np
from pyspark.sql import functions as F

from trialframe.llm import langid as g
from trialframe.llm.catalog import QUERIES, table


def test_masks_hold_all_languages_of_an_ngram():
    rng = np.random.default_rng(2)
    names = [f"l{i:02}" for i in range(70)]
    filters = g.Filters(names, "l00", lg_slots=16)
    sets = [rng.integers(0, 2**63, 200).astype(np.uint64) for _ in names]
    sets[69] = np.concatenate([sets[69], sets[3][:50]])
    for i, grams in enumerate(sets):
        filters.add(i, grams)
    for i in (0, 3, 63, 64, 69):
        found = filters.masks(sets[i])
        assert ((found[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all()
    both = filters.masks(sets[3][:50])
    assert ((both[0] >> np.uint64(3)) & (both[1] >> np.uint64(5)) & np.uint64(1)).all()
    rate = filters.false_rates()
    foreign = filters.masks(rng.integers(0, 2**63, 200_000).astype(np.uint64))
    seen = ((foreign[0] >> np.uint64(7)) & np.uint64(1)).mean()
    assert abs(seen - rate[7]) < 1e-3


def test_blocks_do_not_change_counts(monkeypatch):
    filters = g.Filters(["a", "b"], "a")
    text = "some words, ämong OTHERS; and 12 more\n" * 30
    filters.add(0, g.grams_of(g.letters_of("some words among others")))
    filters.add(1, g.grams_of(g.letters_of("and more")))
    whole = filters.counts(text)
    monkeypatch.setattr(g, "_BLOCK", 17)
    part = filters.counts(text)
    assert (whole[0] == part[0]).all() and whole[1] == part[1] == len(g.grams_of(g.letters_of(text)))


def test_held_out_rows_of_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op5_language_masks"](spark, folder)
    joined = got.join(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    assert joined.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.99


def test_edges(spark):
    rows = [(i, "the cat sat on the mat and the dog", "en") for i in range(20)] + [(100 + i, "der Hund und die Katze auf der Matte", "de") for i in range(20)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "12 34 !!", "en"), (203, "日本", None), (None, "the dog", "en"), (204, "die Katze " * 80_000, None), (1, "the cat sat on the mat and the dog", "en")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    got = g.held_out_languages(df).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (0, 105, 200, 201, 202, 204, None)] == ["en", "de", "und", "und", "und", "de", "en"]
    assert by_id[203].lang_pred in ("en", "de") and by_id[203].score == 0
    assert all(0 <= r.score <= 1 for r in got)
    assert g.held_out_languages(df.limit(0)).count() == 0
    assert {r.lang_pred for r in g.held_out_languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
