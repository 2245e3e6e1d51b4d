"""The pipeline against a plain composition of its stages, and each stage on odd rows."""

from collections import defaultdict

import numpy as np

import corpus_pipeline
from test_bpe import ENC
from test_line_spread import slow as slow_lines
from test_simhash import slow_fingerprint, slow_labels
from trialframe.llm import decontaminate, line_spread, toxicity
from trialframe.llm.catalog import table

FOLDER = "/root/testdata/sf0.001"


def test_against_a_plain_composition(spark):
    docs = table(spark, FOLDER, "documents")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    model = toxicity.fit_on(docs, table(spark, FOLDER, "labels"), training=f"NOT ({toxicity.HELD_OUT})")
    kept = model.probability(model.scorer().margins([r.text for r in rows])) < 0.5
    rows = [(r.doc_id, r.text, r.source) for r, k in zip(rows, kept) if k]
    texts = dict(slow_lines(rows, line_spread.MIN_SITES))
    ids = sorted(texts)
    label = slow_labels([slow_fingerprint(texts[i]) for i in ids])
    bench = [decontaminate.normal(r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    texts = {i: texts[i] for n, i in enumerate(ids) if label[n] == n}
    leaky = {i for i, t in texts.items() if any(b in decontaminate.normal(t) for b in bench)}
    got = {r.doc_id: r.token_ids for r in corpus_pipeline.run(spark, FOLDER).collect()}
    # verbatim leaks must go; what else went must have been found within the edit budget
    assert not leaky & set(got)
    for i in set(texts) - leaky - set(got):
        index = decontaminate.Index(list(enumerate(bench)), decontaminate.Q, decontaminate.RATE)
        assert decontaminate.matches(index, [decontaminate.normal(texts[i])])[0]
    assert set(got) <= set(texts)
    for i, tokens in got.items():
        assert tokens == ENC.encode_ordinary(texts[i])


def test_stages_keep_columns_and_odd_rows(spark):
    rows = [(1, None, "en", "s1", None), (2, "", None, None, 0), (None, "a few words", "en", "s2", 11), (3, "same text here now", "en", "s1", 18),
            (3, "same text here now", "en", "s1", 18), (4, "same text here now", "en", "s2", 18), (5, "w " * 100_000, "en", "s3", 200_000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, n_lines int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        found = sorted((r.doc_id or 0) for r in out.collect())
        assert found == ([0, 1, 3, 5] if name == "near duplicates" else [0, 1, 2, 3, 3, 4, 5]), name
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert last.count() == len(rows)
