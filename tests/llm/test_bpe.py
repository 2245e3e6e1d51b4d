"""Byte-level BPE against the library on whole texts, and round trips."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from trialframe.llm import bpe
from trialframe.llm.catalog import QUERIES, table, vocabulary

PATH, PATTERN = vocabulary()
ENC = bpe.encoding(bpe.read_ranks(PATH), PATTERN)

TEXTS = [
    "", " ", "a", "it's  two\n\n\nlines \t x", "é" * 50 + " ñ", "日本語のテキスト" * 40, "x" * 3000,
    "a  b   c\n" * 9000, ("word " * 4000 + " " * 20000 + "end"), " " * 40000, "a" + "\n" * 30000, "1'2 's'S 'll " * 3000,
    "  x" * 9000, "a\x1cb\x85c " * 6000, "🙂👍🏽 " * 5000,
]


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_as_the_library(text):
    got = bpe.encode_text(ENC, text)
    assert got.tolist() == ENC.encode_ordinary(text)
    assert ENC.decode_bytes(got.tolist()) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab1'! \n\t é\x1c"), max_size=80))
def test_parts_never_change_ids(text):
    ids = [i for part, single in bpe.parts(text, 5) for i in (ENC._encode_single_piece(part) if single else ENC.encode_ordinary(part))]
    assert ids == ENC.encode_ordinary(text)


def test_white_space_run_that_overflows_the_matcher():
    text = "x" + " " * 3_000_000 + "y"
    ids = bpe.encode_text(ENC, text)
    assert ENC.decode_bytes(ids.tolist()) == text.encode()


def test_query_and_edges(spark):
    rows = [(1, "two words"), (1, "two words"), (2, None), (None, ""), (3, "z" * 200_000)]
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, n_tokens int, token_ids string")
    got = bpe.digests(df, PATH, PATTERN).collect()
    assert len(got) == 5
    for r in got:
        assert r.n_tokens == len(r.token_ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.token_ids, "<u4").tobytes()).hexdigest()
    assert {r.decoded_sha256 for r in got if r.doc_id in (2, None)} == {hashlib.sha256(b"").hexdigest()}
    assert bpe.digests(df.limit(0), PATH, PATTERN).count() == 0


def test_digests_in_one_python_step(spark):
    """More steps would be as many workers for each task, each with a tokenizer."""
    df = spark.createDataFrame([(1, "two words")], "doc_id long, text string")
    plan = bpe.digests(df, PATH, PATTERN)._jdf.queryExecution().executedPlan().toString()
    assert sum(plan.count(step) for step in ("MapInArrow", "MapInPandas", "EvalPython")) == 1


def test_steps_apart_agree_with_the_digests(spark):
    rows = [(1, "two  words\n"), (1, "two  words\n"), (2, None), (None, ""), (3, "é🙂 " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    apart = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN)
    apart = {(r.doc_id, tuple(r.token_ids), r.ids, hashlib.sha256(r.decoded).hexdigest())
             for r in apart.withColumn("ids", bpe.ids_sha256("token_ids")).collect()}
    assert {(r.doc_id, tuple(r.token_ids), r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, PATH, PATTERN).collect()} == apart


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in table(spark, folder, "documents").collect()}
    for r in QUERIES["op9_byte_bpe"](spark, folder).collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert r.n_tokens == len(ENC.encode_ordinary(texts[r.doc_id]))
