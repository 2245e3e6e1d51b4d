"""Fingerprints and their links against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trialframe.llm import components, simhash
from trialframe.llm.catalog import QUERIES, table

FOLDER = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_labels(fps, budget=3):
    fps = np.array(fps, np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= budget
    label = np.arange(len(fps))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a B", "A b C d", "É é Ü x y", "w " * 70000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (2**64 - 1) == slow_fingerprint(text)


def test_hash_is_the_engines(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("aé b c"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest("aé b c".encode(), 42)


def test_whole_table(spark):
    docs = sorted(table(spark, FOLDER, "documents").collect(), key=lambda r: r.doc_id)
    fps = [slow_fingerprint(r.text) for r in docs]
    label = slow_labels(fps)
    got = {r.doc_id: r for r in QUERIES["op8_simhash_trie"](spark, FOLDER).collect()}
    assert len(got) == len(docs)
    for i, r in enumerate(docs):
        assert got[r.doc_id].fingerprint == f"{fps[i]:016x}"
        assert got[r.doc_id].component_id == docs[label[i]].doc_id


@pytest.mark.parametrize("node_rows", [4, 64, 2048])
def test_crowded_nodes_are_split_without_losing_links(spark, monkeypatch, node_rows):
    monkeypatch.setattr(simhash, "NODE_ROWS", node_rows)
    rng = np.random.default_rng(node_rows)
    fps = set()
    for centre in rng.integers(0, 2**64, 4, dtype=np.uint64).tolist():
        for _ in range(120):
            flips = rng.choice(64, rng.integers(0, 9), replace=False)
            fps.add(centre ^ sum(1 << int(b) for b in flips))
    fps = sorted(fps | set(rng.integers(0, 2**64, 200, dtype=np.uint64).tolist()))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(signed)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.component_ids(df).collect()}
    assert [got[v] for v in signed] == slow_labels(fps).tolist()


def test_edges_of_the_table(spark):
    rows = [(5, None), (3, ""), (None, "  "), (7, "a b c d e f"), (7, "a b c d e f"), (9, "A B C D E F"), (None, "lone words here now")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = simhash.near_duplicates(df).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got if r.component_id is not None) == [
        (-1, 3), (3, 3), (5, 3), (7, 7), (7, 7), (9, 7)]
    assert sum(r.component_id is None for r in got) == 1
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 7]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.deduplicate(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components.connected(df).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{200 + i: 100 for i in range(50)}}
