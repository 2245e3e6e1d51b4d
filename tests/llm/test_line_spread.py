"""Boilerplate lines against a plain count."""

from collections import defaultdict

from trialframe.llm import line_spread


def slow(rows, min_sites):
    sites, first = defaultdict(set), {}
    for i, text, site in rows:
        for pos, line in enumerate((text or "").split("\n") if text is not None else []):
            bare = line.strip(" ")
            if bare:
                if site is not None:
                    sites[bare].add(site)
                key = (i is not None, i or 0, text, pos)
                first[bare] = min(first.get(bare, key), key)
    out = []
    for i, text, site in rows:
        if text is None:
            out.append((i, None))
            continue
        keep = [
            line for pos, line in enumerate(text.split("\n"))
            if len(sites[line.strip(" ")]) < min_sites or not line.strip(" ") or first[line.strip(" ")] == (i is not None, i or 0, text, pos)
        ]
        out.append((i, "\n".join(keep)))
    return sorted(out, key=repr)


def test_spread_and_edges(spark):
    rows = [(i, f"head {i}\nAll rights\n\n  footer \nbody {i}", f"s{i % 5}") for i in range(40)]
    rows += [(100, "All rights", None), (101, None, "s1"), (102, "", "s1"), (103, "one\none\n one", "s2"), (None, "footer\nx", "s3")]
    rows += [(i, "only two sites", f"s{i % 2}") for i in range(200, 210)] + [(300, "same\nAll rights", "s1")] * 2
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, n_lines string, pos int")
    for min_sites in (2, 3, 5):
        got = line_spread.remove_boilerplate(df, min_sites)
        assert got.columns == ["doc_id", "text", "source", "pos", "n_lines", "n_removed"]
        assert sorted([(r.doc_id, r.text) for r in got.collect()], key=repr) == slow(rows, min_sites)
    plain = line_spread.remove_boilerplate(df, 3, counts=False)
    assert plain.columns == df.columns and plain.count() == len(rows)
    assert line_spread.remove_boilerplate(df.limit(0), 3).count() == 0


def test_counts_near_the_threshold_are_exact(spark):
    """With many sites the sketch errs; lines within its band get a distinct count."""
    import random

    random.seed(3)
    rows = [(n * 10000 + i, f"line {n}", f"site {i}") for n in range(280, 321, 4) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = line_spread.boilerplate(df, 300, lg_k=6)
    assert found.count() == len([n for n in range(280, 321, 4) if n >= 300])
