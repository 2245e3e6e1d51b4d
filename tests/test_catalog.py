"""Every registered query against its SQL, on the smallest test tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == pytest.approx(b, rel=1e-6, abs=1e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = _ordered(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    found = db.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = _ordered(tuple(r[i] for i in at) for r in found.fetchall())
    assert len(ours) == len(theirs)
    assert all(_same(a, b) for x, y in zip(ours, theirs) for a, b in zip(x, y))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_parallel_analysis_runs(spark):
    """Its simulated side is no SQL; the observed side is ``pca_observed_eigenvalues``."""
    rows = QUERIES["pca_parallel_analysis"](spark, FOLDER).orderBy("component").collect()
    assert [r.component for r in rows] == [1, 2, 3, 4]
    assert all(r.random > 0 for r in rows[:1]) and [r.retained for r in rows] == sorted((r.retained for r in rows), reverse=True)


def test_all_but_simulation_has_sql():
    from trialframe.catalog import ORACLES as own, QUERIES as queries

    assert set(queries) - set(own) == {"pca_parallel_analysis"}


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() == 12 and "estimate" in df.columns
