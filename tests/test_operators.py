"""Table operators on hand-made edge rows and against brute force."""

from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialframe.operators import (
    aggregates, columns, joins, medians, reshape, standardize, windows,
)
from trialframe.sources import readers, scratch, writers


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_left_join_matches_missing_keys(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, x int")
    right = spark.createDataFrame([("a", 10), (None, 20), (None, 21)], "k string, y int")
    want = {("a", 1, 10), (None, 2, 20), (None, 2, 21), ("c", 3, None)}
    assert rows(joins.left_join(left, right, ["k"])) == want
    assert rows(joins.left_join(left, right, ["k"], salt=4)) == want


def test_class_lookup_sends_missing_group_to_other(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "g string")
    env = spark.createDataFrame([("hi", 1.0), ("lo", 2.0)], "site string, t double")
    got = joins.class_lookup(df, "g", ["a"], env, "site", "hi", "lo", {"t": "t"})
    assert rows(got) == {("a", 1.0), ("b", 2.0), (None, 2.0)}


def test_dictionary_with_repeated_text_keeps_rows(spark):
    df = spark.createDataFrame([("x",), (None,)], "c string")
    names = spark.createDataFrame([("x", "A"), ("x", "B")], "old string, new string")
    assert rows(joins.correct_by_dictionary(df, "c", names, "old", "new")) == {("x", "B"), (None, None)}


def test_wider_raises_on_a_repeated_cell(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (1, "b", 3.0), (None, "b", 4.0)],
                               "id int, code string, value double")
    with pytest.raises(Exception, match="more than one value"):
        reshape.wider(df, ["id"], "code", "value", ["a", "b"]).collect()
    assert rows(reshape.wider(df, ["id"], "code", "value", ["a", "b"], "mean")) == {
        (1, 1.5, 3.0), (None, None, 4.0)}


def test_longer_keeps_missing(spark):
    df = spark.createDataFrame([(1, 1.0, None)], "id int, a double, b double")
    assert rows(reshape.longer(df, ["id"], ["a", "b"])) == {(1, "a", 1.0), (1, "b", None)}


def test_stack_fills_absent_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id int, s string")
    b = spark.createDataFrame([(2,)], "id int")
    assert rows(reshape.stack(a, b)) == {(1, "x"), (2, None)}


def test_mutate_sees_earlier_values(spark):
    df = spark.createDataFrame([(2.0,)], "x double")
    out = columns.mutate(df, [("x", F.col("x") * 10), ("y", F.col("x") + 1), ("x", F.col("x") * 1)])
    assert rows(out) == {(20.0, 21.0)}


@pytest.mark.parametrize("strict", [False, True])
def test_group_median_against_pandas(spark, strict):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({
        # one group holds most rows, with many ties and far outliers
        "g": rng.choice(["hot", "b", "c", "d"], 5000, p=[0.9, 0.05, 0.04, 0.01]),
        "x": np.where(rng.random(5000) < 0.5, rng.integers(0, 5, 5000), rng.normal(0, 1e6, 5000)),
        "y": rng.normal(size=5000),
    })
    pdf.loc[pdf.index % 17 == 0, "y"] = np.nan
    pdf.loc[pdf.g == "d", "x"] = np.nan
    df = readers.normalise_missing(spark.createDataFrame(pdf)).repartition(7)
    got = medians.group_median(df, ["g"], ["x", "y"], strict=strict).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        for c in "xy":
            want = part[c].median() if not (strict and part[c].isna().any()) else np.nan
            assert got.loc[g, c] == pytest.approx(want, nan_ok=True)


def test_group_median_edge_groups(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 2.0), ("a", None), ("b", None), (None, 5.0), ("d", 7.0)],
        "g string, x double")
    want = {("a", 1.5), ("b", None), (None, 5.0), ("d", 7.0)}
    assert rows(medians.group_median(df, ["g"], ["x"])) == want
    assert rows(medians.group_median(df, ["g"], ["x"], small_groups=True)) == want
    assert rows(medians.group_median(df, ["g"], ["x"], strict=True)) == {
        ("a", None), ("b", None), (None, 5.0), ("d", 7.0)}


def test_standardize_against_numpy_and_impute_after_scaling(spark):
    pdf = pd.DataFrame({"g": ["a"] * 4 + ["b"] * 3, "x": [1, 2, None, 5, 7, None, 9.0], "c": [3.0] * 7})
    df = readers.normalise_missing(spark.createDataFrame(pdf))
    out = standardize.standardize(df, {"x": F.col("x"), "c": F.col("c")}, "g", {"a": ["x"]})
    got = out.toPandas()
    z = (pdf.x - pdf.x.mean()) / pdf.x.std()
    want = z.where(~((pdf.g == "a") & z.isna()), z[pdf.g == "a"].mean())
    np.testing.assert_allclose(np.sort(got.x), np.sort(want))
    assert got.c.isna().all()  # no variance, no z-score


def test_log_zscore_ignores_a_constant_factor(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (0.0,), (8.0,)], "x double")
    a = standardize.standardize(df, {"x": F.ln("x")}).toPandas().x
    b = standardize.standardize(df, {"x": F.ln(F.col("x") * 100)}).toPandas().x
    np.testing.assert_allclose(a, b)
    assert a.isna().sum() == 1


def test_impute_drops_ungrouped_rows(spark):
    df = spark.createDataFrame([("a", None), ("a", 2.0), ("b", None), (None, 1.0)], "g string, x double")
    out = standardize.impute_group_mean(df, "g", {"a": ["x"]})
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [("a", 2.0), ("a", 2.0), ("b", None)], key=str)


def test_standardize_plans_no_window_join_or_extra_shuffle(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("x"))
    plan = standardize.standardize(df, {"x": F.col("x")})._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_running_share(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("a", 1.0), ("z", 5.0)], "t string, v double")
    got = {r.t: (r.level_order, r.prop, r.cumsum, r.pos)
           for r in windows.running_share(df, "t", ["a", "b"], "v").collect()}
    assert got == {"b": (2, 0.3, 0.3, 0.15), "a": (1, 0.2, 0.5, 0.4), None: (None, 0.5, 1.0, 0.75)}


def test_shares(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0)], "g string, v double")
    got = windows.partition_share(df, ["g"], "v")
    assert {(r.g, r.v, r.total, r.share) for r in got.collect()} == {
        ("a", 1.0, 4.0, 0.25), ("a", 3.0, 4.0, 0.75), (None, 2.0, 2.0, 1.0)}
    assert rows(aggregates.group_share(df, ["g"])) == {("a", 67.0), (None, 33.0)}


def test_csv_round_trips(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("TimeStamp;Plot;Moisture......\n03/07/2021 10:00;1;12,5\n04/07/2021;NA;\n")
    got = readers.clean_names(readers.read_csv_decimal_comma(
        spark, str(path), "TimeStamp string, Plot string, `Moisture......` double"))
    assert rows(got) == {("03/07/2021 10:00", "1", 12.5), ("04/07/2021", None, None)}
    out = writers.write_result_csv(got.coalesce(1), str(tmp_path / "r"))
    back = readers.read_csv(spark, out, "timestamp string, plot string, moisture double")
    assert back.count() == 2


def test_snapshot_is_partitioned_by_run_date(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0)], "id int, x double")
    path = writers.write_snapshot(df, str(tmp_path), "2021-07-01")
    assert path.endswith("run_date=2021-07-01")
    assert rows(readers.read_snapshot(spark, str(tmp_path))) == {
        (1, None, date(2021, 7, 1)), (2, 3.0, date(2021, 7, 1))}


def test_a_failed_write_leaves_the_last_snapshot(spark, tmp_path):
    base = str(tmp_path)

    def current():
        return rows(readers.read_snapshot(spark, base).select("id", F.col("run_date").cast("string")))

    first = spark.createDataFrame([(1,), (2,)], "id int")
    writers.write_snapshot(first, base, "2021-07-01")
    broken = spark.range(0, 100, 1, 4).select(
        F.when(F.col("id") < 90, F.col("id").cast("int")).otherwise(F.raise_error(F.lit("lost"))).alias("id"))
    with pytest.raises(Exception, match="lost"):
        writers.write_snapshot(broken, base, "2021-07-01")
    assert current() == {(1, "2021-07-01"), (2, "2021-07-01")}
    with pytest.raises(Exception, match="lost"):
        writers.write_snapshot(broken, base, "2021-07-02")  # no whole version: the date does not exist
    assert current() == {(1, "2021-07-01"), (2, "2021-07-01")}
    reading = readers.read_snapshot(spark, base)
    writers.write_snapshot(spark.createDataFrame([(3,)], "id int"), base, "2021-07-01")
    assert rows(reading.select("id")) == {(1,), (2,)}  # a reader that started earlier
    writers.write_snapshot(spark.createDataFrame([(4,)], "id int"), base, "2021-07-02")
    assert current() == {(3, "2021-07-01"), (4, "2021-07-02")}
    writers.write_snapshot(spark.createDataFrame([(5,)], "id int"), base, "2021-07-01")
    versions = [n for n in readers.children(spark, f"{base}/run_date=2021-07-01") if n.startswith("version=")]
    assert len(versions) == 2 and current() == {(5, "2021-07-01"), (4, "2021-07-02")}


def test_scratch_paths_never_repeat(spark):
    assert scratch.fresh_path(spark, "a") != scratch.fresh_path(spark, "a")


def test_result_files_follow_the_caller_not_the_rows(spark, tmp_path):
    def parts(path):
        return len(list(path.glob("part-*.csv")))

    rows = spark.range(1000, numPartitions=5).filter("id % 10 = 0")
    writers.write_result_csv(rows, str(tmp_path / "as_is"))
    writers.write_result_csv(rows, str(tmp_path / "two"), files=2)
    assert parts(tmp_path / "as_is") == 5 and parts(tmp_path / "two") == 2


def test_quoted_blanks_are_missing(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n"",1\nx,2\nNA,3\n')
    got = readers.read_csv(spark, str(tmp_path / "q.csv"), "a string, b int").orderBy("b").collect()
    assert [r.a for r in got] == [None, "x", None]


def test_few_counters_are_gathered_for_a_median(spark, monkeypatch):
    """One group holds all rows, all distinct: a round gathers few counters, and no window ranks rows."""
    seen = []
    real = medians._counters

    def watched(*given):
        out = real(*given)
        seen.append(out.select(F.max(F.size("__counters"))).first()[0])
        assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
        return out

    monkeypatch.setattr(medians, "_counters", watched)
    n = 400_001
    df = spark.range(n).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % n).cast("double").alias("x"))
    assert medians.group_median(df, ["g"], ["x"]).first()["x"] == (n - 1) / 2
    assert len(seen) == 2 and max(seen) < n / 8
    # values that agree in all but their last bits take every round
    close = spark.range(9).select(F.lit(1).alias("g"), (F.lit(1.0) + F.col("id") * 2.0**-52).alias("x"))
    assert medians.group_median(close, ["g"], ["x"]).first()["x"] == 1 + 4 * 2.0**-52
    assert len(seen) == 6


def test_ordered_bits_are_the_doubles_own(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**64, 20_000, dtype=np.uint64).view(np.float64)
    edge = [0.0, -0.0, 1.0, -1.0, np.inf, -np.inf, 5e-324, -5e-324, 2.0**-1022, np.nextafter(2.0**-1022, 0), 2.0**1023,
            np.finfo(float).max, np.nextafter(1, 2), np.nextafter(1, 0), np.nextafter(8, 0), 0.1, 3.0]
    x = np.concatenate([x[~np.isnan(x)], edge])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", medians.ordered_bits(F.col("x")).alias("k"))
    got = df.select("x", "k", medians.from_ordered_bits(F.col("k")).alias("back")).toPandas()
    bits = x.view(np.int64)
    want = np.where(bits < 0, -(bits & (2**63 - 1)), bits)
    assert (got.k.to_numpy() == want).all() and (got.back == got.x).all()
    odd = spark.createDataFrame([(None,), (float("nan"),)], "x double").select(medians.ordered_bits(F.col("x")).alias("k"))
    assert [r.k for r in odd.collect()] == [None, 2**63 - 1]
