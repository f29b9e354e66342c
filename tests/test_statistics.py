import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablens.operators import frequencies, indexes, order, quantiles, summary
from tablens.operators.columns import as_number


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_nearest_quantiles_match_their_definition(spark):
    random.seed(1)
    for n in (1, 2, 3, 4, 5, 10, 101):
        data = [float(random.randint(0, 7)) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in data], "v double")
        got = quantiles.quantiles(df, {"v": F.col("v")}, (0.0, 0.25, 0.5, 0.75, 1.0))["v"]
        ordered = sorted(data)
        assert got == [ordered[math.floor((n - 1) * q + 0.5)] for q in (0.0, 0.25, 0.5, 0.75, 1.0)]


def test_linear_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    data = np.concatenate([rng.normal(size=5000), np.full(2500, 0.25)])
    df = spark.createDataFrame(pd.DataFrame({"v": data}))
    got = quantiles.quantiles(df, {"v": F.col("v")}, (0.01, 0.25, 0.5, 0.99), "linear")["v"]
    assert np.allclose(got, np.quantile(data, [0.01, 0.25, 0.5, 0.99]), rtol=0, atol=1e-12)


def test_quantiles_narrow_wide_brackets(spark, monkeypatch):
    """With a tiny candidate limit every bracket is narrowed again, and stays exact."""
    monkeypatch.setattr(quantiles, "CANDIDATES", 3)
    monkeypatch.setattr(quantiles, "STEPS", 20)
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.lognormal(sigma=4, size=3000), np.zeros(1500), -rng.random(500)])
    df = spark.createDataFrame(pd.DataFrame({"v": data})).repartition(7)
    got = quantiles.quantiles(df, {"v": F.col("v")}, (0.1, 0.5, 0.9))["v"]
    assert got == [np.sort(data)[math.floor((len(data) - 1) * q + 0.5)] for q in (0.1, 0.5, 0.9)]


@pytest.mark.parametrize("candidates", [1, 40, 500])
def test_quantiles_do_not_depend_on_the_limits(spark, monkeypatch, candidates):
    monkeypatch.setattr(quantiles, "CANDIDATES", candidates)
    rng = np.random.default_rng(11)
    frame = pd.DataFrame({"a": rng.standard_cauchy(4000), "b": np.where(rng.random(4000) < 0.99, np.nan, 1.0) * rng.random(4000)})
    df = spark.createDataFrame(frame).replace(float("nan"), None)
    got = quantiles.quantiles(df, {c: F.col(c) for c in frame}, (0.25, 0.5, 0.75))
    for c in frame:
        ordered = np.sort(frame[c].dropna())
        assert got[c] == [ordered[math.floor((len(ordered) - 1) * q + 0.5)] for q in (0.25, 0.5, 0.75)]


def test_quantiles_of_extreme_values(spark):
    data = [float("-inf"), -1e308, -5e-324, -0.0, 0.0, 5e-324, 1e-300, 1.0, 1.0 + 2**-52, 1e308, float("inf"), float("inf")]
    df = spark.createDataFrame([(v,) for v in data * 3], "v double")
    marks = [k / 35 for k in range(36)]
    got = quantiles.quantiles(df, {"v": F.col("v")}, marks)["v"]
    assert got == sorted(data * 3)


def test_quantiles_take_the_same_jobs_for_any_number_of_columns(spark):
    def jobs(n):
        df = spark.range(500).select(*[((F.col("id") * 7919 * (k + 1)) % 1009).cast("double").alias(f"c{k}") for k in range(n)])
        spark.sparkContext.setJobGroup(f"quantiles{n}", "")
        got = quantiles.quantiles(df, {c: F.col(c) for c in df.columns}, (0.25, 0.5, 0.75), "linear")
        spark.sparkContext.setJobGroup("", "")
        assert len(got) == n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"quantiles{n}"))

    assert jobs(10) == jobs(60)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert quantiles.quantiles(df, {"v": F.col("v")}, (0.5,)) == {"v": [None]}
    assert quantiles.quantiles(df.limit(0), {"v": F.col("v")}, (0.5,)) == {"v": [None]}


EDGES = [
    # text, constant, all null, NaN, ties
    ("a", 1.0, None, float("nan"), 1),
    ("b", 1.0, None, 2.0, 1),
    ("b", 1.0, None, 3.0, 2),
    (None, 1.0, None, 1000.0, 2),
    ("b", 1.0, None, 2.5, 3),
    ("b", 1.0, None, 2.2, None),
]
EDGE_SCHEMA = "t string, same double, none double, odd double, ties int"


@pytest.fixture
def edges(spark):
    return spark.createDataFrame(EDGES, EDGE_SCHEMA)


def test_missing_ignores_nan(edges):
    got = rows_of(summary.missing_values(edges), "column_name", "missing_count", "missing_pct")
    assert got == [("none", 6, 100.0), ("odd", 0, 0.0), ("same", 0, 0.0), ("t", 1, 16.6667), ("ties", 1, 16.6667)]


def test_outliers_on_edges(edges):
    got = rows_of(summary.outliers_per_column(edges), "column_name", "outliers")
    assert got == [("none", 0), ("odd", 1), ("same", 0), ("ties", 0)]


def test_describe_on_edges(edges):
    by_name = {r["column_name"]: r for r in summary.describe_numeric(edges).collect()}
    assert by_name["none"]["value_count"] == 0 and by_name["none"]["q50"] is None
    assert by_name["same"]["std"] == 0.0 and by_name["same"]["q25"] == 1.0
    assert by_name["ties"]["null_count"] == 1 and by_name["ties"]["mean"] == 1.8


def test_moments_of_constants_are_null(edges):
    by_name = {r["column_name"]: r for r in summary.skew_kurtosis(edges).collect()}
    assert by_name["same"]["skewness"] is None and by_name["none"]["kurtosis"] is None
    scores = {c: r["extremeness"] for c, r in by_name.items() if r["extremeness"] is not None}
    assert set(scores) == {"odd", "ties"}
    assert summary.most_extreme_column(edges).first()["column_name"] == max(scores, key=scores.get)


def test_empty_table(edges):
    empty = edges.limit(0)
    assert summary.dataset_shape(empty).first().asDict() == {"num_rows": 0, "num_columns": 5}
    assert summary.duplicate_rows(empty).first()["duplicated_rows"] == 0
    assert all(r["missing_pct"] is None for r in summary.missing_values(empty).collect())
    assert frequencies.constant_columns(empty).count() == 0
    assert rows_of(summary.outliers_per_column(empty), "outliers") == [(0,)] * 4


def test_duplicates_with_nulls_and_maps(spark):
    df = spark.createDataFrame(
        [(1, None, {"a": 1, "b": 2}), (1, None, {"b": 2, "a": 1}), (2, "x", {}), (2, "x", {}), (2, "x", {"a": 1})],
        "i int, s string, m map<string,int>",
    )
    assert summary.duplicate_rows(df).first()["duplicated_rows"] == 2


def test_duplicates_with_one_hot_row(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    assert summary.duplicate_rows(df).first()["duplicated_rows"] == 999


def test_constants_count_null_as_a_value(spark):
    df = spark.createDataFrame([(None, "a", i) for i in range(8)] + [("x", "b", 8), ("y", "c", 9)], "n string, s string, i int")
    got = rows_of(frequencies.constant_columns(df), "column_name", "top_share")
    assert got == [("n", 0.8), ("s", 0.8)]
    low = rows_of(frequencies.constant_columns(df, threshold=0.01), "column_name", "top_share")
    assert low == [("i", 0.1), ("n", 0.8), ("s", 0.8)]


def test_near_zero_variance(spark):
    rows = [("a", "k")] * 97 + [("b", "k")] * 3
    df = spark.createDataFrame(rows, "s string, constant string")
    got = frequencies.near_zero_variance(df).collect()
    assert [tuple(r) for r in got] == [("s", 32.333, 2.0, "a")]


def test_column_stats_approximate_is_close(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("s"))
    exact = summary.column_stats(df).first()
    near = summary.column_stats(df, approximate=True).first()
    assert exact["distinct_count"] == 20000 and exact["is_identifier"]
    assert abs(near["distinct_count"] - 20000) < 2000


@pytest.mark.parametrize(
    "values, expected",
    [([3, 1, 2], True), ([1, 2, 4], False), ([1, 2, 2], False), ([1, None, 2], False), ([-1, 0, 1], True)],
)
def test_index_detection_without_order(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "n int")
    assert indexes.detect_index_columns(df) == (["n"] if expected else [])


def test_index_names_and_order(spark):
    df = spark.createDataFrame([(f"u{i}", i, 100 - i, "same") for i in range(9000)], "id string, up long, down long, idx string")
    assert indexes.detect_index_columns(df) == ["id", "up", "down"]
    assert indexes.detect_index_columns(df, ["up"]) == ["id", "up"]


def test_ranks_match_pandas(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"a": rng.integers(0, 50, 3000).astype(float), "b": rng.normal(size=3000)})
    frame.loc[::7, "b"] = np.nan
    df = spark.createDataFrame(frame)
    values = {c: as_number(df, c) for c in frame}
    got = order.average_ranks(order.long_counts(df, values)).toPandas()
    for c in frame:
        expected = dict(zip(frame[c], frame[c].rank()))
        part = got[got["name"] == c]
        assert len(part) == frame[c].nunique()
        assert all(expected[v] == r for v, r in zip(part["value"], part["rank"]))


@pytest.mark.parametrize("limit", [10**6, 0])
def test_attached_ranks_keep_every_row(spark, monkeypatch, limit):
    """With a limit of 0 all ranks are joined by shuffle, a hot value and nulls included."""
    monkeypatch.setattr(order, "BROADCAST_RANKS", limit)
    monkeypatch.setattr(order, "HOT_SHARE", 0.05)
    rng = np.random.default_rng(5)
    a = np.where(rng.random(4000) < 0.4, 7.0, rng.normal(size=4000))
    b = np.where(rng.random(4000) < 0.2, np.nan, rng.normal(size=4000))
    frame = pd.DataFrame({"a": a, "b": b})
    df = spark.createDataFrame(frame)
    got = order.attach_ranks(df, {c: as_number(df, c) for c in frame}).toPandas()
    expected = frame.rank()
    assert len(got) == len(frame)
    for c in frame:
        assert sorted(got[c].dropna()) == sorted(expected[c].dropna())
    assert got.corr().iloc[0, 1] == pytest.approx(expected.corr().iloc[0, 1], abs=1e-12)


@pytest.mark.parametrize("limit, avoided", [(10**6, "hashpartitioning(row#"), (0, "SortMergeJoin")])
def test_ranks_of_few_values_stay_in_the_row_and_others_meet_no_values(spark, monkeypatch, limit, avoided):
    """Few values: no shuffle by row. Many values: no join by value, no list of cells per row."""
    monkeypatch.setattr(order, "BROADCAST_RANKS", limit)
    df = spark.range(2000).select((F.col("id") % 50).cast("double").alias("a"), (F.col("id") * 7 % 1000).cast("double").alias("b"))
    ranks, _ = order.pairwise_ranks(df, {c: F.col(c) for c in df.columns})
    plan = ranks._jdf.queryExecution().executedPlan().toString()
    assert avoided not in plan and "ObjectHashAggregate" not in plan


@pytest.mark.parametrize("limit, share", [(10**6, 0.05), (10**3, 0.05), (0, 0.05), (0, 0.5)])
def test_pairwise_ranks_with_ties_gaps_and_odd_numbers(spark, monkeypatch, limit, share):
    """By broadcast, by interval and mixed: every rank a pair has, row by row."""
    monkeypatch.setattr(order, "BROADCAST_RANKS", limit)
    monkeypatch.setattr(order, "HOT_SHARE", share)
    rng = np.random.default_rng(8)
    n = 3000
    frame = pd.DataFrame({"a": rng.normal(size=n).round(2), "b": rng.normal(size=n), "c": rng.integers(0, 5, n).astype(float), "d": np.nan})
    frame.loc[rng.random(n) < 0.3, "a"] = -0.0
    frame.loc[rng.random(n) < 0.1, "a"] = 0.0
    frame.loc[rng.random(n) < 0.1, "a"] = np.inf
    frame.loc[rng.random(n) < 0.1, "b"] = -np.inf
    frame.loc[rng.random(n) < 0.2, "b"] = np.nan
    frame.loc[rng.random(n) < 0.2, "c"] = np.nan
    df = spark.createDataFrame(frame)
    values = {c: as_number(df, c) for c in frame}
    ranks, place = order.pairwise_ranks(df, values)
    sides = [(x, y) for x in frame for y in frame if x != y]
    got = ranks.select(
        *[F.when(F.col(y)[0].isNotNull(), F.col(x)[place[y]]).alias(x + y) for x, y in sides]
    ).toPandas().astype(float)
    expected = pd.DataFrame({x + y: frame[x].where(frame[y].notna()).rank() for x, y in sides})
    by = list(expected)
    got, expected = (t.sort_values(by).reset_index(drop=True) for t in (got, expected))
    pd.testing.assert_frame_equal(got, expected)


def test_file_index_counts_rows_in_scan_order(spark, sf, tmp_path):
    path = str(tmp_path / "numbers")
    spark.range(0, 5000, 1, 4).write.parquet(path)
    indexed = order.file_index(spark.read.parquet(path)).toPandas()
    assert sorted(indexed["row_index"]) == list(range(5000))


def test_long_texts_are_counted_by_digest_but_shown_whole(spark):
    long = "word " * 100
    rows = [(long, f"{i} " * 80) for i in range(95)] + [("short", "x" * 64)] * 5
    df = spark.createDataFrame(rows, "common string, varied string")
    got = {r["column_name"]: r for r in frequencies.near_zero_variance(df).collect()}
    assert got["common"]["most_common_value"] == long and got["common"]["freq_ratio"] == 19.0
    assert "varied" not in got
    assert frequencies.distinct_counts(df, df.columns).where("column_name = 'varied'").first()["n_unique"] == 96
    top = frequencies.constant_columns(df).collect()
    assert [tuple(r) for r in top] == [("common", 0.95)]


def test_bounded_counts(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("many"), F.when(F.col("id") % 3 > 0, F.lit("a")).alias("few"))
    got = frequencies.bounded_counts(df, ["many", "few"], 10)
    assert got["few"] == 2 and abs(got["many"] - 5000) < 500
