import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablens.operators import correlation, kruskal, mutual_info


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(6)
    n = 3000
    x = rng.normal(size=n)
    out = pd.DataFrame(
        {
            "x": x,
            "y": x * 2 + rng.normal(size=n),
            "z": np.exp(x * 3),
            "ties": rng.integers(0, 4, n).astype(float),
            "same": 1.0,
            "group": rng.choice(["a", "b", "c"], n),
        }
    )
    out.loc[::5, "y"] = np.nan
    out.loc[3::11, "ties"] = np.nan
    out.loc[::13, "group"] = None
    out.loc[0, "group"] = "single"
    return out


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame).replace(float("nan"), None)


def as_dict(df, value):
    return {frozenset((r["col_a"], r["col_b"])): r[value] for r in df.collect()}


NUMBERS = ["x", "y", "z", "ties"]


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_matrix_matches_pandas(df, frame, method):
    build = correlation.corr_matrix if method == "pearson" else correlation.spearman_matrix
    got = as_dict(build(df, NUMBERS), "correlation")
    expected = frame[NUMBERS].corr(method=method)
    assert len(got) == 6
    for pair, value in got.items():
        a, b = pair
        assert value == pytest.approx(expected.loc[a, b], abs=1e-10)


def test_constant_columns_are_left_out(df):
    assert all("same" not in pair for pair in as_dict(correlation.corr_matrix(df), "correlation"))


def test_pair_constant_on_common_rows(spark):
    df = spark.createDataFrame([(1.0, 5.0), (1.0, 6.0), (2.0, None), (3.0, None)], "a double, b double")
    assert correlation.corr_matrix(df).first()["correlation"] is None


def test_strong_pairs_drop_equal_values_only_in_compat(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 3.0 * i) for i in range(9)], "a double, b double, c double")
    assert correlation.strong_correlations(df).count() == 3
    assert correlation.strong_correlations(df, compat=True).count() <= 3


def test_spearman_top_pair_skips_reported(df):
    first = correlation.spearman_top_pair(df, NUMBERS, reported=df.sparkSession.createDataFrame([], "col_a string, col_b string")).first()
    assert (first["col_a"], first["col_b"], first["spearman"]) == ("x", "z", 1.0)
    known = df.sparkSession.createDataFrame([("z", "x")], "col_a string, col_b string")
    second = correlation.spearman_top_pair(df, NUMBERS, reported=known).first()
    assert {second["col_a"], second["col_b"]} in ({"x", "y"}, {"y", "z"})


def reference_information(frame, a, b, bins=20):
    part = frame[[a, b]].dropna()

    def label(s):
        if s.dtype.kind == "f":
            if s.std(ddof=0) == 0:
                return pd.Series(0, s.index)
            return pd.Series(np.digitize(s, np.linspace(s.min(), s.max(), bins + 1)), s.index)
        return s

    joint = pd.crosstab(label(part[a]), label(part[b])).to_numpy() / len(part)
    outer = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
    mask = joint > 0
    return float((joint[mask] * np.log(joint[mask] / outer[mask])).sum())


def test_mutual_information_matches_its_definition(df, frame):
    got = as_dict(mutual_info.mutual_info_pairs(df), "mutual_info")
    assert len(got) == 15
    for pair, value in got.items():
        a, b = pair
        assert value == pytest.approx(reference_information(frame, a, b), abs=1e-9)


def test_mutual_information_labels_nan_with_the_last_bin(spark):
    rows = [(1.0, "a"), (float("nan"), "b"), (2.0, "b"), (1.0, "a")]
    row = mutual_info.mutual_info_pairs(spark.createDataFrame(rows, "x double, s string")).first()
    assert row["mutual_info"] == pytest.approx(np.log(2)) and row["n"] == 4


def test_mutual_information_with_unique_columns(spark):
    rows = [(f"id{i}", f"other{i}" if i % 4 else None, "ab"[i % 2], i) for i in range(400)]
    df = spark.createDataFrame(rows, "u string, v string, g string, n int")
    got = as_dict(mutual_info.mutual_info_pairs(df), "mutual_info")
    frame = df.toPandas().astype({"n": float})
    for pair, value in got.items():
        assert value == pytest.approx(reference_information(frame, *pair), abs=1e-9)


def test_mutual_information_of_empty_pairs(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b string")
    row = mutual_info.mutual_info_pairs(df).first()
    assert (row["mutual_info"], row["n"]) == (0.0, 0)


def reference_h(frame, group, value):
    part = frame[[group, *NUMBERS]].dropna()
    sizes = part[group].value_counts()
    part = part[part[group].isin(sizes[sizes > 1].index)]
    ranks = part[value].rank()
    n = len(part)
    total = ((ranks - (n + 1) / 2) ** 2).sum()
    between = sum(len(r) * (r.mean() - (n + 1) / 2) ** 2 for _, r in ranks.groupby(part[group]))
    return (n - 1) * between / total


def test_kruskal_matches_its_definition(df, frame):
    got = {r["column_name"]: r["h_stat"] for r in kruskal.kruskal_scores(df, "group", NUMBERS).collect()}
    assert got == pytest.approx({c: reference_h(frame, "group", c) for c in NUMBERS}, abs=1e-8)


def test_kruskal_ignores_monotone_maps(df):
    cubed = df.withColumn("x", F.pow("x", F.lit(3.0)))
    before = kruskal.kruskal_scores(df, "group", ["x"]).first()["h_stat"]
    assert kruskal.kruskal_scores(cubed, "group", ["x"]).first()["h_stat"] == pytest.approx(before, abs=1e-9)


def test_kruskal_needs_two_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "g string, v double")
    assert kruskal.kruskal_scores(df, "g").count() == 0
