import math
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablens.operators import charts, sampling


@pytest.fixture(scope="module")
def strata(spark):
    rows = [("big", i) for i in range(500)] + [("one", 1000)] + [(None, 2000 + i) for i in range(30)] + [("mid", 3000 + i) for i in range(40)]
    return spark.createDataFrame(rows, "s string, k long")


def test_strata_sizes(strata):
    sample = sampling.stratified_sample(strata, 40, "s", ["k"])
    sizes = {r["s"]: r["count"] for r in sample.groupBy("s").count().collect()}
    # the null stratum counts as one of four but gives no rows
    assert sizes == {"big": 10, "mid": 10, "one": 1}


def test_more_strata_than_rows(strata):
    assert sampling.stratified_sample(strata, 2, "s", ["k"]).count() == 2
    many = strata.select(F.col("k").cast("string").alias("s"), "k")
    assert sampling.stratified_sample(many, 7, "s", ["k"]).count() == 7


def test_samples_repeat(strata):
    a = sampling.random_sample(strata, 50, ["k"]).collect()
    b = sampling.random_sample(strata.repartition(5), 50, ["k"]).collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and len(a) == 50
    assert sampling.random_sample(strata, 10**6, ["k"]).count() == strata.count()


def test_copies_are_drawn_one_by_one(spark):
    """Two thirds copies of one row: a sample without key holds about that share of copies."""
    df = spark.range(0, 3000, 1, 6).select(F.when(F.col("id") % 3 > 0, F.lit(-1)).otherwise(F.col("id")).alias("v"))
    copies = sampling.random_sample(df, 300).where("v = -1").count()
    assert 150 < copies < 250


@pytest.mark.parametrize("max_rows", [7, 100, 1000])
def test_systematic(spark, max_rows):
    df = spark.range(0, 999, 1, 5).select("id", F.lit(None).cast("date").alias("d"))
    step = max(1, 999 // max_rows)
    got = sorted(r["id"] for r in sampling.systematic_sample(df, max_rows, ["id"]).collect())
    assert got == list(range(0, 999, step))


def test_strategy_chain(spark, strata):
    assert sampling.sample_auto(strata, 10**6)[0] == "no_sample"
    assert sampling.sample_auto(strata.withColumn("d", F.current_date()), 10, ["k"])[0] == "systematic_sample"
    assert sampling.sample_auto(strata, 10, key=["k"])[0] == "stratified_sample"
    numbers = strata.select("k")
    name, rows = sampling.sample_auto(numbers, 10, key=["k"])
    assert (name, rows.count()) == ("random_sample", 10)
    empty_stratum = numbers.withColumn("s", F.lit(None).cast("string"))
    assert sampling.sample_auto(empty_stratum, 10, key=["k"])[0] == "random_sample"


def test_histogram_counts_every_value(spark):
    rng = np.random.default_rng(7)
    data = np.round(rng.normal(size=2000), 2)
    df = spark.createDataFrame(pd.DataFrame({"v": data}))
    got = charts.histogram(df, ["v"]).orderBy("bin").toPandas()
    counts, edges = np.histogram(data, bins=25)
    assert got["n"].tolist() == counts.tolist()
    assert np.allclose(got["bin_low"], edges[:-1])


def test_histogram_edges(spark):
    df = spark.createDataFrame([(None, 5.0), (None, 5.0)], "none double, same double")
    got = charts.histogram(df, ["none", "same"], 4).orderBy("bin").collect()
    assert [(r["column_name"], r["n"]) for r in got] == [("same", 2), ("same", 0), ("same", 0), ("same", 0)]


def test_kde_close_to_the_exact_density(spark):
    rng = np.random.default_rng(8)
    data = rng.normal(size=3000)
    df = spark.createDataFrame(pd.DataFrame({"v": data}))
    got = charts.kde_curve(df, "v").orderBy("x").toPandas()
    width = data.std(ddof=1) * len(data) ** -0.2
    exact = np.exp(-0.5 * ((got["x"].to_numpy()[:, None] - data[None]) / width) ** 2).sum(1) / (
        len(data) * width * math.sqrt(2 * math.pi)
    )
    assert np.abs(got["density"] - exact).max() < 1e-5
    assert charts.kde_curve(df.limit(1), "v").count() == 0


def test_boxes_match_numpy(spark):
    rng = np.random.default_rng(9)
    frame = pd.DataFrame({"g": rng.choice(["a", "b"], 900), "v": rng.standard_t(2, 900)})
    got = {r["category"]: r for r in charts.box_stats(spark.createDataFrame(frame), "g", "v").collect()}
    for g, part in frame.groupby("g")["v"]:
        q1, median, q3 = np.quantile(part, [0.25, 0.5, 0.75])
        inside = part[(part >= q1 - 1.5 * (q3 - q1)) & (part <= q3 + 1.5 * (q3 - q1))]
        assert [got[g][c] for c in ("q1", "median", "q3", "whisker_low", "whisker_high")] == pytest.approx(
            [q1, median, q3, inside.min(), inside.max()]
        )
        assert got[g]["fliers"] == len(part) - len(inside)


def test_too_many_categories_give_no_boxes(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("g"), F.rand(1).alias("v"))
    assert charts.box_stats(df, "g", "v").count() == 0


def test_extreme_column_is_logged_only_when_non_negative(spark):
    rows = [(float(i % 3), 0.0) for i in range(50)] + [(500.0, -1000.0)]
    df = spark.createDataFrame(rows, "up double, down double")
    up = charts.extreme_column_profile(df, ["up"])["box"].first()
    down = charts.extreme_column_profile(df, ["down"])["box"].first()
    assert up["log_scale"] and up["q3"] == pytest.approx(math.log(3))
    assert not down["log_scale"] and down["fliers"] == 1
    assert charts.extreme_column_profile(df.withColumn("c", F.lit(1.0)), ["c"]) is None


def test_regression(spark):
    rng = np.random.default_rng(10)
    x = rng.random(2000)
    y = 3 * x + 1 + rng.normal(size=2000)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).withColumn("c", F.lit(1.0))
    line, flat = charts.regression_lines(df, [("x", "y"), ("c", "y")]).collect()
    slope, intercept = np.polyfit(x, y, 1)
    assert (line["slope"], line["intercept"]) == (pytest.approx(slope), pytest.approx(intercept))
    assert flat["slope"] is None
    band = charts.regression_band(df, "x", "y").orderBy("x").toPandas()
    assert len(band) == 100 and np.allclose(band["fitted"], slope * band["x"] + intercept)
    # width of the band against the usual formula
    residual = y - slope * x - intercept
    error = residual.std(ddof=2) * np.sqrt(1 / 2000 + (band["x"] - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum())
    ratio = (band["band_high"] - band["band_low"]) / (2 * 1.96 * error)
    assert ratio.between(0.8, 1.2).all()
    assert charts.regression_band(df, "c", "y").count() == 0


def test_systematic_sample_with_ties(spark):
    from tablens.operators.sampling import systematic_sample

    df = spark.range(1000).selectExpr("id", "id % 3 AS day")
    assert systematic_sample(df, 100, ["day"]).count() == 100


def test_histogram_leaves_out_infinities(spark):
    from tablens.operators.charts import histogram

    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("inf"),)], "v double")
    assert sum(r.n for r in histogram(df, ["v"], 2).collect()) == 3


# ---- large samples ----------------------------------------------------------------------

def by_draws(rows, group, draws, k):
    """The k rows of each group with the smallest draws, sorted on the driver."""
    groups = {}
    for row in rows:
        if row[group] is not None:
            groups.setdefault(row[group], []).append(tuple(row))
    return sorted(sum((sorted(x, key=draws)[:k] for x in groups.values()), []))


@pytest.mark.parametrize("k", [1, 37, 400, 5000])
def test_smallest_draws_are_those_of_sorting(spark, k):
    rng = np.random.default_rng(8)
    rows = [(str(g), int(a), int(b)) for g, a, b in zip(rng.integers(0, 4, 3000), rng.integers(-(2**62), 2**62, 3000), rng.integers(-5, 5, 3000))]
    rows += [("hot", int(a), int(b)) for a, b in zip(rng.integers(-3, 3, 3000), rng.integers(-3, 3, 3000))]  # many ties
    rows += [("copies", 7, 7)] * 900 + [("few", 1, 2), (None, 0, 0), ("edge", -(2**63), 2**63 - 1), ("edge", 2**63 - 1, -(2**63))]
    df = spark.createDataFrame(rows, "g string, a long, b long").repartition(5)
    got = sampling.smallest_draws(df, F.col("g"), [F.col("a"), F.col("b")], k)
    assert sorted(map(tuple, got.collect())) == by_draws(rows, 0, lambda r: r[1:], k)
    assert got.columns == df.columns
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_systematic_sample_of_tied_and_equal_rows(spark):
    rows = [(1, f"r{k}") for k in range(300)] + [(1, "copy")] * 500 + [(2, "x"), (None, "y")]
    df = spark.createDataFrame(rows, "k long, v string").repartition(4)
    got = sampling.systematic_sample(df, 100, ["k"])
    assert got.count() == len(range(0, 802, 8)) and got.columns == ["k", "v"]
    seen = [tuple(r) for r in got.collect()]
    assert not {tuple(r) for r in seen} - set(rows)
    assert 40 <= sum(v == "copy" for _, v in seen) <= 80
    unique = [v for _, v in seen if v != "copy"]
    assert len(unique) == len(set(unique))
    assert sorted(seen, key=str) == sorted(map(tuple, sampling.systematic_sample(df.repartition(3), 100, ["k"]).collect()), key=str)


def test_a_key_on_most_rows_stays_in_many_tasks(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 10 < 9, 5).otherwise(F.col("id")).alias("k")).repartition(8)
    from tablens.operators import order

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # else a small table is one task
    try:
        placed = order.global_index(df, ["k"])
        parts = placed.where("k = 5").groupBy(F.spark_partition_id()).count().count()
        positions = placed.selectExpr("count(distinct row_index)").first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts > 4 and positions == 40_000


def test_time_series_leaves_out_index_columns(table):
    rows = [(k * 1_000, float(k % 3), datetime(2024, 1, 1 + k % 2)) for k in range(30)]
    series = charts.time_series_charts(table([(k, v, at) for k, (_, v, at) in enumerate(rows)], "k long, v double, at timestamp_ntz"))
    assert {r["value_column"] for r in series.collect()} == {"v"}
    spaced = charts.time_series_charts(table(rows, "k long, v double, at timestamp_ntz"))
    assert {r["value_column"] for r in spaced.collect()} == {"k"}
    alone = table([(k, at) for k, (_, _, at) in enumerate(rows)], "k long, at timestamp_ntz")
    assert charts.time_series_charts(alone).count() == 0 and charts.variance_histograms(alone).count() == 0
