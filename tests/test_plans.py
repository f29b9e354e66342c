import json

import pytest
from pyspark.sql import functions as F

from tablens import Dataset, auto_plan, errors, profile, run_tasks


@pytest.fixture(scope="module")
def sales(spark):
    return spark.range(200).select(
        F.col("id"),
        F.element_at(F.array(*[F.lit(p) for p in ("tea", "milk", "rice")]), (F.col("id") % 3 + 1).cast("int")).alias("product"),
        (F.col("id") * 1.5).alias("sales"),
        (F.col("id") * 3.0 + 1).alias("charged"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id % 30 AS INT))").alias("day"),
    )


def test_dataset_needs_one_source(spark):
    for arguments in ({}, {"path": "a.csv", "db_url": "sqlite:///x"}):
        with pytest.raises(errors.ConfigurationError):
            Dataset(spark, **arguments)
    with pytest.raises(errors.ConfigurationError):
        Dataset(spark, db_url="redis://h/0").load(table="t")
    with pytest.raises(errors.ConfigurationError):
        Dataset(spark, db_url="mysql://h/0").load()


def test_dataset_from_file_to_profile(spark, sales, tmp_path):
    path = str(tmp_path / "sales.csv")
    sales.write.options(header=True, timestampNTZFormat="yyyy-MM-dd HH:mm:ss").csv(path)
    data = Dataset(spark, path=path)
    data.load()
    typed, report = data.infer(str(tmp_path / "schema"))
    assert dict(typed.dtypes) == {
        "id": "bigint", "product": "string", "sales": "double", "charged": "bigint", "day": "timestamp_ntz",
    }
    assert dict(data.downcast().dtypes)["id"] == "smallint"
    written = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "schema"), recursiveFileLookup=True).collect()]
    assert {w["name"] for w in written} == set(typed.columns) and "mean_length" in written[0]
    found = data.profile(str(tmp_path / "summary"))
    assert found.index_columns == ["id"]
    document = json.loads(spark.read.text(str(tmp_path / "summary")).first()["value"])
    assert document["num_rows"] == 200 and document["duplicated_rows"] == 0
    assert len(document["missing"]) == 5 and len(document["top_mutual_info_pairs"]) == 3
    assert {r["column_name"] for r in document["statistical_summary"]} == {"sales", "charged"}
    sample = data.sample(20, str(tmp_path / "sample"), order_by=["day", "id"])
    assert sample.count() == 20
    assert spark.read.text(str(tmp_path / "sample")).count() == 20
    pairs = data.correlations()
    assert pairs["strong_pairs"].count() == 3
    charts = data.charts(skip=["id"])
    assert charts["histograms"].count() == 50 and charts["categories"].count() == 3
    assert charts["boxes"].count() == 6 and charts["time_series"].count() == 30


def test_profile_options(spark, sales):
    found = profile(sales, analyze_outliers=False, analyze_skew=False, detect_constants=False)
    assert found.outliers is None and found.statistics is None and found.constants.count() == 0
    assert found.document().first()["outliers_per_column"] == []


def test_tasks_from_a_json_plan(sales):
    plan = {
        "libraries": ["unused"],
        "tasks": [
            {"name": "by_product", "chart_type": "bar", "columns": ["product", "sales"], "aggregate": "sum"},
            {"name": "spread", "plot_type": "histogram", "columns": ["sales"], "preprocessing": "dropna"},
            {"name": "lines", "plot_type": "line", "columns": ["day", "sales"]},
            {"name": "stats", "plot_type": "summary_stat", "columns": ["sales", "absent"]},
        ],
    }
    got = run_tasks(sales, json.dumps(plan))
    assert {k: v.count() for k, v in got.items()} == {"by_product": 3, "spread": 25, "lines": 30, "stats": 1}
    assert sum(r["value"] for r in got["by_product"].collect()) == pytest.approx(1.5 * 199 * 100)


def test_bad_tasks(sales):
    for task in (
        {"name": "x", "plot_type": "pie"},
        {"name": "x", "plot_type": "table", "preprocessing": [{"explode": ["a"]}]},
        {"name": "x", "plot_type": "table", "preprocessing": [{"groupby": ["product"], "agg": {"sales": "mode"}}]},
    ):
        with pytest.raises(errors.ConfigurationError):
            run_tasks(sales, [task])


def test_auto_plan_runs(sales):
    tasks = auto_plan(sales)
    names = [t["name"] for t in tasks]
    assert names[:2] == ["histogram_charged", "histogram_sales"]
    assert "bar_product" in names and "line_day_charged" in names and "scatter_charged_sales" in names
    assert all("id" not in t["columns"] for t in tasks)
    for result in run_tasks(sales, tasks).values():
        assert result.count() > 0


def test_spoken_preprocessing_and_unknown_columns(spark):
    import pytest

    from tablens.errors import ConfigurationError
    from tablens.plans.tasks import run_tasks

    df = spark.createDataFrame([("a", 1.0), (None, 2.0), ("b", None)], "k string, v double")
    tasks = [
        {"name": "bar", "plot_type": "bar", "columns": ["k", "v"], "preprocessing": "dropna"},
        {"name": "lost", "plot_type": "bar", "columns": ["nope"]},
    ]
    with pytest.warns(UserWarning, match="lost"):
        got = run_tasks(df, tasks)
    assert list(got) == ["bar"] and [r.category for r in got["bar"].collect()] == ["a"]
    with pytest.raises(ConfigurationError):
        run_tasks(df, [{"name": "x", "plot_type": "bar", "columns": ["k"], "preprocessing": "make it nice"}])


def test_one_bad_task_does_not_stop_the_others(sales):
    from tablens.plans.tasks import run_tasks

    tasks = [
        {"name": "odd", "plot_type": "pie", "columns": ["product"]},
        {"name": "grouped", "plot_type": "bar", "columns": ["product", "sales"], "preprocessing": "filter, groupby, dropna"},
        {"name": "broken", "plot_type": "table", "columns": ["sales"], "preprocessing": [{"filter": "no_such_column > 1"}]},
        {"name": "flat", "plot_type": "scatter", "columns": ["product", "sales"]},
    ]
    with pytest.warns(UserWarning) as told:
        got = run_tasks(sales, tasks)
    assert list(got) == ["grouped"] and got["grouped"].count() == 3
    assert {w for w in ("odd", "broken", "flat") if any(f"task {w} " in str(x.message) for x in told)} == {"odd", "broken", "flat"}


def test_several_value_columns(spark):
    from tablens.plans.tasks import run_tasks

    df = spark.createDataFrame([("a", 1.0, 10), ("a", 3.0, None), ("b", None, 30)], "k string, v double, w int")
    got = run_tasks(df, [{"name": "x", "plot_type": "bar", "columns": ["k", "v", "w"], "aggregate": "sum"}])["x"]
    assert sorted(tuple(r) for r in got.select("category", "column_name", "value").collect()) == [("a", "v", 4.0), ("a", "w", 10.0), ("b", "w", 30.0)]
    days = spark.sql("select timestamp '2024-01-01' + make_interval(0, 0, 0, cast(id as int)) as day, double(id) as v, 2 * id as w from range(20)")
    lines = run_tasks(days, [{"name": "x", "plot_type": "line", "columns": ["day", "v", "w"]}])["x"]
    assert {r["column_name"] for r in lines.collect()} == {"v", "w"}
