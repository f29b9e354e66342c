"""A plan of chart tasks derived from the table itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.columns import categorical_columns, datetime_columns, numeric_columns
from ..operators.correlation import strong_correlations
from ..operators.frequencies import bounded_counts
from ..operators.indexes import detect_index_columns
from ..operators.kruskal import kruskal_ranking
from ..operators.summary import top_variance_columns

# fixed values: categories per bar chart and per box chart
BAR_CATEGORIES = 50
BOX_CATEGORIES = 10


def auto_plan(df: DataFrame, skip: Sequence[str] | None = None) -> list[dict]:
    """Tasks for ``run_tasks``: distributions, categories, time lines, boxes, strong pairs."""
    skipped = list(skip) if skip is not None else detect_index_columns(df)
    numeric = numeric_columns(df, skipped)
    categories = categorical_columns(df, skipped)[:2]
    times = datetime_columns(df, skipped)[:2]
    tasks = []

    def add(plot: str, *columns: str) -> None:
        tasks.append({"name": "_".join((plot, *columns)), "plot_type": plot, "columns": list(columns)})

    top = [r["column_name"] for r in top_variance_columns(df, 2, numeric).collect()] if numeric else []
    for c in top:
        add("histogram", c)
    sizes = bounded_counts(df, categories, BAR_CATEGORIES)
    for c in categories:
        if sizes[c] <= BAR_CATEGORIES:
            add("bar", c)
    for t in times if top else []:
        add("line", t, top[0])
    for c in categories if numeric else []:
        if sizes[c] <= BOX_CATEGORIES:
            for row in kruskal_ranking(df, c, numeric).collect():
                add("box", c, row["column_name"])
    if len(numeric) > 1:
        add("heatmap", *numeric)
        for row in strong_correlations(df, numeric).collect():
            add("scatter", row["col_a"], row["col_b"])
    return tasks


def plan_table(df: DataFrame, skip: Sequence[str] | None = None) -> DataFrame:
    """The plan as a table ``(step, name, plot_type, columns)``."""
    tasks = auto_plan(df, skip)
    return df.sparkSession.createDataFrame(
        [(i, t["name"], t["plot_type"], ",".join(t["columns"])) for i, t in enumerate(tasks, 1)],
        "step int, name string, plot_type string, columns string",
    )
