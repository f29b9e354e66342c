"""Analysis tasks given as data: ``{name, columns, plot_type, preprocessing, …}``."""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from ..functions.values import to_double_lenient
from ..operators import charts
from ..operators.columns import as_number, as_text, datetime_columns, numeric_columns, quoted, union_all
from ..operators.correlation import heatmap_cells
from ..operators.summary import describe_numeric

PLOT_TYPES = ("histogram", "line", "bar", "scatter", "box", "heatmap", "table", "summary_stat")
_AGGREGATES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


@dataclass(frozen=True)
class Task:
    """One analysis. ``preprocessing`` steps run in order:

    ``{"coerce": [columns]}``, ``{"dropna": [columns]}``, ``{"filter": "SQL predicate"}``,
    ``{"groupby": [columns], "agg": {column: function}}`` and
    ``{"pivot": {"index": c, "columns": c, "values": c}}`` (mean of values).
    """

    name: str
    plot_type: str
    columns: tuple[str, ...]
    preprocessing: tuple[Mapping, ...] = ()
    aggregate: str = "mean"
    options: Mapping = field(default_factory=dict)
    description: str = ""

    @staticmethod
    def of(spec: Mapping) -> Task:
        plot = spec.get("plot_type") or spec.get("chart_type")
        if plot not in PLOT_TYPES:
            raise ConfigurationError(f"unknown plot type {plot!r}; known: {', '.join(PLOT_TYPES)}")
        steps = spec.get("preprocessing") or ()
        if isinstance(steps, str):
            steps = _spoken_steps(steps, tuple(spec.get("columns", ())))
        elif isinstance(steps, Mapping):
            steps = (steps,)
        return Task(
            name=spec["name"],
            plot_type=plot,
            columns=tuple(spec.get("columns", ())),
            preprocessing=tuple(steps),
            aggregate=spec.get("aggregate", "mean"),
            options=dict(spec.get("options", {})),
            description=spec.get("description", ""),
        )


def run_tasks(df: DataFrame, tasks: str | Sequence[Mapping | Task]) -> dict[str, DataFrame]:
    """One result per task, over the whole table. Accepts records or a JSON plan.

    A task that can't be built (unknown plot, step, function or columns, a predicate that doesn't
    parse, no column of the needed type) is skipped with a warning; the others run. If none is
    left, the first error is raised, unless the only trouble was that columns are unknown.
    """
    if isinstance(tasks, str):
        plan = json.loads(tasks)
        tasks = plan["tasks"] if isinstance(plan, dict) else plan
    results = {}
    errors: list[Exception] = []
    for spec in tasks:
        name = spec.name if isinstance(spec, Task) else spec.get("name", "without a name")
        try:
            task = spec if isinstance(spec, Task) else Task.of(spec)
            results[task.name] = run_task(df, task)
        except (ConfigurationError, AnalysisException, LookupError) as error:
            warnings.warn(f"task {name} is skipped: {error}", stacklevel=2)
            if not isinstance(error, UnknownColumnsError):
                errors.append(error)
    if errors and not results:
        raise errors[0]
    return results


def _spoken_steps(words: str, columns: tuple[str, ...]) -> tuple[Mapping, ...]:
    """Steps named in plain words, over the task's columns.

    ``groupby`` says what grouped plots do anyway, and ``filter`` names no predicate: both change nothing.
    """
    steps: list[Mapping] = []
    for word in filter(None, (w.strip().lower() for w in re.split(r"[,;]", words))):
        if word in ("dropna", "drop nulls", "drop missing values"):
            steps.append({"dropna": columns})
        elif word in ("coerce", "dtype conversion", "to numeric"):
            steps.append({"coerce": columns})
        elif word == "filter":
            warnings.warn("the word filter gives no predicate; all rows are kept", stacklevel=3)
        elif word not in ("none", "groupby", "group by"):
            raise ConfigurationError(f"unknown preprocessing {word!r}; known: dropna, coerce, dtype conversion, groupby, filter")
    return tuple(steps)


class UnknownColumnsError(ConfigurationError):
    """None of a task's columns is in the table."""


def run_task(df: DataFrame, task: Task) -> DataFrame:
    """Preprocess, then build the task's chart data. Columns that do not exist are skipped."""
    for step in task.preprocessing:
        df = _apply(df, step)
    columns = [c for c in task.columns if c in df.columns]
    if task.columns and not columns:
        raise UnknownColumnsError(f"no column {', '.join(task.columns)}")
    return _PLOTS[task.plot_type](df, columns or list(df.columns), task)


def _known(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns to double; values that are not numbers become null."""
    texts = {n for n, t in df.dtypes if t == "string"}
    return df.withColumns(
        {
            c: to_double_lenient(quoted(c)) if c in texts else quoted(c).cast("double")
            for c in _known(df, columns)
        }
    )


def dropna_listwise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=_known(df, columns) or None)


def group_aggregate(df: DataFrame, by: Sequence[str], measures: Mapping[str, str]) -> DataFrame:
    """``<column>_<function>`` per group."""
    unknown = sorted(set(measures.values()) - set(_AGGREGATES))
    if unknown:
        raise ConfigurationError(f"unknown aggregate functions {unknown}")
    return df.groupBy(*[quoted(c) for c in _known(df, by)]).agg(
        *[
            _AGGREGATES[f](quoted(c)).alias(f"{c}_{f}")
            for c, f in measures.items()
            if c in df.columns
        ]
    )


def pivot_mean(df: DataFrame, index: str, columns: str, values: str, limit: int = 1000) -> DataFrame:
    """Mean of ``values`` per ``index`` row and one column per value of ``columns``."""
    label = as_text(df, columns)
    found = df.select(label.alias("v")).where(F.col("v").isNotNull()).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ConfigurationError(f"column {columns} has more than {limit} values to pivot on")
    return (
        df.select(quoted(index), label.alias("__label"), quoted(values).alias("__value"))
        .groupBy(quoted(index))
        .pivot("__label", sorted(r["v"] for r in found))
        .agg(F.avg("__value"))
    )


def _apply(df: DataFrame, step: Mapping) -> DataFrame:
    if "coerce" in step:
        return coerce_numeric(df, step["coerce"])
    if "dropna" in step:
        return dropna_listwise(df, step["dropna"])
    if "filter" in step:
        return df.where(F.expr(step["filter"]))
    if "groupby" in step:
        return group_aggregate(df, step["groupby"], step["agg"])
    if "pivot" in step:
        return pivot_mean(df, **step["pivot"])
    raise ConfigurationError(f"unknown preprocessing step {sorted(step)}")


def _numbers(df: DataFrame, columns: Sequence[str]) -> list[str]:
    numeric = set(numeric_columns(df))
    return [c for c in columns if c in numeric]


def _histogram(df, columns, task):
    return charts.histogram(df, _numbers(df, columns), task.options.get("bins", 25))


def _line(df, columns, task):
    """Means over time; several value columns give rows of their own, named by ``column_name``."""
    times = [c for c in columns if c in set(datetime_columns(df))] or columns[:1]
    values = [c for c in _numbers(df, columns) if c != times[0]]
    if not values:
        raise ConfigurationError("a line needs a numeric column")
    lines = [charts.time_series_mean(df, times[0], value, task.options.get("bucket")) for value in values]
    if len(lines) == 1:
        return lines[0]
    return union_all([line.withColumn("column_name", F.lit(value)) for line, value in zip(lines, values)])


def _bar(df, columns, task):
    """Counts per category, or an aggregate of each numeric column per category.

    Several numeric columns give rows of their own, named by ``column_name``.
    """
    if task.aggregate not in _AGGREGATES:
        raise ConfigurationError(f"unknown aggregate function {task.aggregate}")
    category = as_text(df, columns[0]).alias("category")
    numbers = _numbers(df, columns[1:])
    if not numbers:
        return df.groupBy(category).agg(F.count("*").alias("value"))
    cells = [x for n in numbers for x in (F.lit(n), as_number(df, n))]
    bars = df.select(category, F.stack(F.lit(len(numbers)), *cells).alias("column_name", "value")).where("value is not null")
    keys = ["category"] if len(numbers) == 1 else ["category", "column_name"]
    return bars.groupBy(*keys).agg(_AGGREGATES[task.aggregate](F.col("value")).alias("value"))


def _scatter(df, columns, task):
    numbers = _numbers(df, columns)
    if len(numbers) < 2:
        raise ConfigurationError("a scatter plot needs two numeric columns")
    x, y = numbers[:2]
    return charts.scatter_points(df, x, y, task.options.get("max_points", 1000), task.options.get("key"))


def _box(df, columns, task):
    numbers = _numbers(df, columns)
    category = next((c for c in columns if c not in numbers), None)
    if category is None or not numbers:
        raise ConfigurationError("a box needs a category and a numeric column")
    return charts.box_stats(df, category, numbers[0], task.options.get("max_categories", 10))


def _heatmap(df, columns, task):
    return heatmap_cells(df, _numbers(df, columns))


def _table(df, columns, task):
    return df.select(*[quoted(c) for c in columns])


def _summary(df, columns, task):
    return describe_numeric(df, _numbers(df, columns))


_PLOTS = {
    "histogram": _histogram, "line": _line, "bar": _bar, "scatter": _scatter, "box": _box,
    "heatmap": _heatmap, "table": _table, "summary_stat": _summary,
}
