"""Column roles, and the one-pass "many columns, one aggregate" helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# This many aggregate expressions are planned together: beyond it the generated code is too
# large for the JVM to compile well. Every pass reads only its own columns.
AGGREGATES_PER_PASS = 60

# Tables estimated below this size are dealt out to all cores before CPU-heavy work.
SPREAD_BELOW_BYTES = 256 * 1024**2

# Texts longer than this stand as their SHA-256 where only equality counts.
SHORT = 64

Metric = Callable[[str], Column]


def quoted(name: str) -> Column:
    """A column by its literal name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType))


def columns_where(df: DataFrame, test: Callable[[T.DataType], bool], skip: Iterable[str] = ()) -> list[str]:
    skipped = set(skip)
    return [f.name for f in df.schema.fields if test(f.dataType) and f.name not in skipped]


def numeric_columns(df: DataFrame, skip: Iterable[str] = ()) -> list[str]:
    return columns_where(df, is_numeric, skip)


def categorical_columns(df: DataFrame, skip: Iterable[str] = ()) -> list[str]:
    return columns_where(
        df, lambda t: isinstance(t, (T.StringType, T.BooleanType)), skip
    )


def datetime_columns(df: DataFrame, skip: Iterable[str] = ()) -> list[str]:
    return columns_where(df, is_datetime, skip)


def as_number(df: DataFrame, name: str) -> Column:
    """The column as double, with NaN read as missing."""
    value = quoted(name).cast("double")
    if is_floating(df.schema[name].dataType):
        return F.when(~F.isnan(value), value)
    return value


def as_text(df: DataFrame, name: str) -> Column:
    """The column as text fit for grouping and equality (nested values as JSON)."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(quoted(name))))
    if isinstance(dtype, (T.ArrayType, T.StructType)):
        return F.to_json(quoted(name))
    if isinstance(dtype, T.BinaryType):
        return F.base64(quoted(name))
    return quoted(name).cast("string")


def short_form(text: Column) -> Column:
    """Stands for the text where only equality counts: long texts become their SHA-256."""
    return F.when(F.length(text) > SHORT, F.sha2(text, 256)).otherwise(text)


def chunks(items: Sequence, size: int) -> list[Sequence]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def metrics_by_name(
    df: DataFrame,
    names: Sequence[str],
    metrics: dict[str, Metric],
    label: str = "column_name",
) -> DataFrame:
    """One row per name with one field per metric, from one aggregate over ``df``.

    ``metrics`` maps a field to a function from name to aggregate expression. The single
    aggregate row is turned into rows without another shuffle.
    """
    parts = []
    for group in chunks(names, max(1, AGGREGATES_PER_PASS // len(metrics))):
        aggregated = df.agg(
            *[
                metric(name).alias(f"m{i}_{field}")
                for i, name in enumerate(group)
                for field, metric in metrics.items()
            ]
        )
        rows = [
            F.struct(
                F.lit(name).alias(label),
                *[F.col(f"m{i}_{field}").alias(field) for field in metrics],
            )
            for i, name in enumerate(group)
        ]
        parts.append(aggregated.select(F.inline(F.array(*rows))))
    return union_all(parts)


def collect_metrics(
    df: DataFrame, names: Sequence[str], metrics: dict[str, Metric]
) -> dict[str, dict]:
    """``metrics_by_name`` as a dictionary: one small record per column."""
    if not names:
        return {}
    rows = metrics_by_name(df, names, metrics).collect()
    return {r["column_name"]: {m: r[m] for m in metrics} for r in rows}


def values_long(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(column_name, value)`` with every listed column as text, one row per cell."""
    return df.select(*[as_text(df, n).alias(n) for n in names]).unpivot(
        [], [quoted(n) for n in names], "column_name", "value"
    )


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a *small* table out to all cores before CPU-heavy work.

    A small file is often one row group, hence one task. Large tables come in many splits and
    are left as they are, so this never shuffles a table that is large.
    """
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    if int(str(estimate)) >= SPREAD_BELOW_BYTES or not plain:
        return df
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks, F.xxhash64(*[quoted(c) for c in plain]))
