"""Whole-table and per-column summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import (
    as_number,
    as_text,
    metrics_by_name,
    numeric_columns,
    quoted,
)
from .frequencies import distinct_counts
from .quantiles import quantiles

FENCE = 1.5


def dataset_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("num_rows")).withColumn(
        "num_columns", F.lit(len(df.columns))
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """``(duplicated_rows)``: rows minus distinct rows, exactly.

    Only row hashes are shuffled for the whole table. A hash seen once proves its row unique;
    just the rows whose hash occurs again are compared in full.
    """
    cells = df.select(*[as_text_if_unordered(df, c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    hashed = cells.withColumn("h", F.xxhash64(*cells.columns))
    hashes = hashed.groupBy("h").agg(F.count("*").alias("n"))
    repeated = hashes.where("n > 1").select("h")
    distinct_repeated = (
        hashed.join(repeated, "h", "left_semi")
        .groupBy(*cells.columns)
        .agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicated_rows"))
    )
    return distinct_repeated


def as_text_if_unordered(df: DataFrame, name: str):
    """Maps cannot be grouped on; they are compared as sorted JSON."""
    if isinstance(df.schema[name].dataType, T.MapType):
        return as_text(df, name)
    return quoted(name)


def missing_values(df: DataFrame) -> DataFrame:
    """``(column_name, missing_count, missing_pct)``; NaN is a value, not missing."""
    counted = metrics_by_name(
        df,
        df.columns,
        {"missing_count": lambda c: F.count_if(quoted(c).isNull()), "total": lambda c: F.count("*")},
    )
    return counted.select(
        "column_name",
        "missing_count",
        F.round(F.try_divide(F.col("missing_count"), F.col("total")) * 100, 4).alias("missing_pct"),
    )


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, nulls, mean, deviation, minimum, exact quartiles and maximum, at 2 decimals."""
    names = list(columns or numeric_columns(df))
    number = {c: as_number(df, c) for c in names}
    marks = quantiles(df, number, (0.25, 0.5, 0.75))

    def rounded(value):
        return F.round(value, 2)

    return metrics_by_name(
        df,
        names,
        {
            "value_count": lambda c: F.count(quoted(c)),
            "null_count": lambda c: F.count_if(quoted(c).isNull()),
            "mean": lambda c: rounded(F.avg(number[c])),
            "std": lambda c: rounded(F.stddev_samp(number[c])),
            "min": lambda c: rounded(F.min(number[c])),
            "q25": lambda c: rounded(F.first(F.lit(marks[c][0]).cast("double"))),
            "q50": lambda c: rounded(F.first(F.lit(marks[c][1]).cast("double"))),
            "q75": lambda c: rounded(F.first(F.lit(marks[c][2]).cast("double"))),
            "max": lambda c: rounded(F.max(number[c])),
        },
    )


def fences(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Lower and upper outlier fence per column that has any value."""
    number = {c: as_number(df, c) for c in columns}
    result = {}
    for name, (q1, q3) in quantiles(df, number, (0.25, 0.75)).items():
        if q1 is not None:
            spread = FENCE * (q3 - q1)
            result[name] = (q1 - spread, q3 + spread)
    return result


def outside(df: DataFrame, name: str, limits: dict[str, tuple[float, float]]):
    """Strictly outside the fences; null when the value is missing."""
    if name not in limits:
        return F.lit(None).cast("boolean")
    low, high = limits[name]
    value = as_number(df, name)
    return (value < F.lit(low)) | (value > F.lit(high))


def outliers_per_column(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column_name, outliers)``: values strictly beyond 1.5 interquartile ranges."""
    names = list(columns or numeric_columns(df))
    limits = fences(df, names)
    return metrics_by_name(
        df, names, {"outliers": lambda c: F.count_if(outside(df, c, limits))}
    )


def outliers_ranked(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Outlier counts with their place in descending order (ties by column name)."""
    counts = outliers_per_column(df, columns)
    return rank_few(counts, F.desc("outliers"), F.asc("column_name"))


def rank_few(df: DataFrame, *order, name: str = "place") -> DataFrame:
    """Number the rows of a *small* table (one row per column, pair or category).

    The window runs in one task, over as many rows as the table has columns or pairs.
    """
    return df.withColumn(name, F.row_number().over(W.orderBy(*order)).cast("bigint"))


def outlier_rows(df: DataFrame, column: str) -> DataFrame:
    """The rows whose value in ``column`` lies beyond the fences."""
    return df.where(outside(df, column, fences(df, [column])))


def skew_kurtosis(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column_name, skewness, kurtosis, extremeness)``: biased moments, excess kurtosis.

    Constant and empty columns have null moments. Extremeness is ``|skew| * |kurtosis|``.
    """
    names = list(columns or numeric_columns(df))
    number = {c: as_number(df, c) for c in names}
    return metrics_by_name(
        df,
        names,
        {
            "skewness": lambda c: F.skewness(number[c]),
            "kurtosis": lambda c: F.kurtosis(number[c]),
        },
    ).withColumn("extremeness", F.abs("skewness") * F.abs("kurtosis"))


def most_extreme_column(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The single column of largest extremeness (ties by name)."""
    return (
        skew_kurtosis(df, columns)
        .where(F.col("extremeness").isNotNull())
        .orderBy(F.desc("extremeness"), "column_name")
        .limit(1)
    )


def top_variance_columns(
    df: DataFrame, top_n: int = 2, columns: Sequence[str] | None = None
) -> DataFrame:
    """``(column_name, variance)`` of the columns of largest sample variance (null reads as 0)."""
    names = numeric_columns(df) if columns is None else list(columns)
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, variance double")
    return (
        metrics_by_name(
            df,
            names,
            {"variance": lambda c: F.coalesce(F.var_samp(as_number(df, c)), F.lit(0.0))},
        )
        .orderBy(F.desc("variance"), "column_name")
        .limit(top_n)
    )


def column_stats(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Nulls, distinct non-null values and their ratios, mean text length, flags, per column.

    ``approximate=True`` replaces exact distinct counts by a sketch (about 2 % error), which
    saves the only shuffle.
    """
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    per_column = {
        "total": lambda c: F.count("*"),
        "null_values": lambda c: F.count_if(quoted(c).isNull()),
        "mean_length": lambda c: F.avg(F.char_length(quoted(c))) if c in texts else F.first(F.lit(None).cast("double")),
    }
    if approximate:
        per_column["distinct_count"] = lambda c: F.approx_count_distinct(as_text(df, c), 0.02)
        facts = metrics_by_name(df, df.columns, per_column)
    else:
        distinct = distinct_counts(df, df.columns).select(
            "column_name", F.col("n_values").alias("distinct_count")
        )
        facts = metrics_by_name(df, df.columns, per_column).join(
            F.broadcast(distinct), "column_name", "left"
        ).withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)))
    share = F.try_divide(F.col("distinct_count"), F.col("total"))
    return facts.select(
        "column_name",
        "null_values",
        F.col("distinct_count").cast("bigint").alias("distinct_count"),
        F.coalesce(share, F.lit(0.0)).alias("unique_ratio"),
        F.coalesce(F.try_divide(F.col("null_values"), F.col("total")), F.lit(0.0)).alias("missing_ratio"),
        "mean_length",
        (F.col("distinct_count") == 1).alias("is_constant"),
        (F.col("distinct_count") == F.col("total")).alias("is_identifier"),
    )


_WIDTHS = {
    T.BooleanType: 0.125, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8,
    T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
}


def size_estimate(df: DataFrame) -> DataFrame:
    """``(num_rows, memory_mb)``: fixed widths plus text bytes, without object overhead."""
    fixed = 0.0
    variable = []
    for field in df.schema.fields:
        width = _WIDTHS.get(type(field.dataType))
        if width is not None:
            fixed += width
        elif isinstance(field.dataType, T.DecimalType):
            fixed += 16
        else:
            variable.append(
                F.coalesce(F.sum(F.octet_length(as_text(df, field.name))), F.lit(0))
            )
    total = F.count("*") * F.lit(fixed)
    for part in variable:
        total = total + part
    return df.agg(
        F.count("*").alias("num_rows"), F.round(total / F.lit(1024.0**2), 2).alias("memory_mb")
    )
