"""The numbers behind the usual charts; every result is bounded by the chart, not the data."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bins import histogram_bin
from ..functions.text import shorten_label
from .columns import (
    as_number,
    as_text,
    categorical_columns,
    collect_metrics,
    datetime_columns,
    metrics_by_name,
    numeric_columns,
    quoted,
    union_all,
)
from .frequencies import bounded_counts, value_counts
from .indexes import detect_index_columns
from .kruskal import kruskal_ranking
from .quantiles import quantiles
from .sampling import random_sample
from .summary import FENCE, most_extreme_column, top_variance_columns

BAND = 0.03


# ---- histogram and density -----------------------------------------------------------

def finite(value: Column) -> Column:
    """Infinite values as null: they have no bin."""
    return F.when(F.abs(value) < float("inf"), value)


def _histogram(df: DataFrame, values: dict[str, Column], bins: int) -> DataFrame:
    names = list(values)
    limits = collect_metrics(
        df, names, {"low": lambda c: F.min(finite(values[c])), "high": lambda c: F.max(finite(values[c]))}
    )
    names = [c for c in names if limits[c]["low"] is not None]
    if not names:
        return df.sparkSession.createDataFrame(
            [], "column_name string, bin int, bin_low double, bin_high double, n bigint"
        )
    record = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.when(
                finite(values[c]).isNotNull(),
                histogram_bin(values[c], F.lit(limits[c]["low"]), F.lit(limits[c]["high"]), bins),
            ).alias("bin"),
        )
        for c in names
    ]
    counts = (
        df.select(F.inline(F.array(*record)))
        .where(F.col("bin").isNotNull())
        .groupBy("column_name", "bin")
        .agg(F.count("*").alias("n"))
    )
    frame = union_all(
        [
            df.sparkSession.range(1, bins + 1).select(
                F.lit(c).alias("column_name"),
                F.col("id").cast("int").alias("bin"),
                (F.lit(limits[c]["low"]) + (F.col("id") - 1) * F.lit((limits[c]["high"] - limits[c]["low"]) / bins)).alias("bin_low"),
                (F.lit(limits[c]["low"]) + F.col("id") * F.lit((limits[c]["high"] - limits[c]["low"]) / bins)).alias("bin_high"),
            )
            for c in names
        ]
    )
    return frame.join(F.broadcast(counts), ["column_name", "bin"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 25) -> DataFrame:
    """``(column_name, bin, bin_low, bin_high, n)``, empty bins included, last bin closed."""
    return _histogram(df, {c: as_number(df, c) for c in columns}, bins)


def variance_histograms(
    df: DataFrame, top_n: int = 2, bins: int = 25, columns: Sequence[str] | None = None
) -> DataFrame:
    """Histograms of the columns of largest variance, by default among all but index columns."""
    if columns is None:
        columns = numeric_columns(df, detect_index_columns(df))
    top = [r["column_name"] for r in top_variance_columns(df, top_n, columns).collect()]
    return histogram(df, top, bins)


def kde_curve(df: DataFrame, column: str, grid: int = 200, cells: int = 1024) -> DataFrame:
    """``(x, density)``: Gaussian kernel density (Scott bandwidth) on an even grid.

    Values are first summed into ``cells`` equal cells, each standing at the mean of its
    values, so the cost of the curve does not depend on the number of rows. With
    at most ``cells`` distinct values, evenly spread, the result is the exact density.
    """
    value = as_number(df, column)
    facts = collect_metrics(
        df,
        [column],
        {
            "n": lambda c: F.count(value),
            "low": lambda c: F.min(value),
            "high": lambda c: F.max(value),
            "std": lambda c: F.stddev_samp(value),
        },
    )[column]
    n, low, high, std = facts["n"], facts["low"], facts["high"], facts["std"]
    if not n or n < 2 or not std:
        return df.sparkSession.createDataFrame([], "x double, density double")
    width = std * n ** (-1.0 / 5.0)
    cell_rows = (
        df.select(value.alias("v"))
        .where(F.col("v").isNotNull())
        .groupBy(histogram_bin(F.col("v"), F.lit(low), F.lit(high), cells).alias("cell"))
        .agg(F.count("*").cast("double").alias("w"), F.avg("v").alias("at"))
    )
    # at most `cells` records in one array
    packed = cell_rows.agg(F.sort_array(F.collect_list(F.struct("at", "w"))).alias("cells"))
    step = (high - low) / (grid - 1)
    points = F.sequence(F.lit(0), F.lit(grid - 1))

    def density(i: Column) -> Column:
        x = F.lit(low) + i * F.lit(step)
        return F.struct(
            x.alias("x"),
            F.aggregate(
                "cells",
                F.lit(0.0),
                lambda acc, c: acc
                + c["w"] * F.exp(-0.5 * F.pow((x - c["at"]) / F.lit(width), F.lit(2.0))),
                lambda acc: acc / F.lit(n * width * math.sqrt(2.0 * math.pi)),
            ).alias("density"),
        )

    return packed.select(F.inline(F.transform(points, density)))


# ---- categories ----------------------------------------------------------------------

def top_categories(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    top_k: int = 5,
    max_unique: int = 50,
    max_label: int = 40,
    first_columns: int = 2,
) -> DataFrame:
    """``(column_name, label, n, place)``: most frequent values of low-cardinality columns.

    Ordered by count, then value. Labels are cut when the longest of a column is too long.
    """
    names = list(columns or categorical_columns(df)[:first_columns])
    sizes = bounded_counts(df, names, max_unique)
    names = [c for c in names if 0 < sizes[c] <= max_unique]
    if not names:
        return df.sparkSession.createDataFrame(
            [], "column_name string, label string, n bigint, place int"
        )
    counts = value_counts(df, names)
    place = F.row_number().over(
        W.partitionBy("column_name").orderBy(F.desc("n"), F.asc_nulls_last("value"))
    )
    top = counts.withColumn("place", place).where(F.col("place") <= top_k)
    longest = F.max(F.char_length("value")).over(W.partitionBy("column_name"))
    return top.select(
        "column_name",
        shorten_label(F.coalesce("value", F.lit("null")), longest, max_label).alias("label"),
        "n",
        "place",
    )


# ---- time ----------------------------------------------------------------------------

def time_series_mean(
    df: DataFrame, time_column: str, value_column: str, bucket: str | None = None
) -> DataFrame:
    """``(at, mean_value, band_low, band_high)`` per timestamp, or per ``date_trunc`` bucket."""
    at = quoted(time_column)
    if bucket:
        at = F.date_trunc(bucket, at).cast("timestamp_ntz")
    mean = F.avg(as_number(df, value_column))
    return (
        df.groupBy(at.alias("at"))
        .agg(mean.alias("mean_value"))
        .select(
            "at",
            "mean_value",
            (F.col("mean_value") * (1 - BAND)).alias("band_low"),
            (F.col("mean_value") * (1 + BAND)).alias("band_high"),
        )
        .orderBy("at")
    )


def time_series_charts(
    df: DataFrame,
    first_columns: int = 2,
    bucket: str | None = None,
    numeric: Sequence[str] | None = None,
) -> DataFrame:
    """The numeric column of largest variance over each of the first datetime columns.

    By default all numeric columns but index columns compete.
    """
    times = datetime_columns(df)[:first_columns]
    if numeric is None and times:
        numeric = numeric_columns(df, detect_index_columns(df))
    best = top_variance_columns(df, 1, numeric).first() if times else None
    if best is None:
        return df.sparkSession.createDataFrame(
            [],
            "time_column string, value_column string, at timestamp_ntz, mean_value double, band_low double, band_high double",
        )
    return union_all(
        [
            time_series_mean(df, t, best["column_name"], bucket).select(
                F.lit(t).alias("time_column"),
                F.lit(best["column_name"]).alias("value_column"),
                F.col("at").cast("timestamp_ntz").alias("at"),
                "mean_value",
                "band_low",
                "band_high",
            )
            for t in times
        ]
    )


# ---- boxes ---------------------------------------------------------------------------

def box_stats(
    df: DataFrame, category: str, column: str, max_categories: int = 10
) -> DataFrame:
    """``(category, n, q1, median, q3, whisker_low, whisker_high, fliers)`` per category value.

    Quartiles interpolate linearly; whiskers end at the furthest value within 1.5
    interquartile ranges. Categories with more than ``max_categories`` values give no rows.
    """
    label = as_text(df, category)
    value = as_number(df, column)
    rows = df.select(label.alias("category"), value.alias("value")).na.drop()
    few = bounded_counts(rows, ["category"], max_categories)["category"] <= max_categories
    found = rows.select("category").distinct().collect() if few else []
    if not found:
        return df.sparkSession.createDataFrame(
            [],
            "category string, n bigint, q1 double, median double, q3 double, whisker_low double, whisker_high double, fliers bigint",
        )
    names = sorted(r["category"] for r in found)
    values = {c: F.when(F.col("category") == c, F.col("value")) for c in names}
    return _boxes(rows, values).withColumnRenamed("column_name", "category")


def _boxes(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Box statistics of each expression, from its exact quartiles and one more aggregate."""
    marks = quantiles(rows, values, (0.25, 0.5, 0.75), "linear")
    names = [c for c in values if marks[c][0] is not None]
    if not names:
        return rows.sparkSession.createDataFrame(
            [],
            "column_name string, n bigint, q1 double, median double, q3 double, whisker_low double, whisker_high double, fliers bigint",
        )
    limits = {
        c: (
            marks[c][0] - FENCE * (marks[c][2] - marks[c][0]),
            marks[c][2] + FENCE * (marks[c][2] - marks[c][0]),
        )
        for c in names
    }

    def inside(c: str) -> Column:
        return values[c].between(F.lit(limits[c][0]), F.lit(limits[c][1]))

    return metrics_by_name(
        rows,
        names,
        {
            "n": lambda c: F.count(values[c]),
            "q1": lambda c: F.first(F.lit(marks[c][0])),
            "median": lambda c: F.first(F.lit(marks[c][1])),
            "q3": lambda c: F.first(F.lit(marks[c][2])),
            "whisker_low": lambda c: F.min(F.when(inside(c), values[c])),
            "whisker_high": lambda c: F.max(F.when(inside(c), values[c])),
            "fliers": lambda c: F.count_if(~inside(c)),
        },
    )


def category_boxes(
    df: DataFrame,
    categories: Sequence[str] | None = None,
    columns: Sequence[str] | None = None,
    max_categories: int = 10,
    top_n: int = 2,
) -> DataFrame:
    """Boxes of the numeric columns most associated with each small categorical column."""
    names = list(categories or categorical_columns(df)[:2])
    sizes = bounded_counts(df, names, max_categories)
    pairs = [
        (category, row["column_name"])
        for category in names
        if sizes[category] <= max_categories
        for row in kruskal_ranking(df, category, columns or numeric_columns(df), top_n).collect()
    ]
    # the boxes of all pairs share their passes: one expression per pair and category value
    labels = {c: as_text(df, c) for c, _ in pairs}
    found = df.select(*[F.collect_set(x).alias(f"l{i}") for i, x in enumerate(labels.values())]).first() if pairs else []
    values = {}
    named = []
    for category, column in pairs:
        for label in sorted(found[list(labels).index(category)]):
            key = str(len(named))
            named.append((key, category, column, label))
            values[key] = F.when(labels[category] == label, as_number(df, column))
    boxes = _boxes(df, values)
    table = df.sparkSession.createDataFrame(named, "column_name string, category_column string, value_column string, category string")
    return boxes.join(F.broadcast(table), "column_name").select(
        "category_column", "value_column", "category", *[c for c in boxes.columns if c != "column_name"]
    )


# ---- the most extreme column ---------------------------------------------------------

def extreme_column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, DataFrame] | None:
    """``{"box", "histogram"}`` of the most extreme column, ``log1p`` taken when it is heavy-tailed.

    The log applies when ``|skew| > 1`` or ``|kurtosis| > 5`` and no value is negative.
    """
    extreme = most_extreme_column(df, columns).first()
    if extreme is None:
        return None
    name = extreme["column_name"]
    value = as_number(df, name)
    heavy = abs(extreme["skewness"]) > 1 or abs(extreme["kurtosis"]) > 5
    low = df.agg(F.min(value).alias("low")).first()["low"]
    log_scale = heavy and low is not None and low >= 0
    shown = {name: F.log1p(value) if log_scale else value}
    flag = F.lit(bool(log_scale)).alias("log_scale")
    return {
        "box": _boxes(df, shown).select("*", flag),
        "histogram": _histogram(df, shown, 25).select("*", flag),
    }


# ---- scatter and regression ----------------------------------------------------------

def scatter_points(
    df: DataFrame, x: str, y: str, max_points: int = 1000, key: Sequence[str] | None = None
) -> DataFrame:
    """A repeatable random sample of complete ``(x, y)`` points."""
    complete = df.where(as_number(df, x).isNotNull() & as_number(df, y).isNotNull())
    return random_sample(complete, max_points, key).select(
        as_number(df, x).alias("x"), as_number(df, y).alias("y")
    )


def regression_lines(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``(x_column, y_column, slope, intercept, r2, n)`` least-squares line of each pair."""
    values = {c: as_number(df, c) for pair in pairs for c in pair}
    aggregates, rows = [], []
    for i, (a, b) in enumerate(pairs):
        x, y = values[a], values[b]
        x = F.when(y.isNotNull(), x)
        y = F.when(x.isNotNull(), y)
        aggregates += [
            F.avg(x).alias(f"mx{i}"), F.avg(y).alias(f"my{i}"),
            F.var_pop(x).alias(f"vx{i}"), F.var_pop(y).alias(f"vy{i}"),
            F.covar_pop(x, y).alias(f"c{i}"), F.count(x).alias(f"n{i}"),
        ]
        slope = F.try_divide(f"c{i}", f"vx{i}")
        rows.append(
            F.struct(
                F.lit(a).alias("x_column"),
                F.lit(b).alias("y_column"),
                slope.alias("slope"),
                (F.col(f"my{i}") - slope * F.col(f"mx{i}")).alias("intercept"),
                F.try_divide(
                    F.col(f"c{i}") * F.col(f"c{i}"), F.col(f"vx{i}") * F.col(f"vy{i}")
                ).alias("r2"),
                F.col(f"n{i}").alias("n"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def regression_band(
    df: DataFrame,
    x: str,
    y: str,
    replicates: int = 1000,
    blocks: int = 1024,
    grid: int = 100,
    level: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """``(x, fitted, band_low, band_high)``: bootstrap confidence band of the regression line.

    Rows are dealt into random blocks whose sums are resampled with Poisson(1) weights, so the
    table is read once and the resampling works on ``blocks`` records whatever its size.
    """
    vx, vy = as_number(df, x), as_number(df, y)
    rows = df.select(vx.alias("x"), vy.alias("y")).na.drop()
    centre = rows.agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    empty = "x double, fitted double, band_low double, band_high double"
    if centre["x"] is None or centre["lo"] == centre["hi"]:
        return df.sparkSession.createDataFrame([], empty)
    dx, dy = F.col("x") - F.lit(centre["x"]), F.col("y") - F.lit(centre["y"])
    sums = (
        rows.withColumn("block", F.floor(F.rand(seed) * blocks).cast("int"))
        .groupBy("block")
        .agg(
            F.count("*").alias("n"), F.sum(dx).alias("sx"), F.sum(dy).alias("sy"),
            F.sum(dx * dx).alias("sxx"), F.sum(dx * dy).alias("sxy"),
        )
    )
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "block", "replicate"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    weight = F.lit(0)
    total = 0.0
    for k in range(12):  # Poisson(1) by inversion of its distribution function
        total += math.exp(-1.0) / math.factorial(k)
        weight = weight + (uniform > F.lit(total)).cast("int")
    drawn = sums.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("replicate")
    ).withColumn("w", F.when(F.col("replicate") == 0, F.lit(1)).otherwise(weight))
    fitted = drawn.groupBy("replicate").agg(
        *[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")]
    )
    slope = F.try_divide(
        F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"),
        F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"),
    )
    lines = fitted.select(
        "replicate", slope.alias("slope"),
        (F.try_divide("sy", "n") - slope * F.try_divide("sx", "n")).alias("level"),
    )
    step = (centre["hi"] - centre["lo"]) / (grid - 1)
    curve = lines.select(
        "replicate", "slope", "level",
        F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i"),
    ).select(
        "replicate",
        (F.lit(centre["lo"]) + F.col("i") * F.lit(step)).alias("x"),
        "slope", "level",
    ).withColumn(
        "at", F.lit(centre["y"]) + F.col("level") + F.col("slope") * (F.col("x") - F.lit(centre["x"]))
    )
    tail = (1 - level) / 2
    sampled = F.when(F.col("replicate") > 0, F.col("at"))
    return curve.groupBy("x").agg(
        F.max(F.when(F.col("replicate") == 0, F.col("at"))).alias("fitted"),
        F.percentile(sampled, F.lit(tail)).alias("band_low"),
        F.percentile(sampled, F.lit(1 - tail)).alias("band_high"),
    )
