"""Value counts and the checks that rest on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .columns import (
    as_text,
    categorical_columns,
    metrics_by_name,
    numeric_columns,
    short_form,
    values_long,
)

# Items the frequent-items sketch keeps per column. A value is certain to be among them when
# its share exceeds ~4 / (0.75 * items); shares below CERTAIN_SHARE take the exact-count path.
_SKETCH_ITEMS = 1000
CERTAIN_SHARE = 0.02


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column_name, value, n)``: occurrences of every value, null included.

    All columns share one shuffle, and equal values are combined before it, so a value that
    fills a third of the table costs one record per task.
    """
    names = list(columns or df.columns)
    return values_long(df, names).groupBy("column_name", "value").agg(
        F.count("*").alias("n")
    )


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, n_unique, n_values)``: distinct values with and without null.

    Long texts are told apart by their SHA-256, so that only digests are shuffled.
    """
    cells = values_long(df, columns).select("column_name", short_form(F.col("value")).alias("value"))
    return (
        cells.distinct()
        .groupBy("column_name")
        .agg(F.count("*").alias("n_unique"), F.count("value").alias("n_values"))
    )


def bounded_counts(df: DataFrame, columns: Sequence[str], limit: int) -> dict[str, int]:
    """Distinct values per column, null included: exact up to ``limit``, else approximate.

    A sketch (one scan, no shuffle of values) first sorts out the columns far above the limit,
    so that only small sets of values are ever shuffled.
    """
    if not columns:
        return {}
    found = metrics_by_name(
        df, columns, {"n": lambda c: F.approx_count_distinct(as_text(df, c), 0.02)}
    )
    counts = {r["column_name"]: r["n"] for r in found.collect()}
    exact = [c for c in columns if counts[c] <= 2 * limit + 10]
    if exact:
        counts |= {r["column_name"]: r["n_unique"] for r in distinct_counts(df, exact).collect()}
    return counts


def constant_columns(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(column_name, top_share)`` of columns where one value (or null) has that share.

    Two scans and no shuffle of values: a frequent-items sketch names the only value that can
    reach the threshold, then one aggregate counts exactly that value.
    """
    if threshold < CERTAIN_SHARE:
        top = value_counts(df).groupBy("column_name").agg(
            F.max("n").alias("top"), F.sum("n").alias("total")
        )
    else:
        texts = {name: short_form(as_text(df, name)) for name in df.columns}
        sketch = metrics_by_name(
            df,
            df.columns,
            {"top": lambda c: _top_item(texts[c]), "total": lambda c: F.count("*")},
        )
        # the sketch never counts an item too low: only columns that can qualify come back
        likely = sketch.where(F.col("top")["count"] >= F.col("total") * threshold)
        best = {r["column_name"]: r["top"]["item"] for r in likely.collect()}
        if not best:
            return df.sparkSession.createDataFrame([], "column_name string, top_share double")
        top = metrics_by_name(
            df,
            list(best),
            {
                "top": lambda c: F.count_if(texts[c].eqNullSafe(F.lit(best[c]))),
                "total": lambda c: F.count("*"),
            },
        )
    share = F.try_divide(F.col("top"), F.col("total"))
    return top.where(share >= threshold).select(
        "column_name", F.round(share, 3).alias("top_share")
    )


def _top_item(text):
    found = F.call_function("approx_top_k", text, F.lit(1), F.lit(_SKETCH_ITEMS))
    return F.get(found, F.lit(0))


def near_zero_variance(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    freq_cut: float = 20.0,
    unique_cut: float = 10.0,
    skip: Sequence[str] = (),
) -> DataFrame:
    """Columns whose top value dwarfs the second, or with few distinct values per row.

    Ties for the most common value go to the smallest text (for long texts: digest). Ranking
    keeps two counts per column and task before anything is shuffled for it.
    """
    names = list(columns or numeric_columns(df, skip) + categorical_columns(df, skip))
    if not names:
        return df.sparkSession.createDataFrame([], _NZV_SCHEMA)
    counts = (
        values_long(df, names)
        .select("column_name", short_form(F.col("value")).alias("value"))
        .groupBy("column_name", "value")
        .agg(F.count("*").alias("n"))
    )
    ranked = counts.withColumn(
        "place",
        F.row_number().over(
            W.partitionBy("column_name").orderBy(F.desc("n"), F.asc_nulls_last("value"))
        ),
    ).where("place <= 2")
    top = ranked.groupBy("column_name").agg(
        F.max(F.when(F.col("place") == 1, F.col("n"))).alias("most"),
        F.max(F.when(F.col("place") == 2, F.col("n"))).alias("second"),
        F.max(F.when(F.col("place") == 1, F.col("value"))).alias("most_common_value"),
    )
    totals = counts.groupBy("column_name").agg(
        F.count("*").alias("n_unique"), F.sum("n").alias("n_rows")
    )
    ratio = F.col("most") / F.col("second")
    percent = F.col("n_unique") / F.col("n_rows") * 100
    flagged = (
        top.join(totals, "column_name")
        .where(F.col("second").isNotNull() & ((ratio > freq_cut) | (percent < unique_cut)))
        .select(
            "column_name",
            F.round(ratio, 3).alias("freq_ratio"),
            F.round(percent, 3).alias("percent_unique"),
            "most_common_value",
        )
        .collect()  # at most one record per column
    )
    digests = {
        r["column_name"]: r["most_common_value"]
        for r in flagged
        if r["most_common_value"] is not None and len(r["most_common_value"]) == 64
    }
    texts = _texts_of(df, digests)
    rows = [
        (*tuple(r)[:3], texts.get(r["column_name"], r["most_common_value"])) for r in flagged
    ]
    return df.sparkSession.createDataFrame(rows, _NZV_SCHEMA)


_NZV_SCHEMA = (
    "column_name string, freq_ratio double, percent_unique double, most_common_value string"
)


def _texts_of(df: DataFrame, digests: dict[str, str]) -> dict[str, str]:
    """The text behind the short form of one value per column."""
    if not digests:
        return {}
    found = metrics_by_name(
        df,
        list(digests),
        {
            "text": lambda c: F.max(
                F.when(short_form(as_text(df, c)) == digests[c], as_text(df, c))
            )
        },
    )
    return {r["column_name"]: r["text"] for r in found.collect()}
