"""Pearson and Spearman correlation over all pairs of numeric columns."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import as_number, chunks, collect_metrics, numeric_columns, spread, union_all
from .order import pairwise_ranks

PAIRS_PER_PASS = 300
_SCHEMA = "col_a string, col_b string, correlation double, n bigint"


def _pair_moments(
    df: DataFrame, values: dict[str, Column], pairs: Sequence[tuple[str, str]]
) -> DataFrame:
    """``(col_a, col_b, correlation, n)`` with nulls removed pair by pair.

    Each row gives one small record per pair, summed within its task before the shuffle, so
    one compact aggregate serves any number of pairs. A pair without spread gives null.
    """
    names = list(values)
    numbers = spread(df.select(*[values[c].alias(f"x{i}") for i, c in enumerate(names)]))
    parts = []
    for group in chunks(pairs, PAIRS_PER_PASS):
        records = [
            cell
            for i, (a, b) in enumerate(group)
            for cell in (F.lit(i), F.col(f"x{names.index(a)}"), F.col(f"x{names.index(b)}"))
        ]
        moments = (
            numbers.select(F.stack(F.lit(len(group)), *records).alias("pair", "x", "y"))
            .where(F.col("x").isNotNull() & F.col("y").isNotNull())
            .groupBy("pair")
            .agg(
                F.covar_pop("x", "y").alias("c"),
                (F.stddev_pop("x") * F.stddev_pop("y")).alias("spread"),
                F.count("*").alias("n"),
            )
        )
        label = F.array(
            *[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b")) for a, b in group]
        )
        correlation = F.when(F.col("spread") > 0, F.try_divide("c", "spread"))
        parts.append(
            moments.select(
                F.element_at(label, F.col("pair") + 1).alias("names"),
                correlation.alias("correlation"),
                "n",
            ).select("names.*", "correlation", "n")
        )
    return union_all(parts)


def corr_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of each unordered pair of non-constant numeric columns, once."""
    names = list(columns or numeric_columns(df))
    values = {c: as_number(df, c) for c in names}
    facts = collect_metrics(df, names, {"std": lambda c: F.stddev_samp(values[c])})
    varying = [c for c in names if (facts[c]["std"] or 0.0) > 0.0]
    pairs = list(combinations(varying, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], _SCHEMA)
    return _pair_moments(df, {c: values[c] for c in varying}, pairs)


def heatmap_cells(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The square matrix in long form: both directions of every pair, and the diagonal."""
    half = corr_matrix(df, columns).where(F.col("correlation").isNotNull())
    cells = F.array(
        F.struct("col_a", "col_b", "correlation"),
        F.struct(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "correlation"),
        F.struct("col_a", F.col("col_a").alias("col_b"), F.lit(1.0).alias("correlation")),
        F.struct(F.col("col_b").alias("col_a"), "col_b", F.lit(1.0).alias("correlation")),
    )
    return half.select(F.inline(cells)).distinct()


def ordered_pair(df: DataFrame) -> DataFrame:
    """Name the pair in alphabetical order."""
    return df.withColumns(
        {"col_a": F.least("col_a", "col_b"), "col_b": F.greatest("col_a", "col_b")}
    )


def strong_correlations(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    threshold: float = 0.8,
    top_n: int = 5,
    compat: bool = False,
) -> DataFrame:
    """``(col_a, col_b, correlation)`` of the strongest pairs above the threshold, 2 decimals.

    ``compat=True`` also drops pairs whose correlation value equals that of an earlier pair.
    """
    strong = ordered_pair(corr_matrix(df, columns)).where(F.abs("correlation") > threshold)
    if compat:
        strong = strong.groupBy("correlation").agg(
            F.min(F.struct("col_a", "col_b")).alias("pair")
        ).select("pair.*", "correlation")
    return (
        strong.orderBy(F.desc(F.abs("correlation")), "col_a", "col_b")
        .limit(top_n)
        .select("col_a", "col_b", F.round("correlation", 2).alias("correlation"))
    )


def spearman_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Spearman correlation per pair: Pearson on average ranks of the pair's complete rows."""
    names = list(columns or numeric_columns(df))
    pairs = list(combinations(names, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], _SCHEMA)
    numbers = {f"c{i}": as_number(df, c) for i, c in enumerate(names)}
    ranks, place = pairwise_ranks(df, numbers)
    own = dict(zip(names, numbers))
    # each side's ranks among the rows that have the other side
    sides = {(a, b): f"{own[a]}_{place[own[b]]}" for pair in pairs for a, b in (pair, pair[::-1])}
    values = {sides[a, b]: F.col(own[a])[place[own[b]]] for a, b in sides}
    named = {(sides[a, b], sides[b, a]): (a, b) for a, b in pairs}
    moments = _pair_moments(ranks, values, list(named))
    label = F.create_map(
        *[x for pair, (a, b) in named.items() for x in (
            F.lit(f"{pair[0]},{pair[1]}"),
            F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b")))]
    )
    return moments.select(
        label[F.concat_ws(",", "col_a", "col_b")].alias("pair"), "correlation", "n"
    ).select("pair.*", "correlation", "n")


def top_pairs(correlations: DataFrame, top_n: int = 1) -> DataFrame:
    """The unordered pairs of largest absolute correlation (ties by name)."""
    return (
        ordered_pair(correlations)
        .where(F.col("correlation").isNotNull())
        .orderBy(F.desc(F.abs("correlation")), "col_a", "col_b")
        .limit(top_n)
    )


def spearman_top_pair(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    threshold: float = 0.6,
    reported: DataFrame | None = None,
) -> DataFrame:
    """The strongest Spearman pair at or above the threshold that was not reported before.

    ``reported`` defaults to the strongest Pearson pair.
    """
    known = reported if reported is not None else top_pairs(corr_matrix(df, columns))
    return (
        ordered_pair(spearman_matrix(df, columns))
        .join(F.broadcast(ordered_pair(known).select("col_a", "col_b")), ["col_a", "col_b"], "left_anti")
        .where(F.abs("correlation") >= threshold)
        .orderBy(F.desc(F.abs("correlation")), "col_a", "col_b")
        .limit(1)
        .select("col_a", "col_b", F.round("correlation", 2).alias("spearman"))
    )
