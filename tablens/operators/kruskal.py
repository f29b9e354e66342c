"""Kruskal-Wallis association between a category and numeric columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .columns import as_number, as_text, numeric_columns
from .order import average_ranks, long_counts


def kruskal_scores(
    df: DataFrame, category: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """``(column_name, h_stat, n_groups, n)`` per numeric column, corrected for ties.

    Rows with any null among the category and the columns are left out, then groups of one
    row. All work is on value counts per category: rows are combined before the first shuffle.
    ``H = (N - 1) * between-group / total sum of squares`` of the ranks.
    """
    names = [c for c in (columns or numeric_columns(df)) if c != category]
    values = {c: as_number(df, c) for c in names}
    rows = df.select(
        as_text(df, category).alias("category"),
        *[values[c].alias(f"c{i}") for i, c in enumerate(names)],
    ).na.drop()
    counts = cut(
        long_counts(rows, {c: F.col(f"c{i}") for i, c in enumerate(names)}, "category")
    )
    sizes = counts.groupBy("name", "category").agg(F.sum("n").alias("size")).where("size > 1")
    kept = counts.join(sizes.select("name", "category"), ["name", "category"], "left_semi")
    ranks = average_ranks(kept.groupBy("name", "value").agg(F.sum("n").alias("n")))
    # one record per numeric column; squares are taken around the mean rank to keep digits
    totals = F.broadcast(sizes.groupBy("name").agg(F.sum("size").alias("total")))
    middle = (F.col("total") + 1) / 2
    offset = F.col("rank") - middle
    by_group = (
        kept.join(ranks.select("name", "value", "rank"), ["name", "value"])
        .join(totals, "name")
        .groupBy("name", "category")
        .agg(F.sum(F.col("n") * offset).alias("offset_sum"), F.sum("n").alias("size"))
    )
    between = by_group.groupBy("name").agg(
        F.count("*").alias("n_groups"),
        F.sum("size").alias("n"),
        F.sum(F.col("offset_sum") * F.col("offset_sum") / F.col("size")).alias("between"),
    )
    spread = (
        ranks.join(totals, "name")
        .groupBy("name")
        .agg(F.sum(F.col("n") * offset * offset).alias("spread"))
    )
    score = (F.col("n") - 1) * F.try_divide("between", "spread")
    return (
        between.where("n_groups > 1")
        .join(F.broadcast(spread), "name")
        .select(F.col("name").alias("column_name"), score.alias("h_stat"), "n_groups", "n")
    )


def kruskal_ranking(
    df: DataFrame, category: str, columns: Sequence[str] | None = None, top_n: int = 2
) -> DataFrame:
    """The numeric columns most associated with the category."""
    return (
        kruskal_scores(df, category, columns)
        .where(F.col("h_stat").isNotNull())
        .orderBy(F.desc("h_stat"), "column_name")
        .limit(top_n)
    )
