"""Rank, correlation, mutual-information and Kruskal-Wallis queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.bins import digitized_label
from ..operators import correlation, kruskal, mutual_info, order
from ..operators.columns import as_number
from .base import (
    GAP_NUMBERS,
    RELATED,
    RELATED_NUMBERS,
    bin_sql,
    long_sql,
    query,
    select_sql,
    table,
)
from .summary import GAPS_CTE, gaps

RELATED_CTE = f"related AS ({select_sql(RELATED, 'lineitem')})"


def related(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*RELATED)


_RANKED = ("quantity", "price", "discount")


@query(
    "average_rank",
    f"WITH {GAPS_CTE}, cells AS ({long_sql('gaps', _RANKED)}), "
    "counts AS (SELECT column_name AS name, v AS value, count(*) AS n FROM cells WHERE v IS NOT NULL GROUP BY ALL) "
    "SELECT name, value, n, CAST(sum(n) OVER (PARTITION BY name ORDER BY value) AS BIGINT) - (n - 1) / 2.0 AS rank FROM counts",
)
def average_rank(spark, sf):
    df = gaps(spark, sf)
    return order.average_ranks(order.long_counts(df, {c: as_number(df, c) for c in _RANKED}))


def _corr_sql(pairs, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS correlation, "
        f"count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n FROM {source}"
        for a, b in pairs
    )


def _rounded(df):
    return df.withColumn("correlation", F.round("correlation", 6))


@query(
    "corr_matrix",
    f"WITH {GAPS_CTE} " + _corr_sql(combinations(("l_orderkey", *GAP_NUMBERS), 2), "gaps"),
)
def corr_matrix(spark, sf):
    return _rounded(correlation.corr_matrix(gaps(spark, sf)))


_RELATED_CORR = f"WITH {RELATED_CTE}, pairs AS ({_corr_sql(combinations(RELATED_NUMBERS, 2), 'related')}) "


@query(
    "heatmap_cells",
    _RELATED_CORR
    + "SELECT col_a, col_b, correlation FROM pairs UNION ALL SELECT col_b, col_a, correlation FROM pairs "
    + "".join(f"UNION ALL SELECT '{c}', '{c}', 1.0::DOUBLE " for c in RELATED_NUMBERS),
)
def heatmap_cells(spark, sf):
    return _rounded(correlation.heatmap_cells(related(spark, sf)))


@query(
    "strong_correlations",
    _RELATED_CORR
    + "SELECT least(col_a, col_b) AS col_a, greatest(col_a, col_b) AS col_b, round(correlation, 2) AS correlation "
    "FROM pairs WHERE abs(correlation) > 0.8 ORDER BY abs(correlation) DESC, 1, 2 LIMIT 5",
)
def strong_correlations(spark, sf):
    return correlation.strong_correlations(related(spark, sf))


def _spearman_sql(pairs, source: str) -> str:
    """Pearson on mean ranks over the rows where both sides are present."""
    return " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(ra, rb), 6) AS correlation, count(*) AS n FROM ("
        f"SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, "
        f"rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb "
        f"FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) t"
        for a, b in pairs
    )


@query(
    "spearman_matrix",
    f"WITH {GAPS_CTE} " + _spearman_sql(combinations(GAP_NUMBERS, 2), "gaps"),
)
def spearman_matrix(spark, sf):
    return _rounded(correlation.spearman_matrix(gaps(spark, sf), GAP_NUMBERS))


@query(
    "spearman_top_pair",
    f"WITH {RELATED_CTE}, pearson AS ({_corr_sql(combinations(RELATED_NUMBERS, 2), 'related')}), "
    f"spearman AS ({_spearman_sql(combinations(RELATED_NUMBERS, 2), 'related')}), "
    "known AS (SELECT least(col_a, col_b) AS a, greatest(col_a, col_b) AS b FROM pearson ORDER BY abs(correlation) DESC, 1, 2 LIMIT 1) "
    "SELECT least(col_a, col_b) AS col_a, greatest(col_a, col_b) AS col_b, round(correlation, 2) AS spearman FROM spearman "
    "WHERE abs(correlation) >= 0.6 AND NOT EXISTS (SELECT 1 FROM known WHERE a = least(col_a, col_b) AND b = greatest(col_a, col_b)) "
    "ORDER BY abs(correlation) DESC, 1, 2 LIMIT 1",
)
def spearman_top_pair(spark, sf):
    return correlation.spearman_top_pair(related(spark, sf), RELATED_NUMBERS)


_MI_NUMBERS = ("quantity", "price", "discount", "tax")
_MI_TEXTS = ("flag", "status", "shipped")


def _mi_label(column: str) -> str:
    if column in _MI_TEXTS:
        return f"CAST({column} AS VARCHAR)"
    low, high = f"min({column}) OVER ()", f"max({column}) OVER ()"
    return (
        f"CAST(CASE WHEN {high} = {low} THEN 0 WHEN {column} >= {high} THEN 21 "
        f"ELSE {bin_sql(column, low, high, 20)} + 1 END AS VARCHAR)"
    )


def _mi_sql(pairs) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS col_a, '{b}' AS col_b, round(sum(p * ln(p / (pa * pb))), 5) AS mutual_info FROM (
        SELECT p, sum(p) OVER (PARTITION BY x) AS pa, sum(p) OVER (PARTITION BY y) AS pb FROM (
        SELECT x, y, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM (
        SELECT {_mi_label(a)} AS x, {_mi_label(b)} AS y FROM gaps WHERE {a} IS NOT NULL AND {b} IS NOT NULL) l
        GROUP BY x, y) j) m"""
        for a, b in pairs
    )


_MI_COLUMNS = ("quantity", "price", "discount", "tax", "flag", "status", "shipped")


@query("mutual_info_pairs", f"WITH {GAPS_CTE} {_mi_sql(combinations(_MI_COLUMNS, 2))}")
def mutual_info_pairs(spark, sf):
    return mutual_info.mutual_info_pairs(gaps(spark, sf), _MI_COLUMNS).select(
        "col_a", "col_b", F.round("mutual_info", 5).alias("mutual_info")
    )


@query(
    "top_mutual_info_pairs",
    f"WITH {GAPS_CTE}, pairs AS ({_mi_sql(combinations(_MI_COLUMNS, 2))}) "
    "SELECT * FROM pairs ORDER BY mutual_info DESC, col_a, col_b LIMIT 3",
)
def top_mutual_info_pairs(spark, sf):
    return mutual_info.top_mutual_info_pairs(gaps(spark, sf), skip=("l_orderkey",))


@query(
    "bin_numeric",
    "WITH s AS (SELECT min(l_discount) AS dlo, max(l_discount) AS dhi, min(l_quantity) AS qlo, max(l_quantity) AS qhi FROM lineitem), "
    f"b AS (SELECT CASE WHEN l_discount >= dhi THEN 21 ELSE {bin_sql('l_discount', 'dlo', 'dhi', 20)} + 1 END AS discount_label, "
    f"CASE WHEN l_quantity >= qhi THEN 21 ELSE {bin_sql('l_quantity', 'qlo', 'qhi', 20)} + 1 END AS quantity_label FROM lineitem, s) "
    "SELECT CAST(discount_label AS INTEGER) AS discount_label, CAST(quantity_label AS INTEGER) AS quantity_label, count(*) AS n FROM b GROUP BY 1, 2",
)
def bin_numeric(spark, sf):
    df = table(spark, sf, "lineitem")
    ends = df.agg(
        *[f(c).alias(f"{n}_{c}") for c in ("l_discount", "l_quantity") for n, f in (("lo", F.min), ("hi", F.max))]
    ).first()
    labels = [
        digitized_label(F.col(c), F.lit(ends[f"lo_{c}"]), F.lit(ends[f"hi_{c}"]), 20).alias(f"{c[2:]}_label")
        for c in ("l_discount", "l_quantity")
    ]
    return df.select(*labels).groupBy("discount_label", "quantity_label").agg(F.count("*").alias("n"))


def _kruskal_sql(category: str, columns) -> str:
    """Tie-corrected H from mean ranks, over listwise complete rows of groups above one row."""
    one = []
    for c in columns:
        one.append(
            f"""SELECT '{c}' AS column_name, round((max(n) - 1) * sum(size * (mean_rank - (n + 1) / 2.0) ** 2) / max(total_ss), 5) AS h_stat,
            count(*) AS n_groups, max(n) AS n FROM (
            SELECT g, count(*) AS size, avg(r) AS mean_rank, max(n) AS n, max(total_ss) AS total_ss FROM (
            SELECT g, r, n, sum((r - (n + 1) / 2.0) ** 2) OVER () AS total_ss FROM (
            SELECT {category} AS g, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r, count(*) OVER () AS n
            FROM kept) a) b GROUP BY g) d"""
        )
    complete = " AND ".join(f"{c} IS NOT NULL" for c in (category, *columns))
    return (
        f"WITH {GAPS_CTE}, complete AS (SELECT * FROM gaps WHERE {complete}), "
        f"kept AS (SELECT * FROM complete WHERE {category} IN (SELECT {category} FROM complete GROUP BY 1 HAVING count(*) > 1)) "
        + " UNION ALL ".join(one)
    )


@query("kruskal_scores", _kruskal_sql("flag", GAP_NUMBERS))
def kruskal_scores(spark, sf):
    return kruskal.kruskal_scores(gaps(spark, sf), "flag", GAP_NUMBERS).withColumn(
        "h_stat", F.round("h_stat", 5)
    )


@query(
    "kruskal_ranking",
    f"SELECT column_name FROM ({_kruskal_sql('flag', GAP_NUMBERS)}) k ORDER BY h_stat DESC, column_name LIMIT 2",
)
def kruskal_ranking(spark, sf):
    return kruskal.kruskal_ranking(gaps(spark, sf), "flag", GAP_NUMBERS).select("column_name")
