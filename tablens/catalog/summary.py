"""Summary, frequency and outlier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frequencies, indexes, summary
from ..operators.columns import quoted
from ..plans import tasks
from ..plans.profile import profile
from .base import (
    GAP_NUMBERS,
    GAPS,
    LINEITEM_NUMBERS,
    long_sql,
    nearest_sql,
    query,
    ranked_sql,
    select_sql,
    table,
)

GAPS_CTE = f"gaps AS ({select_sql(GAPS, 'lineitem')})"


def gaps(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*GAPS)


@query(
    "dataset_shape",
    "SELECT count(*) AS num_rows, 11 AS num_columns FROM lineitem",
)
def dataset_shape(spark, sf):
    return summary.dataset_shape(table(spark, sf, "lineitem"))


_REPEATING = ("l_linenumber", "l_quantity", "l_tax", "l_returnflag", "l_linestatus")


@query(
    "duplicate_rows",
    f"SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(_REPEATING)} FROM lineitem)) AS duplicated_rows",
)
def duplicate_rows(spark, sf):
    return summary.duplicate_rows(table(spark, sf, "lineitem").select(*_REPEATING))


@query(
    "duplicate_rows_whole",
    "SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicated_rows",
)
def duplicate_rows_whole(spark, sf):
    return summary.duplicate_rows(table(spark, sf, "lineitem"))


_GAP_COLUMNS = ("l_orderkey", "quantity", "price", "discount", "tax", "flag", "status", "shipped")


@query(
    "missing_values",
    f"WITH {GAPS_CTE}, cells AS ({long_sql('gaps', _GAP_COLUMNS, 'VARCHAR')}) "
    "SELECT column_name, count(*) - count(v) AS missing_count, "
    "round((count(*) - count(v)) * 100.0 / count(*), 4) AS missing_pct FROM cells GROUP BY column_name",
)
def missing_values(spark, sf):
    return summary.missing_values(gaps(spark, sf))


def _outliers_sql(source: str, columns, tail: str) -> str:
    return (
        f"WITH {ranked_sql(source, columns)}, "
        f"marks AS (SELECT column_name, {nearest_sql(0.25)} AS q1, {nearest_sql(0.75)} AS q3 "
        "FROM places GROUP BY column_name), "
        "found AS (SELECT c.column_name, CAST(sum(CASE WHEN c.v < q1 - 1.5 * (q3 - q1) OR c.v > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS BIGINT) AS outliers "
        "FROM cells c JOIN marks m ON c.column_name = m.column_name GROUP BY c.column_name) " + tail
    )


@query(
    "outliers_per_column",
    _outliers_sql("lineitem", LINEITEM_NUMBERS, "SELECT column_name, outliers FROM found"),
)
def outliers_per_column(spark, sf):
    df = table(spark, sf, "lineitem")
    return summary.outliers_per_column(df, summary.numeric_columns(df, indexes.detect_index_columns(df)))


_EVENT_NUMBERS = ("user_id", "value")


@query(
    "outliers_ranked",
    _outliers_sql(
        "events",
        _EVENT_NUMBERS,
        "SELECT column_name, outliers, row_number() OVER (ORDER BY outliers DESC, column_name) AS place FROM found",
    ),
)
def outliers_ranked(spark, sf):
    return summary.outliers_ranked(table(spark, sf, "events"), _EVENT_NUMBERS)


@query(
    "outlier_rows",
    f"WITH {ranked_sql('events', ('value',))}, m AS (SELECT {nearest_sql(0.25)} AS q1, {nearest_sql(0.75)} AS q3 FROM places) "
    "SELECT event_id, value FROM events, m WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)",
)
def outlier_rows(spark, sf):
    return summary.outlier_rows(table(spark, sf, "events"), "value").select("event_id", "value")


_DESCRIBE = (
    f"WITH {GAPS_CTE}, {ranked_sql('gaps', GAP_NUMBERS)}, "
    f"marks AS (SELECT column_name, {nearest_sql(0.25)} AS q25, {nearest_sql(0.5)} AS q50, {nearest_sql(0.75)} AS q75 FROM places GROUP BY column_name) "
    "SELECT c.column_name, count(c.v) AS value_count, count(*) - count(c.v) AS null_count, "
    "round(avg(c.v), 2) AS mean, round(stddev_samp(c.v), 2) AS std, round(min(c.v), 2) AS min, "
    "round(max(q25), 2) AS q25, round(max(q50), 2) AS q50, round(max(q75), 2) AS q75, round(max(c.v), 2) AS max "
    "FROM cells c JOIN marks m ON c.column_name = m.column_name GROUP BY c.column_name"
)


@query("describe_numeric", _DESCRIBE)
def describe_numeric(spark, sf):
    return summary.describe_numeric(gaps(spark, sf), GAP_NUMBERS)


def _moments_sql(source: str, columns, with_cte: str = "") -> str:
    return (
        f"WITH {with_cte}cells AS ({long_sql(source, columns)}), "
        "means AS (SELECT column_name, avg(v) AS mu FROM cells GROUP BY column_name), "
        "centred AS (SELECT c.column_name, avg((v - mu) ** 2) AS m2, avg((v - mu) ** 3) AS m3, avg((v - mu) ** 4) AS m4 "
        "FROM cells c JOIN means m ON c.column_name = m.column_name WHERE v IS NOT NULL GROUP BY c.column_name), "
        "shape AS (SELECT column_name, m3 / m2 ** 1.5 AS skewness, m4 / (m2 * m2) - 3 AS kurtosis FROM centred) "
    )


@query(
    "skew_kurtosis",
    _moments_sql("gaps", GAP_NUMBERS, GAPS_CTE + ", ")
    + "SELECT column_name, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis, "
    "round(abs(skewness) * abs(kurtosis), 6) AS extremeness FROM shape",
)
def skew_kurtosis(spark, sf):
    found = summary.skew_kurtosis(gaps(spark, sf), GAP_NUMBERS)
    return found.select(
        "column_name",
        *[F.round(c, 6).alias(c) for c in ("skewness", "kurtosis", "extremeness")],
    )


@query(
    "most_extreme_column",
    _moments_sql("lineitem", LINEITEM_NUMBERS)
    + "SELECT column_name, round(abs(skewness) * abs(kurtosis), 6) AS extremeness FROM shape "
    "ORDER BY abs(skewness) * abs(kurtosis) DESC, column_name LIMIT 1",
)
def most_extreme_column(spark, sf):
    return summary.most_extreme_column(table(spark, sf, "lineitem")).select(
        "column_name", F.round("extremeness", 6).alias("extremeness")
    )


_COUNTED = ("flag", "status", "shipped")


@query(
    "value_counts",
    f"WITH {GAPS_CTE}, cells AS ({long_sql('gaps', _COUNTED, 'VARCHAR')}) "
    "SELECT column_name, v AS value, count(*) AS n FROM cells GROUP BY column_name, v",
)
def value_counts(spark, sf):
    return frequencies.value_counts(gaps(spark, sf), _COUNTED)


# orders with dominated, constant and mostly missing columns
_UNEVEN = (
    "o_orderstatus AS status",
    "CASE WHEN o_totalprice > 480000 THEN 'large' WHEN o_totalprice > 440000 THEN 'middle' ELSE 'usual' END AS size_class",
    "CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 300000 THEN 'rush' ELSE NULL END AS rush",
    "'web' AS channel",
    "CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS above",
    "o_custkey AS customer",
)
_UNEVEN_COLUMNS = ("status", "size_class", "rush", "channel", "above", "customer")
_UNEVEN_COUNTS = (
    f"WITH uneven AS ({select_sql(_UNEVEN, 'orders')}), cells AS ({long_sql('uneven', _UNEVEN_COLUMNS, 'VARCHAR')}), "
    "counts AS (SELECT column_name, v, count(*) AS n FROM cells GROUP BY column_name, v), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, v ASC NULLS LAST) AS place FROM counts) "
)


def uneven(spark, sf):
    return table(spark, sf, "orders").selectExpr(*_UNEVEN)


@query(
    "constant_columns",
    _UNEVEN_COUNTS
    + "SELECT column_name, round(max(n) / CAST(sum(n) AS DOUBLE), 3) AS top_share FROM ranked "
    "GROUP BY column_name HAVING max(n) / CAST(sum(n) AS DOUBLE) >= 0.8",
)
def constant_columns(spark, sf):
    return frequencies.constant_columns(uneven(spark, sf))


@query(
    "near_zero_variance",
    _UNEVEN_COUNTS
    + ", top AS (SELECT column_name, max(CASE WHEN place = 1 THEN n END) AS most, max(CASE WHEN place = 2 THEN n END) AS second, "
    "max(CASE WHEN place = 1 THEN v END) AS most_common_value, count(*) AS distinct_values, sum(n) AS total FROM ranked GROUP BY column_name) "
    "SELECT column_name, round(CAST(most AS DOUBLE) / second, 3) AS freq_ratio, round(distinct_values * 100.0 / CAST(total AS DOUBLE), 3) AS percent_unique, most_common_value "
    "FROM top WHERE second IS NOT NULL AND (CAST(most AS DOUBLE) / second > 20 OR distinct_values * 100.0 / CAST(total AS DOUBLE) < 10)",
)
def near_zero_variance(spark, sf):
    return frequencies.near_zero_variance(uneven(spark, sf))


@query(
    "column_stats",
    f"WITH {GAPS_CTE}, cells AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS v, {'true' if text else 'false'} AS is_text FROM gaps"
        for c, text in zip(_GAP_COLUMNS, (0, 0, 0, 0, 0, 1, 1, 0))
    )
    + ") SELECT column_name, count(*) - count(v) AS null_values, count(DISTINCT v) AS distinct_count, "
    "round(count(DISTINCT v) / CAST(count(*) AS DOUBLE), 6) AS unique_ratio, "
    "round((count(*) - count(v)) / CAST(count(*) AS DOUBLE), 6) AS missing_ratio, "
    "avg(CASE WHEN is_text THEN length(v) END) AS mean_length, "
    "count(DISTINCT v) = 1 AS is_constant, count(DISTINCT v) = count(*) AS is_identifier FROM cells GROUP BY column_name",
)
def column_stats(spark, sf):
    return summary.column_stats(gaps(spark, sf)).withColumns(
        {c: F.round(c, 6) for c in ("unique_ratio", "missing_ratio")}
    )


@query(
    "size_estimate",
    "SELECT count(*) AS num_rows, round((count(*) * 32 + sum(strlen(o_orderstatus)) + sum(strlen(o_orderpriority))) / 1048576.0, 2) AS memory_mb FROM orders",
)
def size_estimate(spark, sf):
    return summary.size_estimate(table(spark, sf, "orders"))


@query(
    "top_variance_columns",
    f"WITH cells AS ({long_sql('lineitem', LINEITEM_NUMBERS)}) "
    "SELECT column_name, round(var_samp(v), 3) AS variance FROM cells GROUP BY column_name ORDER BY var_samp(v) DESC, column_name LIMIT 2",
)
def top_variance_columns(spark, sf):
    return summary.top_variance_columns(table(spark, sf, "lineitem")).select(
        "column_name", F.round("variance", 3).alias("variance")
    )


def _index_sql(source: str, integers, others) -> str:
    parts = [
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) = count(*) AND max({c}) - min({c}) = count(*) - 1 AS is_index FROM {source}"
        for c in integers
    ] + [f"SELECT '{c}' AS column_name, false AS is_index" for c in others]
    return " UNION ALL ".join(parts)


@query(
    "detect_index_columns",
    _index_sql(
        "orders", ("o_orderkey", "o_custkey"), ("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    ),
)
def detect_index_columns(spark, sf):
    return indexes.index_columns(table(spark, sf, "orders"))


@query(
    "detect_index_columns_ordered",
    "WITH s AS (SELECT o_orderkey - lag(o_orderkey) OVER (ORDER BY o_orderkey) AS up, "
    "o_orderkey - lag(o_orderkey) OVER (ORDER BY o_orderdate, o_totalprice) AS by_date "
    "FROM orders) SELECT 'up' AS column_name, bool_and(up = 1) AS is_index FROM s "
    "UNION ALL SELECT 'by_date', bool_and(by_date = 1) FROM s",
)
def detect_index_columns_ordered(spark, sf):
    orders = table(spark, sf, "orders")
    by_key = orders.select(quoted("o_orderkey").alias("up"))
    by_date = orders.select(
        quoted("o_orderkey").alias("by_date"), "o_orderdate", "o_totalprice"
    )
    return indexes.index_columns(by_key, ["up"]).union(
        indexes.index_columns(by_date, ["o_orderdate", "o_totalprice"]).where("column_name = 'by_date'")
    )


@query(
    "dropna_listwise",
    f"WITH {GAPS_CTE} SELECT status, count(*) AS n FROM gaps WHERE quantity IS NOT NULL AND price IS NOT NULL AND flag IS NOT NULL GROUP BY status",
)
def dropna_listwise(spark, sf):
    kept = tasks.dropna_listwise(gaps(spark, sf), ["quantity", "price", "flag"])
    return kept.groupBy("status").agg(F.count("*").alias("n"))


@query("preview")
def preview(spark, sf):
    return table(spark, sf, "lineitem").limit(5)


@query("profile_document")
def profile_document(spark, sf):
    return profile(table(spark, sf, "orders")).document()
