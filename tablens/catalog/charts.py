"""Chart-data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts
from .association import RELATED_CTE, related
from .base import bin_sql, linear_sql, long_sql, query, table
from .summary import gaps, GAPS_CTE

_SHOWN = ("l_extendedprice", "l_discount")


def histogram_sql(columns, source: str, bins: int = 25) -> str:
    return (
        f"WITH cells AS ({long_sql(source, columns)}), "
        "ends AS (SELECT column_name, min(v) AS lo, max(v) AS hi FROM cells GROUP BY column_name), "
        f"binned AS (SELECT c.column_name, {bin_sql('v', 'lo', 'hi', bins)} + 1 AS bin, count(*) AS n "
        "FROM cells c JOIN ends e ON c.column_name = e.column_name WHERE v IS NOT NULL GROUP BY 1, 2), "
        f"frame AS (SELECT e.*, CAST(b.range AS INTEGER) AS bin FROM ends e, range(1, {bins + 1}) b) "
        "SELECT f.column_name, f.bin, "
        f"round(lo + (f.bin - 1) * ((hi - lo) / {bins}.0), 6) AS bin_low, round(lo + f.bin * ((hi - lo) / {bins}.0), 6) AS bin_high, "
        "coalesce(n, 0) AS n FROM frame f LEFT JOIN binned b ON f.column_name = b.column_name AND f.bin = b.bin"
    )


def rounded_bins(df):
    return df.withColumns({c: F.round(c, 6) for c in ("bin_low", "bin_high")})


@query("histogram", histogram_sql(_SHOWN, "lineitem"))
def histogram(spark, sf):
    return rounded_bins(charts.histogram(table(spark, sf, "lineitem"), _SHOWN))


@query(
    "variance_histograms",
    histogram_sql(("o_totalprice", "o_custkey"), "orders"),
)
def variance_histograms(spark, sf):
    return rounded_bins(charts.variance_histograms(table(spark, sf, "orders")))


@query(
    "kde_curve",
    "WITH s AS (SELECT count(value) AS n, min(value) AS lo, max(value) AS hi, "
    "stddev_samp(value) * power(count(value), -0.2) AS h FROM events), "
    f"cells AS (SELECT {bin_sql('value', 'lo', 'hi', 1024)} AS cell, count(*) AS w, avg(value) AS m FROM events, s GROUP BY 1), "
    "grid AS (SELECT lo + range * ((hi - lo) / 199) AS x, n, h FROM s, range(200)) "
    "SELECT round(x, 6) AS x, round(sum(w * exp(-0.5 * power((x - m) / h, 2))) / (max(n) * max(h) * sqrt(2 * pi())), 8) AS density "
    "FROM grid, cells GROUP BY x",
)
def kde_curve(spark, sf):
    return charts.kde_curve(table(spark, sf, "events"), "value").select(
        F.round("x", 6).alias("x"), F.round("density", 8).alias("density")
    )


@query(
    "top_categories",
    f"WITH {GAPS_CTE}, cells AS ({long_sql('gaps', ('flag', 'status'), 'VARCHAR')}), "
    "counts AS (SELECT column_name, v, count(*) AS n, row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, v ASC NULLS LAST) AS place "
    "FROM cells GROUP BY column_name, v) "
    "SELECT column_name, coalesce(v, 'null') AS label, n, CAST(place AS INTEGER) AS place FROM counts WHERE place <= 5",
)
def top_categories(spark, sf):
    return charts.top_categories(gaps(spark, sf))


@query(
    "top_categories_long_labels",
    "WITH named AS (SELECT 'The priority of this order is described as ' || o_orderpriority AS priority FROM orders), "
    "counts AS (SELECT priority, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, priority) AS place FROM named GROUP BY priority) "
    "SELECT 'priority' AS column_name, substring(priority, 1, 39) || '…' AS label, n, CAST(place AS INTEGER) AS place FROM counts WHERE place <= 5",
)
def top_categories_long_labels(spark, sf):
    df = table(spark, sf, "orders").select(
        F.concat(F.lit("The priority of this order is described as "), "o_orderpriority").alias("priority")
    )
    return charts.top_categories(df)


@query(
    "time_series_mean",
    "SELECT date_trunc('hour', ts) AS at, round(avg(value), 6) AS mean_value, round(avg(value) * 0.97, 6) AS band_low, "
    "round(avg(value) * 1.03, 6) AS band_high FROM events GROUP BY 1",
)
def time_series_mean(spark, sf):
    return _rounded_series(charts.time_series_mean(table(spark, sf, "events"), "ts", "value", "hour"))


@query(
    "time_series_charts",
    "SELECT 'o_orderdate' AS time_column, 'o_totalprice' AS value_column, date_trunc('month', o_orderdate)::TIMESTAMP AS at, "
    "round(avg(o_totalprice), 4) AS mean_value, round(avg(o_totalprice) * 0.97, 4) AS band_low, "
    "round(avg(o_totalprice) * 1.03, 4) AS band_high FROM orders GROUP BY 3",
)
def time_series_charts(spark, sf):
    return _rounded_series(charts.time_series_charts(table(spark, sf, "orders"), bucket="month"), 4)


def _rounded_series(df, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in ("mean_value", "band_low", "band_high")})


def box_sql(category: str, value: str, source: str) -> str:
    return (
        f"WITH rows AS (SELECT CAST({category} AS VARCHAR) AS category, CAST({value} AS DOUBLE) AS v FROM {source} "
        f"WHERE {category} IS NOT NULL AND {value} IS NOT NULL), "
        "places AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY category) AS n FROM rows), "
        f"marks AS (SELECT category, {linear_sql(0.25)} AS q1, {linear_sql(0.5)} AS median, {linear_sql(0.75)} AS q3 FROM places GROUP BY category) "
        "SELECT r.category, count(*) AS n, round(max(q1), 4) AS q1, round(max(median), 4) AS median, round(max(q3), 4) AS q3, "
        "min(CASE WHEN v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_low, "
        "max(CASE WHEN v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_high, "
        "count(CASE WHEN v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) THEN 1 END) AS fliers "
        "FROM rows r JOIN marks m ON r.category = m.category GROUP BY r.category"
    )


def rounded_boxes(df):
    return df.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query("box_stats", box_sql("event_type", "value", "events"))
def box_stats(spark, sf):
    return rounded_boxes(charts.box_stats(table(spark, sf, "events"), "event_type", "value"))


@query(
    "category_boxes",
    "SELECT 'event_type' AS category_column, * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS value_column, * FROM ({box_sql('event_type', c, 'events')}) b_{c}" for c in ("user_id", "value")
    )
    + ") t",
)
def category_boxes(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_type", "value")
    return rounded_boxes(charts.category_boxes(events))



@query(
    "extreme_column_profile",
    "SELECT 'value' AS column_name, bin, bin_low, bin_high, n, true AS log_scale FROM ("
    + histogram_sql(("logged",), "(SELECT ln(1 + value) AS logged FROM events) e")
    + ") h",
)
def extreme_column_profile(spark, sf):
    parts = charts.extreme_column_profile(table(spark, sf, "events"), ["user_id", "value"])
    return rounded_bins(parts["histogram"])


_LINES = (("quantity", "price"), ("price", "net"), ("discount", "charge"))


@query(
    "regression_line",
    f"WITH {RELATED_CTE} "
    + " UNION ALL ".join(
        f"SELECT '{x}' AS x_column, '{y}' AS y_column, round(regr_slope({y}, {x}), 4) AS slope, "
        f"round(regr_intercept({y}, {x}), 3) AS intercept, round(regr_r2({y}, {x}), 6) AS r2, count(*) AS n FROM related"
        for x, y in _LINES
    ),
)
def regression_line(spark, sf):
    return charts.regression_lines(related(spark, sf), _LINES).withColumns(
        {"slope": F.round("slope", 4), "intercept": F.round("intercept", 3), "r2": F.round("r2", 6)}
    )


@query("regression_band")
def regression_band(spark, sf):
    return charts.regression_band(related(spark, sf), "quantity", "price")


@query("scatter_points")
def scatter_points(spark, sf):
    return charts.scatter_points(related(spark, sf), "price", "net", 500)
