"""Analysis tasks run from their specifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import plan_table, run_tasks
from .association import RELATED_CTE, _corr_sql, related
from .base import query, ranked_sql, nearest_sql, table
from .charts import box_sql, histogram_sql, rounded_bins, rounded_boxes
from .typing import _NUMBER, DIRTY_CTE, dirty


def _run(df, **spec):
    return run_tasks(df, [{"name": "task", **spec}])["task"]


@query("task_histogram", histogram_sql(("o_totalprice",), "orders"))
def task_histogram(spark, sf):
    return rounded_bins(_run(table(spark, sf, "orders"), plot_type="histogram", columns=["o_totalprice", "no_such_column"]))


@query(
    "task_line",
    "SELECT date_trunc('day', ts)::TIMESTAMP AS at, round(avg(value), 6) AS mean_value, round(avg(value) * 0.97, 6) AS band_low, round(avg(value) * 1.03, 6) AS band_high FROM events GROUP BY 1",
)
def task_line(spark, sf):
    found = _run(table(spark, sf, "events"), plot_type="line", columns=["ts", "value"], options={"bucket": "day"})
    return found.withColumns({c: F.round(c, 6) for c in ("mean_value", "band_low", "band_high")})


@query(
    "task_bar",
    "SELECT CAST(l_linenumber AS VARCHAR) AS category, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1",
)
def task_bar(spark, sf):
    found = _run(
        table(spark, sf, "lineitem"),
        chart_type="bar",
        columns=["l_linenumber", "l_extendedprice"],
        aggregate="sum",
    )
    return found.withColumn("value", F.round("value", 2))


@query(
    "task_bar_counts",
    "SELECT o_orderpriority AS category, count(*) AS value FROM orders GROUP BY 1",
)
def task_bar_counts(spark, sf):
    return _run(table(spark, sf, "orders"), plot_type="bar", columns=["o_orderpriority"])


@query("task_scatter")
def task_scatter(spark, sf):
    return _run(
        table(spark, sf, "orders"), plot_type="scatter", columns=["o_custkey", "o_totalprice"],
        options={"max_points": 300, "key": ["o_orderkey"]},
    )


@query("task_box", box_sql("o_orderstatus", "o_totalprice", "orders"))
def task_box(spark, sf):
    return rounded_boxes(_run(table(spark, sf, "orders"), plot_type="box", columns=["o_orderstatus", "o_totalprice"]))


_HEAT = ("quantity", "price", "net")
_HEAT_PAIRS = (("quantity", "price"), ("quantity", "net"), ("price", "net"))


@query(
    "task_heatmap",
    f"WITH {RELATED_CTE}, pairs AS ({_corr_sql(_HEAT_PAIRS, 'related')}) "
    "SELECT col_a, col_b, correlation FROM pairs UNION ALL SELECT col_b, col_a, correlation FROM pairs "
    + "".join(f"UNION ALL SELECT '{c}', '{c}', 1.0::DOUBLE " for c in _HEAT),
)
def task_heatmap(spark, sf):
    found = _run(related(spark, sf), plot_type="heatmap", columns=list(_HEAT))
    return found.withColumn("correlation", F.round("correlation", 6))


@query(
    "task_table",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000",
)
def task_table(spark, sf):
    return _run(
        table(spark, sf, "orders"), plot_type="table", columns=["o_orderkey", "o_totalprice"],
        preprocessing=[{"filter": "o_orderstatus = 'F' AND o_totalprice > 100000"}],
    )


@query(
    "task_summary_stat",
    f"WITH {ranked_sql('customer', ('c_acctbal',))}, m AS (SELECT {nearest_sql(0.25)} AS q25, {nearest_sql(0.5)} AS q50, {nearest_sql(0.75)} AS q75 FROM places) "
    "SELECT 'c_acctbal' AS column_name, count(c_acctbal) AS value_count, count(*) - count(c_acctbal) AS null_count, round(avg(c_acctbal), 2) AS mean, round(stddev_samp(c_acctbal), 2) AS std, "
    "round(min(c_acctbal), 2) AS min, round(max(q25), 2) AS q25, round(max(q50), 2) AS q50, round(max(q75), 2) AS q75, round(max(c_acctbal), 2) AS max FROM customer, m",
)
def task_summary_stat(spark, sf):
    return _run(table(spark, sf, "customer"), plot_type="summary_stat", columns=["c_acctbal", "c_name"])


@query(
    "task_coerce",
    f"WITH {DIRTY_CTE}, n AS (SELECT status, CASE WHEN regexp_matches(price, {_NUMBER}) THEN TRY_CAST(price AS DOUBLE) END AS price FROM dirty) "
    "SELECT status AS category, round(avg(price), 4) AS value FROM n WHERE price IS NOT NULL GROUP BY 1",
)
def task_coerce(spark, sf):
    found = _run(
        dirty(spark, sf), plot_type="bar", columns=["status", "price"],
        preprocessing=[{"coerce": ["price"]}, {"dropna": ["price"]}],
    )
    return found.withColumn("value", F.round("value", 4))


@query(
    "task_groupby",
    "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS o_totalprice_mean, count(o_orderkey) AS o_orderkey_count, max(o_orderdate) AS o_orderdate_max "
    "FROM orders WHERE o_orderstatus = 'O' GROUP BY 1",
)
def task_groupby(spark, sf):
    found = _run(
        table(spark, sf, "orders"), plot_type="table",
        columns=["o_orderpriority", "o_totalprice_mean", "o_orderkey_count", "o_orderdate_max"],
        preprocessing=[
            {"filter": "o_orderstatus = 'O'"},
            {
                "groupby": ["o_orderpriority"],
                "agg": {"o_totalprice": "mean", "o_orderkey": "count", "o_orderdate": "max"},
            },
        ],
    )
    return found.withColumn("o_totalprice_mean", F.round("o_totalprice_mean", 4))


@query(
    "task_pivot_mean",
    "SELECT l_linenumber, "
    + ", ".join(
        f"round(avg(CASE WHEN l_returnflag = '{f}' THEN l_extendedprice END), 4) AS \"{f}\"" for f in "ANR"
    )
    + " FROM lineitem GROUP BY 1",
)
def task_pivot_mean(spark, sf):
    found = _run(
        table(spark, sf, "lineitem"), plot_type="table", columns=[],
        preprocessing=[
            {"pivot": {"index": "l_linenumber", "columns": "l_returnflag", "values": "l_extendedprice"}}
        ],
    )
    return found.withColumns({f: F.round(f, 4) for f in "ANR"})


@query("auto_plan")
def auto_plan(spark, sf):
    return plan_table(table(spark, sf, "events"))
