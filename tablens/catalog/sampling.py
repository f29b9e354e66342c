"""Sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import order, sampling
from .base import query, table


@query(
    "global_index",
    "SELECT ts, event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_index FROM events",
)
def global_index(spark, sf):
    return order.global_index(table(spark, sf, "events"), ["ts", "event_id"])


@query(
    "systematic_sample",
    "SELECT event_id, ts, user_id, event_type, value, props FROM ("
    "SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, greatest(1, count(*) OVER () // 250) AS step FROM events) t "
    "WHERE i % step = 0",
)
def systematic_sample(spark, sf):
    return sampling.systematic_sample(table(spark, sf, "events"), 250, ["ts", "event_id"])


@query(
    "systematic_sample_scan_order",
    "SELECT event_id, ts, user_id, event_type, value, props FROM ("
    "SELECT *, row_number() OVER () - 1 AS i, greatest(1, (SELECT count(*) FROM events) // 250) AS step FROM events) t WHERE i % step = 0",
)
def systematic_sample_scan_order(spark, sf):
    return sampling.systematic_sample(table(spark, sf, "events"), 250)


@query(
    "stratified_sample_counts",
    "WITH g AS (SELECT l_returnflag, count(*) AS size, count(*) OVER () AS k FROM lineitem GROUP BY l_returnflag) "
    "SELECT l_returnflag, least(size, greatest(1, 1000 // k)) AS n FROM g",
)
def stratified_sample_counts(spark, sf):
    sample = sampling.stratified_sample(
        table(spark, sf, "lineitem"), 1000, "l_returnflag", ["l_orderkey", "l_linenumber", "l_partkey"]
    )
    return sample.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query(
    "stratified_sample_large",
    "WITH g AS (SELECT l_returnflag, count(*) AS size, count(*) OVER () AS k FROM lineitem GROUP BY l_returnflag) "
    "SELECT l_returnflag, least(size, greatest(1, 30000 // k)) AS n, least(size, greatest(1, 30000 // k)) AS n_rows FROM g",
)
def stratified_sample_large(spark, sf):
    """More rows a stratum than a window can limit early; all of them different rows."""
    sample = sampling.stratified_sample(
        table(spark, sf, "lineitem"), 30_000, "l_returnflag", ["l_orderkey", "l_linenumber", "l_partkey"]
    )
    return sample.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.countDistinct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("n_rows")
    )


@query("random_sample")
def random_sample(spark, sf):
    return sampling.random_sample(table(spark, sf, "orders"), 100, ["o_orderkey"])


@query("sample_auto")
def sample_auto(spark, sf):
    strategy, rows = sampling.sample_auto(table(spark, sf, "customer"), 100, key=["c_custkey"])
    return rows.withColumn("strategy", F.lit(strategy))
