"""Registry of the named queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Decorator: register a query and, where SQL can say the same, its check."""

    def add(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- expressions both engines read the same way ----------------------------------------

LINEITEM_NUMBERS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
)

# lineitem with missing values, so that every null rule is exercised
GAPS = (
    "l_orderkey",
    "CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN NULL ELSE l_quantity END AS quantity",
    "CASE WHEN l_tax > 0.065 THEN NULL ELSE l_extendedprice END AS price",
    "CASE WHEN l_linestatus = 'F' AND l_linenumber = 2 THEN NULL ELSE l_discount END AS discount",
    "l_tax AS tax",
    "CASE WHEN l_quantity > 45 THEN NULL ELSE l_returnflag END AS flag",
    "l_linestatus AS status",
    "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_shipdate END AS shipped",
)
GAP_NUMBERS = ("quantity", "price", "discount", "tax")

# lineitem with strongly related numbers
RELATED = (
    "l_quantity AS quantity",
    "l_extendedprice AS price",
    "l_extendedprice * (1 - l_discount) AS net",
    "l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge",
    "l_quantity * l_quantity * l_quantity AS volume",
    "l_discount AS discount",
    "1.0 AS fixed",
)
RELATED_NUMBERS = ("quantity", "price", "net", "charge", "volume", "discount")


def select_sql(expressions: Sequence[str], source: str) -> str:
    return f"SELECT {', '.join(expressions)} FROM {source}"


def long_sql(source: str, columns: Sequence[str], cast: str = "DOUBLE") -> str:
    """``(column_name, v)`` rows of several columns."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS {cast}) AS v FROM {source}" for c in columns
    )


def ranked_sql(source: str, columns: Sequence[str]) -> str:
    """CTEs ``cells`` and ``places``: every value with its 0-based place and the count."""
    return (
        f"cells AS ({long_sql(source, columns)}), "
        "places AS (SELECT column_name, v, "
        "row_number() OVER (PARTITION BY column_name ORDER BY v) - 1 AS i, "
        "count(*) OVER (PARTITION BY column_name) AS n FROM cells WHERE v IS NOT NULL)"
    )


def nearest_sql(q: float) -> str:
    return f"max(CASE WHEN i = CAST(floor((n - 1) * {q} + 0.5) AS BIGINT) THEN v END)"


def linear_sql(q: float) -> str:
    """Linearly interpolated quantile out of ``i``, ``n`` and ``v``."""
    low = f"max(CASE WHEN i = CAST(floor((n - 1) * {q}) AS BIGINT) THEN v END)"
    high = f"max(CASE WHEN i = CAST(ceil((n - 1) * {q}) AS BIGINT) THEN v END)"
    return f"({low} + ({high} - {low}) * max((n - 1) * {q} - floor((n - 1) * {q})))"


def bin_sql(v: str, lo: str, hi: str, bins: int) -> str:
    """Edges passed by ``v`` (0 .. bins-1), compared with the edges themselves."""
    step = f"(({hi} - {lo}) / {bins}.0)"
    guess = f"least(greatest(CAST(floor(({v} - {lo}) / nullif({step}, 0)) AS BIGINT), 0), {bins - 1})"
    return (
        f"CASE WHEN {guess} + 1 < {bins} AND {v} >= {lo} + ({guess} + 1) * {step} THEN {guess} + 1 "
        f"WHEN {v} < {lo} + {guess} * {step} THEN {guess} - 1 ELSE {guess} END"
    )
