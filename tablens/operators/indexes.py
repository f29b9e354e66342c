"""Detection of row-index columns, which profiling leaves out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import as_text, collect_metrics, quoted, union_all

# fixed values: names that mark an index when the column is unique
INDEX_NAMES = ("id", "index", "idx", "row_id", "rowid")

_RUN = 4096


def detect_index_columns(df: DataFrame, order_by: Sequence[str] | None = None) -> list[str]:
    """Names of unique columns that are whole numbers in steps of one, or carry an index name.

    Spark tables have no row order, so without ``order_by`` a column qualifies when its values
    are exactly ``low, low + 1, …``; with ``order_by`` they must also rise in that order.
    One cheap aggregate rules out almost every column before uniqueness is counted.
    """
    integral = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    ]
    named = [c for c in df.columns if c.lower() in INDEX_NAMES]
    if not integral and not named:
        return []
    facts = collect_metrics(
        df,
        sorted({*integral, *named}),
        {
            "rows": lambda c: F.count("*"),
            "filled": lambda c: F.count(quoted(c)),
            "low": lambda c: F.min(quoted(c)).cast("decimal(20,0)") if c in integral else F.lit(None).cast("decimal(20,0)"),
            "high": lambda c: F.max(quoted(c)).cast("decimal(20,0)") if c in integral else F.lit(None).cast("decimal(20,0)"),
        },
    )
    dense = [
        c
        for c in integral
        if facts[c]["rows"] == facts[c]["filled"] > 0
        and facts[c]["high"] - facts[c]["low"] == facts[c]["rows"] - 1
    ]
    unique = _unique_columns(df, sorted({*dense, *named}))
    stepping = {c for c in dense if c in unique and (not order_by or _rises(df, c, order_by))}
    return [c for c in df.columns if c in stepping or (c in named and c in unique)]


def _unique_columns(df: DataFrame, names: Sequence[str]) -> set[str]:
    if not names:
        return set()
    repeated = union_all(
        [
            df.select(as_text(df, c).alias("value"))
            .groupBy("value")
            .agg(F.count("*").alias("n"))
            .agg(F.max("n").alias("most"))
            .select(F.lit(c).alias("column_name"), "most")
            for c in names
        ]
    )
    return {r["column_name"] for r in repeated.where("most = 1").collect()}


def _rises(df: DataFrame, name: str, order_by: Sequence[str]) -> bool:
    """Does a unique, gap-free column rise in the given order? Checked on runs of values.

    Each run of ``_RUN`` values also receives the first value of the next run, so every
    neighbouring pair is compared in some window of bounded size.
    """
    value = quoted(name).cast("bigint")
    place = F.struct(*[quoted(c) for c in order_by])
    run = F.floor(value / F.lit(_RUN))
    rows = df.select(value.alias("v"), place.alias("place"), F.explode(
        F.when(F.pmod(value, F.lit(_RUN)) == 0, F.array(run, run - 1)).otherwise(F.array(run))
    ).alias("run"))
    previous = F.lag("place").over(W.partitionBy("run").orderBy("v"))
    return rows.select((previous > F.col("place")).alias("falls")).where("falls").isEmpty()


def index_columns(df: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
    """``detect_index_columns`` as a table ``(column_name, is_index)`` over all columns."""
    found = set(detect_index_columns(df, order_by))
    return df.sparkSession.createDataFrame(
        [(c, c in found) for c in df.columns], "column_name string, is_index boolean"
    )
