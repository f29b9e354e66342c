"""Exact order statistics of many numeric columns without sorting the table.

All columns and all ranks go through the same jobs in long form, as ``(id, value)`` cells:

1. Cells are counted per interval of a fixed logarithmic scale, each task for itself before the
   shuffle; least and largest value of each interval come along.
2. Running sums find the interval of every wanted rank. While one holds more than ``CANDIDATES``
   values, it is cut into ``STEPS`` intervals from its least to its largest value and counted again.
3. The values of the remaining intervals are counted and the ranks are read off.

An interval is a set of neighbouring values whatever rounding does, since every scale used is monotone;
so the answers are exact. Only a few numbers per column and rank reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import cut
from .columns import chunks, spread, union_all

CANDIDATES = 1_000_000
STEPS = 1 << 16
PER_E = 46  # intervals by which values grow to the e-fold
COLUMNS_PER_SCAN = 200


def nearest_rank(n: int, q: float) -> list[int]:
    """0-based rank of the nearest-rank quantile (halves round away from zero)."""
    return [min(n - 1, math.floor((n - 1) * q + 0.5))]


def linear_ranks(n: int, q: float) -> list[int]:
    """0-based ranks on both sides of the linearly interpolated quantile."""
    position = (n - 1) * q
    return [math.floor(position), math.ceil(position)]


def quantiles(
    df: DataFrame,
    values: dict[str, Column],
    probabilities: Sequence[float],
    method: str = "nearest",
) -> dict[str, list[float | None]]:
    """Exact quantiles of each expression (nulls ignored), in the order of ``probabilities``.

    ``method`` is ``"nearest"`` (an observed value) or ``"linear"`` (interpolated).
    An expression without values gives ``None``. The number of jobs does not depend on the number of
    expressions and probabilities.
    """
    ranks_of = {"nearest": nearest_rank, "linear": linear_ranks}[method]
    if not values:
        return {}
    cells = _cells(df, list(values.values()))
    counts = cut(_counted(cells.withColumn("place", _log_place()), "id"))
    sizes = {r["id"]: r["n"] for r in counts.groupBy("id").agg(F.sum("n").alias("n")).collect()}
    wanted = sorted({(i, rank) for i, n in sizes.items() for q in probabilities for rank in ranks_of(n, q)})
    found = _select(cells, counts, wanted)
    result: dict[str, list[float | None]] = {}
    for i, key in enumerate(values):
        n = sizes.get(i, 0)
        row: list[float | None] = []
        for q in probabilities:
            if not n:
                row.append(None)
                continue
            picked = [found[i, r] for r in ranks_of(n, q)]
            weight = (n - 1) * q - math.floor((n - 1) * q) if method == "linear" else 0.0
            # equal neighbours need no arithmetic, which infinite ones would spoil
            row.append(picked[0] if picked[0] == picked[-1] or not weight else picked[0] + (picked[-1] - picked[0]) * weight)
        result[key] = row
    return result


def _cells(df: DataFrame, values: Sequence[Column]) -> DataFrame:
    """``(id, value)`` of all values that are there."""
    names = [f"v{i}" for i in range(len(values))]
    wide = spread(df.select(*[v.cast("double").alias(n) for v, n in zip(values, names)]))
    parts = [wide.select(*group).unpivot([], list(group), "id", "value") for group in chunks(names, COLUMNS_PER_SCAN)]
    cells = union_all(parts).where(F.col("value").isNotNull())
    return cells.select(F.substring("id", 2, 9).cast("int").alias("id"), "value")


def _log_place() -> Column:
    """The interval of a value on the logarithmic scale; infinite ones have their own."""
    size = F.least(F.log1p(F.abs("value")), F.lit(1000.0))
    return F.floor(F.signum("value") * size * PER_E)


def _counted(cells: DataFrame, *keys: str) -> DataFrame:
    return cells.groupBy(*keys, "place").agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    )


def _select(cells: DataFrame, counts: DataFrame, wanted: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """The value of each wanted ``(id, rank)``."""
    if not wanted:
        return {}
    spark = cells.sparkSession
    # (id, rank, what is left of the rank inside the interval, the interval's values and bounds)
    brackets = _crossed(counts, [(i, rank, rank, None) for i, rank in wanted])
    found = {(b["id"], b["rank"]): b["low"] for b in brackets if b["low"] == b["high"]}
    still = [b for b in brackets if b["low"] < b["high"]]
    while wide := [b for b in still if b["n"] > CANDIDATES]:
        ranges = sorted({(b["id"], b["low"], b["high"]) for b in wide})
        numbers = {x: k for k, x in enumerate(ranges)}
        here = _inside(cells, [(k, *x) for x, k in numbers.items()])
        share = (F.col("value") / 2 - F.col("from") / 2) / (F.col("to") / 2 - F.col("from") / 2)
        again = cut(_counted(here.withColumn("place", F.floor(share * STEPS)), "range"))
        parts = _crossed(
            again.withColumnRenamed("range", "id"),
            [(numbers[b["id"], b["low"], b["high"]], b["rank"], b["left"], b["id"]) for b in wide],
        )
        still = [b for b in still if b["n"] <= CANDIDATES]
        for b in parts:
            b["id"] = b["owner"]
            if b["low"] == b["high"]:
                found[b["id"], b["rank"]] = b["low"]
            else:
                still.append(b)
    if still:
        numbers = {x: k for k, x in enumerate(sorted({(b["id"], b["low"], b["high"]) for b in still}))}
        here = _inside(cells, [(k, *x) for x, k in numbers.items()]).groupBy("range", "value").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(W.partitionBy("range").orderBy("value"))
        asked = spark.createDataFrame(
            [(numbers[b["id"], b["low"], b["high"]], b["id"], b["rank"], b["left"]) for b in still],
            "range int, id int, rank bigint, left bigint",
        )
        hit = here.withColumn("upto", upto).join(F.broadcast(asked), "range")
        hit = hit.where((F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("n")))
        found |= {(r["id"], r["rank"]): r["value"] for r in hit.select("id", "rank", "value").collect()}
    return found


def _crossed(counts: DataFrame, wanted: list[tuple]) -> list[dict]:
    """For each ``(id, rank, left, owner)`` the interval that holds place ``left`` of an id's values."""
    asked = counts.sparkSession.createDataFrame(wanted, "id int, rank bigint, left bigint, owner int")
    upto = F.sum("n").over(W.partitionBy("id").orderBy("place"))  # a row per interval
    met = counts.withColumn("upto", upto).join(F.broadcast(asked), "id")
    met = met.where((F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("n")))
    left = F.col("left") - (F.col("upto") - F.col("n"))
    return [r.asDict() for r in met.select("id", "rank", "owner", left.alias("left"), "n", "low", "high").collect()]


def _inside(cells: DataFrame, ranges: list[tuple[int, int, float, float]]) -> DataFrame:
    """Cells in ranges ``(range, id, from, to)``."""
    table = cells.sparkSession.createDataFrame(ranges, "range int, id int, from double, to double")
    return cells.join(F.broadcast(table), "id").where(F.col("value").between(F.col("from"), F.col("to"))).drop("id")
