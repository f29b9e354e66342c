"""Global positions and average ranks without a one-partition window.

The data is range-partitioned by the ordering columns; a row's position is the number of
rows in earlier partitions (one small record per partition) plus its position inside its
own partition. Range boundaries are sampled per job, hence the ``cut`` between the two uses.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import cut
from .columns import chunks, collect_metrics, quoted, spread, union_all

# Values whose ranks are broadcast, over all expressions together, if each has one rank (about 100 bytes);
# with more ranks for partners they count for more. Other expressions are ranked by shuffle.
BROADCAST_RANKS = 2_000_000
# So many expressions at most have their ranks broadcast.
BROADCAST_JOINS = 40
# Expressions ranked by shuffle are cut into intervals of this share of the rows.
HOT_SHARE = 0.001
# Cells of a frequent value are dealt out to so many groups.
DEALS = 4096


def global_index(df: DataFrame, order_by: Sequence[str], name: str = "row_index") -> DataFrame:
    """``order_by`` columns plus the 0-based position of each row in their order.

    ``order_by`` should be unique: rows that tie on all of it are interchangeable here, and
    are spread over as many tasks as they fill. Only the ordering columns are shuffled.
    """
    keys = [quoted(c) for c in order_by]
    placed = cut(
        df.select(*keys, F.monotonically_increasing_id().alias("__row"))
        .repartitionByRange(*keys, "__row")
        .drop("__row")
        .withColumn("__part", F.spark_partition_id())
    )
    before = F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    starts = (
        placed.groupBy("__part")
        .agg(F.count("*").alias("n"))
        .select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    )
    local = F.row_number().over(W.partitionBy("__part").orderBy(*keys))
    return (
        placed.join(F.broadcast(starts), "__part")
        .withColumn(name, (F.col("__start") + local - 1).cast("bigint"))
        .drop("__part", "__start")
    )


def file_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """``df`` plus the 0-based position of each row in scan order; nothing is shuffled.

    For a direct file scan only: its splits, and the rows inside them, come in the same order
    in every job.
    """
    tagged = df.withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    sizes = tagged.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))  # a record per task
    before = F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    starts = F.broadcast(sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start")))
    index = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        tagged.withColumn("__part", part)
        .join(starts, "__part")
        .withColumn(name, index)
        .drop("__part", "__start", "__at")
    )


def long_counts(df: DataFrame, values: dict[str, Column], *keys: str) -> DataFrame:
    """``(name, *keys, value, n)`` of non-null values of several numeric expressions."""
    names = list(values)
    df = spread(df.select(*keys, *[values[n].alias(f"v{i}") for i, n in enumerate(names)]))
    frames = []
    for group in chunks(names, 200):
        frames.append(
            df.select(*keys, *[f"v{names.index(n)}" for n in group])
            .unpivot(list(keys), [f"v{names.index(n)}" for n in group], "id", "value")
            .where(F.col("value").isNotNull())
        )
    label = F.element_at(F.lit(names), F.substring("id", 2, 9).cast("int") + 1)
    return (
        union_all(frames)
        .groupBy("id", *keys, "value")
        .agg(F.count("*").alias("n"))
        .select(label.alias("name"), *keys, "value", "n")
    )


def average_ranks(counts: DataFrame) -> DataFrame:
    """``(name, value, n, rank)`` from distinct ``(name, value, n)``: mean 1-based rank.

    Works on value counts, so ties are already one row each.
    """
    placed = cut(
        counts.select("name", "value", "n")
        .repartitionByRange("name", "value")
        .withColumn("__part", F.spark_partition_id())
    )
    before = F.sum("total").over(
        W.partitionBy("name").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    )
    starts = (
        placed.groupBy("name", "__part")
        .agg(F.sum("n").alias("total"))
        .select("name", "__part", F.coalesce(before, F.lit(0)).alias("__start"))
    )
    upto = F.sum("n").over(W.partitionBy("name", "__part").orderBy("value"))
    return placed.withColumn("__upto", upto).join(
        F.broadcast(starts), ["name", "__part"]
    ).select(
        "name",
        "value",
        "n",
        (F.col("__start") + F.col("__upto") - (F.col("n") - 1) / 2).alias("rank"),
    )


def pairwise_ranks(df: DataFrame, values: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """One row per row of ``df`` with an array of average ranks per expression, null for null.

    The first rank counts all rows in which the expression is there; the others only the rows in which
    another expression is there as well, one for each expression that has nulls. The second result
    says at which place of the arrays the ranks for a partner stand.

    Expressions with few distinct values (``BROADCAST_RANKS``) get their ranks by broadcast in the row
    itself, without a shuffle. The cells of all others go in long form, once to the interval of their
    value and once back to their row; the number of jobs and shuffles depends neither on the number of
    expressions nor on their nulls.
    """
    names = list(values)
    every = [f"v{i}" for i in range(len(names))]
    # -0.0 and 0.0 are one value
    rows = spread(df.select(*[F.when(values[n] == 0, 0.0).otherwise(values[n]).alias(v) for n, v in zip(names, every)]))
    facts = collect_metrics(
        rows,
        every,
        {
            "rows": lambda c: F.count("*"),
            "n": lambda c: F.count(c),
            "distinct": lambda c: F.approx_count_distinct(c, 0.05),
        },
    )
    gappy = [v for v in every if facts[v]["n"] < facts[v]["rows"]]
    places = range(len(gappy) + 1)
    # a value takes about 90 bytes and 8 for each of its ranks
    few = _few_values({v: facts[v]["distinct"] * (11 + len(places)) / 12 for v in every})
    many = [v for v in every if v not in few]
    if many:  # stored once, so that a row has the same number in every retry of a task
        rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    ranked = _ranks_by_broadcast(rows, few, gappy) if few else rows
    if many:
        slots = [f"r{v}_{k}" for v in every for k in places]
        own = [f"r{v}_{k}" for v in few for k in places]
        cells = _ranks_by_interval(rows, many, gappy)
        apart = [
            F.when(F.col("id") == int(v[1:]), F.col(f"rank{k}")).alias(f"r{v}_{k}") for v in many for k in places
        ]
        together = cells.select("row", *apart).unionByName(ranked.select("row", *own), allowMissingColumns=True)
        # dealt out by row before the grouping: nothing could be combined earlier
        ranked = together.repartition("row").groupBy("row").agg(*[F.max(c).alias(c) for c in slots])
    out = ranked.select(*[F.array(*[f"r{v}_{k}" for k in places]).alias(n) for n, v in zip(names, every)])
    return out, {n: gappy.index(v) + 1 if v in gappy else 0 for n, v in zip(names, every)}


def _few_values(sizes: dict[str, float]) -> list[str]:
    """The expressions whose ranks are broadcast: smallest first, up to the limit in all."""
    few, total = [], 0
    for v in sorted(sizes, key=sizes.get)[:BROADCAST_JOINS]:
        total += sizes[v]
        if total <= BROADCAST_RANKS:
            few.append(v)
    return few


def _presence(gappy: Sequence[str]) -> tuple[list[Column], list[Column]]:
    """Words of bits that say which expressions a row has, and one 0 or 1 per expression out of them."""
    words = []
    for k, group in enumerate(chunks(gappy, 62)):
        bits = [F.when(F.col(v).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, v in enumerate(group)]
        words.append(reduce(Column.bitwiseOR, bits).alias(f"there{k}"))
    there = [F.shiftright(f"there{k // 62}", k % 62).bitwiseAND(F.lit(1)) for k in range(len(gappy))]
    return words, there


def _sizes(there: Sequence[Column]) -> list[Column]:
    return [F.count("*").alias("n0"), *[F.sum(x).alias(f"n{k + 1}") for k, x in enumerate(there)]]


def _ranks_by_broadcast(rows: DataFrame, few: Sequence[str], gappy: Sequence[str]) -> DataFrame:
    """``rows`` plus the ranks ``r<expression>_<place>`` of expressions with few distinct values."""
    words, there = _presence(gappy)
    cells = (
        rows.select(*words, *few)
        .unpivot([f"there{k}" for k in range(len(words))], list(few), "id", "value")
        .where(F.col("value").isNotNull())
    )
    upto = W.partitionBy("id").orderBy("value")
    places = range(len(gappy) + 1)
    counts = cells.groupBy("id", "value").agg(*_sizes(there))
    ranks = cut(
        counts.select("id", "value", *[(F.sum(f"n{k}").over(upto) - (F.col(f"n{k}") - 1) / 2).alias(f"rank{k}") for k in places])
    )
    for v in few:
        own = [F.col(f"rank{k}").alias(f"r{v}_{k}") for k in places]
        rows = rows.join(F.broadcast(ranks.where(F.col("id") == v).select(F.col("value").alias(v), *own)), v, "left")
    return rows


def _ranks_by_interval(rows: DataFrame, many: Sequence[str], gappy: Sequence[str]) -> DataFrame:
    """``(row, id, rank0, rank1, …)`` of each cell of expressions with many distinct values.

    Approximate quantiles cut every expression into intervals of about ``HOT_SHARE`` of its rows. A
    value that fills more than that is the lower end of an interval. One aggregate counts the cells on
    the lower ends and inside the intervals: the former have their ranks from these counts and are
    dealt out by row, the latter have them from their order inside the interval, which one task sorts.
    """
    steps = round(1 / HOT_SHARE)
    shares = [i / steps for i in range(steps)]
    ends = rows.agg(*[F.percentile_approx(v, shares, 4 * steps).alias(v) for v in many]).first()
    splits = {
        v: [float("-inf"), *sorted({x for x in ends[v] or () if math.isfinite(x)} or {0.0}), float("inf")] for v in many
    }
    words, there = _presence(gappy)
    cut_up = Bucketizer(
        splitsArray=[splits[v] for v in many], inputCols=list(many), outputCols=[f"in_{v}" for v in many], handleInvalid="keep"
    ).transform(rows)
    # intervals of all expressions are numbered one after the other; the last one of each is for NaN
    first = {v: int(v[1:]) * (steps + 2) for v in many}
    lows = [(first[v] + i, int(v[1:]), x) for v in many for i, x in enumerate(splits[v])]
    intervals = F.broadcast(rows.sparkSession.createDataFrame(lows, "interval int, id int, low double"))
    pairs = [F.struct((F.col(f"in_{v}").cast("int") + first[v]).alias("interval"), F.col(v).alias("value")) for v in many]
    cells = (
        cut_up.select("row", *words, F.inline(F.array(*pairs)))
        .where(F.col("value").isNotNull())
        .join(intervals, "interval")
        .withColumn("on_end", F.col("value") == F.col("low"))
        .drop("low")
    )
    places = range(len(gappy) + 1)
    of_place = [F.lit(1), *there]
    counts = cells.groupBy("id", "interval").agg(
        *[F.sum(x).alias(f"n{k}") for k, x in zip(places, of_place)],
        *[F.sum(F.when(F.col("on_end"), x).otherwise(0)).alias(f"ends{k}") for k, x in zip(places, of_place)],
    )
    upto = W.partitionBy("id").orderBy("interval")
    starts = counts.select("id", "interval", *[(F.sum(f"n{k}").over(upto) - F.col(f"n{k}")).alias(f"start{k}") for k in places],
                           *[f"ends{k}" for k in places])
    starts = F.broadcast(cut(starts))
    # 0 inside an interval
    deal = F.when(F.col("on_end"), F.pmod("row", F.lit(DEALS)).cast("int") + 1).otherwise(0)
    placed = cells.select("row", "interval", "value", *[f"there{k}" for k in range(len(words))], deal.alias("deal"))
    order = W.partitionBy("interval", "deal").orderBy("value")
    same = W.partitionBy("interval", "deal", "value")
    # cells up to this value and below it; in the first place, the rank tells the latter
    upto = {"upto0": F.count("*").over(order), "below0": F.rank().over(order) - 1}
    upto |= {f"upto{k}": F.sum(of_place[k]).over(order) for k in places[1:]}
    below = {f"below{k}": F.col(f"upto{k}") - F.sum(of_place[k]).over(same) for k in places[1:]}
    rank = [
        F.col(f"start{k}") + F.when(F.col("deal") > 0, (F.col(f"ends{k}") + 1) / 2)
        .otherwise(F.col(f"ends{k}") + (F.col(f"below{k}") + F.col(f"upto{k}") + 1) / 2)
        for k in places
    ]
    return placed.withColumns(upto).withColumns(below).join(starts, "interval").select(
        "row", "id", *[r.alias(f"rank{k}") for k, r in zip(places, rank)]
    )


def attach_ranks(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """One row per row of ``df`` with the average rank of each expression, null for null."""
    ranks, _ = pairwise_ranks(df, values)
    return ranks.select(*[quoted(n)[0].alias(n) for n in values])
