"""Repeatable samples of bounded size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import columns_where, is_datetime, quoted
from .frequencies import bounded_counts
from .order import file_index, global_index

SEED = 42
FEW_VALUES = 20
# Samples up to this size are matched back to the table by broadcast.
BROADCAST_KEYS = 100_000
# Up to so many rows a stratum, Spark keeps only the best rows of each task before a window's shuffle.
WINDOW_ROWS = 1000


def _draw(key: Sequence[str] | None, seed: int) -> Column:
    """A number that decides which rows are taken: from the key, else from the row's place.

    With a unique key the sample depends on the data alone. Without one it is repeatable for
    a direct file scan; copies of a row still get different numbers.
    """
    if key:
        return F.xxhash64(F.lit(seed), *[quoted(c) for c in key])
    return F.rand(seed)


def systematic_sample(
    df: DataFrame, max_rows: int, order_by: Sequence[str] | None = None
) -> DataFrame:
    """Rows 0, step, 2·step, … with ``step = max(1, rows // max_rows)``.

    Only the columns of ``order_by`` and a hash of the row, by which ties are ordered, are sorted, and
    the few chosen rows are matched back to the table by both. Rows that are equal throughout are one
    row with a count until the end. Without ``order_by``, rows keep their scan order and nothing is
    shuffled.
    """
    step = max(1, df.count() // max_rows)
    wanted = F.pmod(F.col("row_index"), F.lit(step)) == 0
    if not order_by:
        return file_index(df).where(wanted).drop("row_index")
    names = [f"__k{i}" for i in range(len(order_by))]
    keyed = df.withColumn("__hash", _row_hash(df))
    places = keyed.select(*[quoted(c).alias(n) for c, n in zip(order_by, names)], "__hash")
    chosen = global_index(places, [*names, "__hash"]).where(wanted)
    taken = chosen.withColumnRenamed("__hash", "__chosen").groupBy(*names, "__chosen").agg(F.count("*").alias("__taken"))
    if max_rows <= BROADCAST_KEYS:  # fewer than 2 * max_rows keys
        taken = F.broadcast(taken)
    match = [F.col("__hash") == F.col("__chosen")]
    match += [quoted(c).eqNullSafe(F.col(n)) for c, n in zip(order_by, names)]
    return _copies(keyed.join(taken, match), df, [*names, "__hash"], F.first("__taken"))


def _row_hash(df: DataFrame) -> Column:
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    maps = [F.to_json(quoted(f.name)) for f in df.schema.fields if isinstance(f.dataType, T.MapType)]
    return F.xxhash64(*[quoted(c) for c in plain], *maps)


def _copies(rows: DataFrame, df: DataFrame, keys: Sequence[str], number: Column) -> DataFrame:
    """Of rows that are equal, as many as the aggregate ``number`` says; one row a task is kept on the way."""
    whole = F.struct(*[quoted(c) for c in df.columns])
    one = rows.groupBy(*keys).agg(F.first(whole).alias("__whole"), number.alias("__number"))
    many = one.select("__whole", F.explode(F.sequence(F.lit(1), F.col("__number").cast("int"))))
    return many.select("__whole.*")


DIGIT = 16  # bits of a draw that one pass decides on
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def smallest_draws(df: DataFrame, group: Column, draws: Sequence[Column], k: int) -> DataFrame:
    """The ``k`` rows of each group with the smallest draws (two 64-bit numbers), all of smaller groups.

    Selection by digits: a pass counts the next ``DIGIT`` bits inside the one interval that holds a
    group's last row and so narrows it; two or three passes are enough for draws that are spread out.
    Then one filter against a bar per group takes the rows; no group is sorted or meets in a task.
    Rows with both draws equal count as copies of one row. Groups come to the driver, rows don't.
    """
    drawn = df.withColumns({"__group": group, "__d0": draws[0], "__d1": draws[1]}).where("__group is not null")
    slim = drawn.select("__group", "__d0", "__d1")
    kind = slim.schema["__group"].dataType
    sizes = {r[0]: r[1] for r in slim.groupBy("__group").count().where(F.col("count") > k).collect()}
    bars = {g: {"need": k, "d0": None, "d1": None, "copies": 0} for g in sizes}
    for word in ("d0", "d1"):
        still = {g: (bar["need"], 0) for g, bar in bars.items() if bar[word] is None and not bar["copies"] and bar["need"]}
        for shift in range(64 - DIGIT, -1, -DIGIT):
            still = {g: x for g, x in still.items() if bars[g][word] is None}
            if not still:
                break
            rows = [(g, need, prefix, bars[g]["d0"]) for g, (need, prefix) in still.items()]
            schema = T.StructType([T.StructField("__group", kind), *[T.StructField(n, T.LongType()) for n in ("need", "prefix", "first")]])
            open_groups = F.broadcast(df.sparkSession.createDataFrame(rows, schema))
            here = slim.join(open_groups, "__group")
            if word == "d1":
                here = here.where(F.col("__d0") == F.col("first"))
            if shift < 64 - DIGIT:
                here = here.where(F.shiftright(f"__{word}", shift + DIGIT) == F.col("prefix"))
            counts = here.groupBy("__group", "need", F.shiftright(f"__{word}", shift).alias("digit")).agg(F.count("*").alias("n"))
            upto = F.sum("n").over(W.partitionBy("__group").orderBy("digit"))  # 2 ** DIGIT digits at most
            crossing = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
            for r in crossing.collect():
                need = r.need - (r.upto - r.n)
                still[r["__group"]] = (need, r.digit)
                if need == r.n:  # the whole interval is in
                    bars[r["__group"]][word] = (r.digit << shift) + (1 << shift) - 1
                    bars[r["__group"]]["need"] = 0
                elif shift == 0:
                    bars[r["__group"]][word] = r.digit
                    bars[r["__group"]]["need"] = need
                    if word == "d1":
                        bars[r["__group"]]["copies"] = need
    limits = []
    for g, bar in bars.items():
        closed = bar["d1"] is None
        limits.append((g, bar["d0"], MOST if closed else bar["d1"], bar["copies"]))
    schema = T.StructType([T.StructField("__group", kind), *[T.StructField(n, T.LongType()) for n in ("b0", "b1", "copies")]])
    table = F.broadcast(df.sparkSession.createDataFrame(limits, schema))
    met = drawn.join(table, "__group", "left")
    tied = (F.col("__d0") == F.col("b0")) & (F.col("__d1") == F.col("b1")) & (F.col("copies") > 0)
    inside = (F.col("__d0") < F.col("b0")) | ((F.col("__d0") == F.col("b0")) & (F.col("__d1") <= F.col("b1")))
    taken = met.where(F.col("b0").isNull() | (inside & ~tied)).select(*[quoted(c) for c in df.columns])
    if not any(bar["copies"] for bar in bars.values()):
        return taken
    return taken.unionByName(_copies(met.where(tied), df, ["__group"], F.first("copies")))


def stratum_candidates(df: DataFrame, max_rows: int) -> list[tuple[str, int]]:
    """Text columns and columns of fewer than 20 values, fewest distinct values first."""
    texts = set(columns_where(df, lambda t: isinstance(t, T.StringType)))
    usable = columns_where(df, lambda t: not isinstance(t, (T.ArrayType, T.StructType, T.MapType)))
    counts = bounded_counts(df, usable, max(max_rows, FEW_VALUES))
    found = [(c, counts[c]) for c in usable if c in texts or counts[c] < FEW_VALUES]
    return sorted(found, key=lambda item: item[1])


def stratified_sample(
    df: DataFrame,
    max_rows: int,
    column: str | None = None,
    key: Sequence[str] | None = None,
    seed: int = SEED,
) -> DataFrame:
    """At most ``max(1, max_rows // strata)`` random rows of each stratum, ``max_rows`` in all.

    A null stratum counts as one but gives no rows. For a few rows a stratum, each task keeps
    only its own best rows per stratum before the shuffle; for more, see ``smallest_draws``. A large
    stratum stays spread out either way.
    """
    if column is None:
        candidates = stratum_candidates(df, max_rows)
        if not candidates:
            return df.limit(0)
        column, strata = candidates[0]
    else:
        # above max_rows every stratum gives one row, so an approximate count will do
        strata = bounded_counts(df, [column], max_rows)[column]
    per_stratum = max(1, max_rows // max(1, strata))
    if per_stratum > WINDOW_ROWS:
        first = _draw(key, seed) if key else F.xxhash64(F.lit(seed), _row_hash(df))
        return smallest_draws(df, quoted(column), [first, _row_hash(df)], per_stratum)
    place = F.row_number().over(W.partitionBy(quoted(column)).orderBy("__draw"))
    return (
        df.where(quoted(column).isNotNull())
        .withColumn("__draw", _draw(key, seed))
        .withColumn("__place", place)
        .where(F.col("__place") <= per_stratum)
        .orderBy(quoted(column), "__place")
        .limit(max_rows)
        .drop("__draw", "__place")
    )


def random_sample(
    df: DataFrame, n: int, key: Sequence[str] | None = None, seed: int = SEED
) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, each equally likely; a top-n per task, then one merge."""
    return (
        df.withColumn("__draw", _draw(key, seed)).orderBy("__draw").limit(n).drop("__draw")
    )


def sample_auto(
    df: DataFrame,
    max_rows: int,
    order_by: Sequence[str] | None = None,
    key: Sequence[str] | None = None,
    seed: int = SEED,
) -> tuple[str, DataFrame]:
    """Name of the strategy that applies, and its sample.

    Small tables are kept whole; tables with a date are sampled systematically; tables with a
    categorical column by stratum; all others at random.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return "no_sample", df
    dated = columns_where(df, lambda t: is_datetime(t) or isinstance(t, T.DateType))
    if dated:
        return "systematic_sample", systematic_sample(df, max_rows, order_by)
    for column, _ in stratum_candidates(df, max_rows):
        sample = stratified_sample(df, max_rows, column, key, seed)
        if not sample.isEmpty():
            return "stratified_sample", sample
    return "random_sample", random_sample(df, max_rows, key, seed)
