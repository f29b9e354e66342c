"""Mutual information between columns of any type."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import digitized_label
from .columns import as_text, chunks, collect_metrics, is_floating, is_numeric, quoted, short_form, spread, union_all
from .frequencies import distinct_counts

PAIRS_PER_PASS = 300


def mutual_info_pairs(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    bins: int = 20,
    skip: Sequence[str] = (),
) -> DataFrame:
    """``(col_a, col_b, mutual_info, n)`` in nats for every pair, over the pair's complete rows.

    Numeric columns are cut into equal-width bins between the extremes of those rows, other
    columns are taken as they are. Every row yields one small record per pair; equal records
    are combined before the shuffle, and entropies need no window, so neither a frequent
    value nor a wide group ends up in one task.
    """
    names = [c for c in (columns or df.columns) if c not in set(skip)]
    pairs = list(combinations(names, 2))
    if not pairs:
        return df.sparkSession.createDataFrame(
            [], "col_a string, col_b string, mutual_info double, n bigint"
        )
    return union_all([_pairs_pass(df, group, bins) for group in chunks(pairs, PAIRS_PER_PASS)])


def top_mutual_info_pairs(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    bins: int = 20,
    top_k: int = 3,
    skip: Sequence[str] = (),
) -> DataFrame:
    """The pairs of largest mutual information at 5 decimals (ties by name)."""
    return (
        mutual_info_pairs(df, columns, bins, skip)
        .select("col_a", "col_b", F.round("mutual_info", 5).alias("mutual_info"))
        .orderBy(F.desc("mutual_info"), "col_a", "col_b")
        .limit(top_k)
    )


def _pairs_pass(df: DataFrame, pairs: Sequence[tuple[str, str]], bins: int) -> DataFrame:
    names = sorted({c for pair in pairs for c in pair})
    numeric = {c for c in names if is_numeric(df.schema[c].dataType)}
    limits = _limits(df, pairs, numeric)
    unique = _unique(df, [c for c in names if c not in numeric])
    cells = spread(df.select(*[quoted(c) for c in names]))
    labels: dict[tuple, str] = {}
    columns: list[Column] = []
    records: list[Column] = []
    for i, (a, b) in enumerate(pairs):
        sides = []
        for name, other in ((a, b), (b, a)):
            key = (name, *limits.get((name, other), limits.get((name, None), ())))
            if key not in labels:
                labels[key] = f"l{len(labels)}"
                if name in unique:  # the value itself is not needed, see below
                    label = F.when(quoted(name).isNotNull(), F.lit(""))
                else:
                    label = _label(df, name, key[1:], bins)
                columns.append(label.alias(labels[key]))
            sides.append(labels[key])
        records += [F.lit(i), F.col(sides[0]), F.col(sides[1])]
    joint = (
        cells.select(*columns)
        .select(F.stack(F.lit(len(pairs)), *records).alias("pair", "a", "b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .groupBy("pair", "a", "b")
        .agg(F.count("*").alias("n"))
    )
    both = joint.groupBy("pair").agg(
        F.sum(_n_log_n("n")).alias("joint"), F.sum("n").alias("n")
    )
    sides = [
        joint.groupBy("pair", side)
        .agg(F.sum("n").alias("n"))
        .groupBy("pair")
        .agg(F.sum(_n_log_n("n")).alias(f"side_{side}"))
        for side in ("a", "b")
    ]
    name = F.element_at(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("col_a"),
                    F.lit(b).alias("col_b"),
                    F.lit(a in unique).alias("unique_a"),
                    F.lit(b in unique).alias("unique_b"),
                )
                for a, b in pairs
            ]
        ),
        F.col("pair") + 1,
    )
    n = F.col("n").cast("double")
    # a unique side occurs once per row, and so does every combination with it
    joint_sum = F.when(F.col("names.unique_a") | F.col("names.unique_b"), 0.0).otherwise(F.col("joint"))
    side_sum = F.when(F.col("names.unique_a"), 0.0).otherwise(F.col("side_a")) + F.when(
        F.col("names.unique_b"), 0.0
    ).otherwise(F.col("side_b"))
    information = F.greatest(F.lit(0.0), F.ln(n) + (joint_sum - side_sum) / n)
    found = both.join(F.broadcast(sides[0]), "pair").join(F.broadcast(sides[1]), "pair")
    all_pairs = df.sparkSession.range(len(pairs)).select(F.col("id").cast("int").alias("pair"))
    return (
        all_pairs.join(F.broadcast(found), "pair", "left")
        .withColumn("names", name)
        .select(
            "names.col_a",
            "names.col_b",
            F.coalesce(information, F.lit(0.0)).alias("mutual_info"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def _unique(df: DataFrame, names: Sequence[str]) -> set[str]:
    """Columns whose non-null values are all different (identifiers, free text).

    Their pairs need no joint counts, which would be as large as the table. Uniqueness is
    counted exactly, for columns that a sketch finds close to it.
    """
    if not names:
        return set()
    facts = collect_metrics(
        df,
        names,
        {
            "filled": lambda c: F.count(quoted(c)),
            "near": lambda c: F.approx_count_distinct(as_text(df, c), 0.02),
        },
    )
    likely = [c for c in names if facts[c]["near"] > 0.8 * facts[c]["filled"] > 0]
    if not likely:
        return set()
    counts = {r["column_name"]: r["n_values"] for r in distinct_counts(df, likely).collect()}
    return {c for c in likely if counts[c] == facts[c]["filled"]}


def _n_log_n(count: str) -> Column:
    n = F.col(count).cast("double")
    return n * F.ln(n)


def _limits(df, pairs, numeric) -> dict[tuple[str, str | None], tuple]:
    """Extremes per numeric column, and per pair where the other column has nulls."""
    names = sorted({c for pair in pairs for c in pair})
    known = collect_metrics(
        df,
        names,
        {
            "low": lambda c: F.min(_finite(df, c)) if c in numeric else F.first(F.lit(None).cast("double")),
            "high": lambda c: F.max(_finite(df, c)) if c in numeric else F.first(F.lit(None).cast("double")),
            "nulls": lambda c: F.count_if(quoted(c).isNull()),
        },
    )
    limits: dict[tuple[str, str | None], tuple] = {}
    restricted = []
    for a, b in (p for pair in pairs for p in (pair, pair[::-1])):
        if a not in numeric:
            continue
        if known[b]["nulls"] == 0:
            limits[a, None] = (known[a]["low"], known[a]["high"])
        else:
            restricted.append((a, b))
    by_key = {f"{i}": p for i, p in enumerate(restricted)}
    within = {
        k: F.when(quoted(b).isNotNull(), _finite(df, a)) for k, (a, b) in by_key.items()
    }
    for k, m in collect_metrics(
        df, list(by_key), {"low": lambda k: F.min(within[k]), "high": lambda k: F.max(within[k])}
    ).items():
        limits[by_key[k]] = (m["low"], m["high"])
    return limits


def _finite(df: DataFrame, name: str) -> Column:
    value = quoted(name).cast("double")
    return F.when(~F.isnan(value), value) if is_floating(df.schema[name].dataType) else value


def _label(df: DataFrame, name: str, limits: tuple, bins: int) -> Column:
    """Text label of a column: its bin between the limits, or the value without limits."""
    if not limits:
        return short_form(as_text(df, name))
    low, high = (F.lit(v).cast("double") for v in limits)
    value = quoted(name).cast("double")
    label = digitized_label(value, low, high, bins)
    if is_floating(df.schema[name].dataType):
        label = F.when(F.isnan(value), F.lit(bins + 1)).otherwise(label)
    return label.cast("string")
