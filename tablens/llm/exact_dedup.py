"""Exact deduplication by digest, with the heavy hitters split off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut

HEAVY = 1000  # counters of a Misra-Gries summary; the broadcast has at most so many rows


def normal_text(text: Column) -> Column:
    """Runs of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def frequent(digests: DataFrame, column: str) -> DataFrame:
    """At most ``HEAVY`` values, among them all with more than a ``HEAVY``-th of the rows.

    Each task summarises its rows in ``HEAVY`` Misra-Gries counters, and only these travel.
    """
    named = digests.stat.freqItems([column], 1 / HEAVY)
    return named.select(F.explode(f"{column}_freqItems").alias(column))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``(doc_id, keep_id, group_size, kept, text_sha256)``.

    Texts are equal when they are identical after runs of ASCII white space become one space. The
    row with the smallest id stays; of rows with the same id, one stays. Null texts count as empty
    texts, and null ids come after all others (``keep_id`` is null if a group has no other). An
    empty table gives no rows; other columns are not read.

    Only digests are shuffled. Digests that the summaries name are counted, and those that do
    repeat are broadcast (at most ``HEAVY`` rows), so their rows are settled where they are read.
    """
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.sha2(normal_text(F.col(text_col)), 256).alias("text_sha256"),
        ).withColumn("row", F.monotonically_increasing_id())
    )
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    size = F.count("*").alias("group_size")

    named = frequent(rows, "text_sha256")
    winners = cut(
        rows.join(F.broadcast(named), "text_sha256")
        .groupBy("text_sha256")
        .agg(size, first)
        .where("group_size > 1")
    )
    hot = rows.join(F.broadcast(winners), "text_sha256")
    others = rows.join(F.broadcast(winners), "text_sha256", "left_anti")
    groups = others.groupBy("text_sha256").agg(size, first)
    settled = hot.unionByName(others.join(groups, "text_sha256"))
    return settled.select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
    )
