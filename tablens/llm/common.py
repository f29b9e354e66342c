"""Helpers of the operators on documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import scratch_path

WORD_BITS = 64
BITMAP_ROWS = 1 << 18  # words of a bitmap


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: nothing of its plan goes on."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def bitmap_of(hashes: DataFrame, column: str, words: int) -> DataFrame:
    """A bitmap of 64-bit hashes: ``(word_no, word)``, at most ``words`` rows whatever the input.

    A hash sets one of ``64 * words`` bits. Testing never misses a member; the share of false
    hits grows with the number of members, so a test only saves work and decides nothing.
    """
    place = F.pmod(F.col(column), F.lit(words * WORD_BITS))
    return (
        hashes.select(
            (place / WORD_BITS).cast("long").alias("word_no"),
            F.expr(f"shiftleft(1L, cast(pmod({column}, {WORD_BITS}L) as int))").alias("bit"),
        )
        .groupBy("word_no")
        .agg(F.bit_or("bit").alias("word"))
    )


def in_bitmap(df: DataFrame, column: str, bitmap: DataFrame, words: int) -> DataFrame:
    """Rows of ``df`` whose hash may be in the bitmap (a broadcast of at most ``words`` rows)."""
    flag = F.expr(f"(shiftright(word, cast(pmod({column}, {WORD_BITS}L) as int)) & 1L) = 1L")
    place = F.pmod(F.col(column), F.lit(words * WORD_BITS))
    return (
        df.withColumn("word_no", (place / WORD_BITS).cast("long"))
        .join(F.broadcast(bitmap), "word_no")
        .where(flag)
        .drop("word_no", "word")
    )
