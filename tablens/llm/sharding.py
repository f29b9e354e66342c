"""Shards by jump consistent hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import cut

DRAW_BITS = 32


def draw(key: Column, bucket: Column) -> Column:
    """A number in (0, 1] that the key and the bucket decide."""
    digits = F.substring(F.md5(F.concat_ws(":", key, bucket.cast("string"))), 1, DRAW_BITS // 4)
    return (F.conv(digits, 16, 10).cast("double") + 1) / F.lit(2.0**DRAW_BITS)


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a text key: the last bucket reached before a jump leaves the range.

    From bucket ``b`` the next jump goes to ``floor((b + 1) / draw)``. Jumps don't depend on the
    number of shards, so one more shard takes rows only into itself.
    """
    start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))

    def jump(state: Column, _: Column) -> Column:
        at = state["next"]
        further = F.struct(at.alias("at"), F.floor((at + 1) / draw(key, at)).alias("next"))
        return F.when(at < shards, further).otherwise(state)

    steps = F.sequence(F.lit(1), F.lit(shards))
    return F.aggregate(steps, start, jump, lambda state: state["at"].cast("int"))


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, one row per document.

    The id and the number of shards decide the shard; ``grown_shard`` is the one with a shard more.
    Slots count from 0 in each shard in the order of id, checksum and size; rows equal in all three
    take any order among themselves. ``size`` is the bytes of the text plus 1. Null texts have size
    1 and the checksum of the empty text; null ids form a key of their own and come last. An empty
    table gives no rows.

    Rows without their texts are range-partitioned once. Slots are local row numbers plus the counts
    of the partitions before.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        jump_hash(key, shards).alias("shard"),
        jump_hash(key, shards + 1).alias("grown_shard"),
    ).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_last(), F.col("text_crc32"), F.col("size"), F.col("row")]
    dealt = cut(
        rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    )
    local = W.partitionBy("part", "shard").orderBy(*order)
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = cut(
        dealt.groupBy("part", "shard")
        .count()
        .withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .select("part", "shard", "before")
    )
    placed = dealt.withColumn("place", F.row_number().over(local) - 1).join(offsets, ["part", "shard"])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("place") + F.col("before")).cast("long").alias("slot"),
        "grown_shard",
    )
