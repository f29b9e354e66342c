"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

HELD = 1 << 20  # edges that a task joins at once


def forest(a: list, b: list) -> tuple[list, list]:
    """Edges from each node to the least node that it reaches over the given edges."""
    nodes = sorted({*a, *b})
    number = {node: k for k, node in enumerate(nodes)}
    x, y = (np.fromiter(map(number.__getitem__, side), np.int64, len(side)) for side in (a, b))
    least = np.arange(len(nodes))
    while True:
        low = np.minimum(least[x], least[y])
        before = least.copy()
        for side in (x, y):
            np.minimum.at(least, before[side], low)  # the roots hang on the lower one
        while (least[least] != least).any():
            least = least[least]
        if (least == before).all():
            break
    below = np.flatnonzero(least < np.arange(len(nodes))).tolist()
    return [nodes[k] for k in below], [nodes[k] for k in least[below].tolist()]


def forests(edges: DataFrame) -> DataFrame:
    """``edges (a, b)`` with what each task reads reduced to stars: at most one edge per node and ``HELD`` edges."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kinds = ([], []), None

        def stars() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, kinds) for x in forest(*held)], ["a", "b"])

        for batch in batches:
            kinds = batch.column(0).type
            held[0].extend(batch.column(0).to_pylist())
            held[1].extend(batch.column(1).to_pylist())
            if len(held[0]) > HELD:
                yield stars()
                held = ([], [])
        if held[0]:
            yield stars()

    kind = edges.schema["a"].dataType.simpleString()
    return edges.select("a", "b").mapInArrow(reduce, f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)``: the least node reachable over the edges ``(a, b)``.

    Each task first joins the edges it reads, so that a node keeps one edge, to the least it reaches
    there; a node then has at most one edge per task and ``HELD`` edges to a lower one, however many
    neighbours it has. In a round, a node and its lower neighbours hang on the least of these, and
    then each on what that one hangs on; tasks join the outcome again. Rounds grow with the logarithm
    of the longest path, each is one window and one join (whose hot keys may be split) and a written
    table, and they go on until nothing moves. Only a count and a checksum reach the driver.
    """
    edges = written(forests(edges.where("a != b")))
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).distinct()
        before = now
        lower = edges.distinct().withColumn("least", F.min("b").over(Window.partitionBy("a")))
        hung = lower.select("a", F.col("least").alias("b")).unionByName(
            lower.where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        )
        hung = hung.distinct()  # many nodes of a group hang in the same way
        above = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("up"))
        edges = written(forests(hung.join(above, "b", "left").select("a", F.coalesce("up", "b").alias("b"))))
