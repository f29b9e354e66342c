"""The first bytes of every file below a path, read by the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

HEAD_BYTES = 65536


def read_range(path: str, size: int | None = HEAD_BYTES) -> bytes:
    """First ``size`` bytes of a file named by a Hadoop-style URI (all of it for ``None``)."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    elif path.startswith(("s3a://", "s3n://")):
        path = "s3://" + path.split("://", 1)[1]
    filesystem, name = fs.FileSystem.from_uri(path)
    with filesystem.open_input_stream(name, compression=None) as stream:
        return stream.read(size) if size is not None else stream.read()


def read_head(path: str, lines: int) -> bytes:
    """``HEAD_BYTES`` of a file, or more until ``lines`` lines that aren't blank have ended."""
    size = HEAD_BYTES
    while True:
        head = read_range(path, size)
        if len(head) < size or len([x for x in head.split(b"\n")[:-1] if x.strip()]) >= lines:
            return head
        size *= 4


def file_heads(spark: SparkSession, path: str, lines: int = 0) -> DataFrame:
    """``(path, head)``: one row per file; only the listing and the heads are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "head": batch["path"].map(lambda p: read_head(p, lines))})

    # the scan makes a task per 128 MB of files, though only their heads are read
    tasks = 8 * spark.sparkContext.defaultParallelism
    return files.select("path").coalesce(tasks).mapInPandas(read, "path string, head binary")
