"""Byte ranges of files whose meaning depends on what stands before them.

A range that starts somewhere in a file doesn't know whether it starts inside a quoted cell or a
comment, or how deep. Each range therefore reports, for every state it could start in, the state it
ends in and by how much the depth changes; the reports of a file are composed in order, and then every
range knows its start and can be read by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..storage import cut

RANGE_BYTES = 8 << 20
STEP_BYTES = 1 << 20  # read at a time beyond the end of a range

_RANGE = "path string, length long, start long, stop long"

#: For each state at the start: the state at the end, and the change of depth.
Report = Sequence[tuple[int, int]]


class Bytes:
    """A file whose bytes are read as far as they are asked for, from ``start`` on."""

    def __init__(self, path: str, start: int, length: int):
        from pyarrow import fs

        if path.startswith("file:"):
            path = "/" + path[len("file:") :].lstrip("/")
        elif path.startswith(("s3a://", "s3n://")):
            path = "s3://" + path.split("://", 1)[1]
        filesystem, name = fs.FileSystem.from_uri(path)
        self.file, self.start, self.length, self.data = filesystem.open_input_file(name), start, length, b""

    def extend(self, to: int) -> bool:
        """Hold at least the bytes up to offset ``to`` of the file; whether any came."""
        at = self.start + len(self.data)
        size = min(to, self.length) - at
        if size <= 0:
            return False
        self.file.seek(at)
        more = self.file.read(size)
        self.data += more
        return bool(more)

    def find(self, mark: bytes, offset: int) -> int:
        """Offset in the file of the first ``mark`` at or after ``offset``, or the file's length."""
        while True:
            self.extend(offset + len(mark))
            place = self.data.find(mark, offset - self.start)
            if place >= 0:
                return self.start + place
            offset = max(offset, self.start + len(self.data) - len(mark) + 1)
            if not self.extend(self.start + len(self.data) + STEP_BYTES):
                return self.length

    def __enter__(self) -> Bytes:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def aligned(source: Bytes, start: int, stop: int, mark: bytes, after: bool) -> tuple[int, int]:
    """The range from the first ``mark`` at or after ``start`` to the first at or after ``stop``.

    With ``after``, limits lie behind a mark that ends there, so a mark just before counts.
    """
    shift = len(mark) if after else 0

    def limit(offset: int) -> int:
        return 0 if offset == 0 else min(source.length, source.find(mark, offset - shift) + shift)

    source.extend(stop)
    return limit(start), limit(stop) if stop < source.length else source.length


def file_ranges(
    spark: SparkSession, path: str | Sequence[str], report: Callable[[bytes], Report], mark: bytes, after: bool
) -> DataFrame:
    """``(path, length, start, stop, state, depth)``: ranges of all files below ``path``, with their start.

    ``report`` gets the bytes of a range between marks. Files of one range aren't read for it. The
    table has a row per ``RANGE_BYTES`` and is kept in the shared folder; nothing comes to the driver.
    """
    range_bytes = RANGE_BYTES

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (path, length, start, min(length, start + range_bytes))
                for path, length in zip(batch["path"], batch["length"])
                for start in range(0, length, range_bytes)
            ]
            yield pd.DataFrame(rows, columns=["path", "length", "start", "stop"])

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ends, deltas = [], []
            for row in batch.itertuples():
                found: Report = []
                if row.length > range_bytes:
                    with Bytes(row.path, max(0, row.start - len(mark)), row.length) as source:
                        low, high = aligned(source, row.start, row.stop, mark, after)
                        if low < high:
                            source.extend(high)
                            found = report(source.data[low - source.start : high - source.start])
                ends.append([end for end, _ in found])
                deltas.append([delta for _, delta in found])
            yield batch.assign(ends=ends, deltas=deltas)

    def compose(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("start")
        state, depth, states, depths = 0, 0, [], []
        for ends, deltas in zip(parts["ends"], parts["deltas"]):
            states.append(state)
            depths.append(depth)
            if len(ends):  # a range without a mark changes nothing
                state, depth = int(ends[state]), depth + int(deltas[state])
        return parts[["path", "length", "start", "stop"]].assign(state=states, depth=depths)

    paths = path if isinstance(path, str) else list(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    files = files.select("path", "length").where("length > 0")
    tasks = 8 * spark.sparkContext.defaultParallelism
    ranges = cut(files.coalesce(tasks).mapInPandas(cut_up, _RANGE))
    spread = ranges.repartition(max(1, min(ranges.count(), 20_000)))
    described = spread.mapInPandas(describe, f"{_RANGE}, ends array<int>, deltas array<long>")
    placed = cut(described.groupBy("path").applyInPandas(compose, f"{_RANGE}, state int, depth long"))
    return placed.repartition(max(1, min(ranges.count(), 20_000)))
