"""Records of delimited files with line breaks inside quotes, cut out of byte ranges."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import Bytes, Report, aligned, file_ranges

RECORD, QUOTED = range(2)  # states behind a line break
_BOM = b"\xef\xbb\xbf"


class Cutter:
    """Finds the ends of records: line breaks outside of cells that begin with a quote."""

    def __init__(self, sep: str, quote: str, encoding: str):
        s, q = (re.escape(x.encode(encoding)) for x in (sep, quote))
        rest = rb"[^%b]*(?:%b%b[^%b]*)*" % (q, q, q, q)
        # both start with one byte that the search can skip to; only then is looked what stands before a quote
        begins = rb"(?:(?<=%b%b)|(?<=\n%b)|(?<=%b%b)|(?<![\s\S]%b))" % (s, q, q, re.escape(_BOM), q, q)
        self.mark = re.compile(rb"\n|%b%b%b(?P<close>%b)?" % (q, begins, rest, q))
        self.rest = re.compile(rest + q)

    def report(self, data: bytes) -> Report:
        """End state of a range that starts behind a line break, for both states at its start."""
        lines: set[int] = set()
        state = RECORD
        for mark in self.mark.finditer(data):
            if mark.group() == b"\n":
                lines.add(mark.start())
            elif not mark["close"]:
                state = QUOTED
        inside = self.rest.match(data)
        if inside is None:
            return [(state, 0), (QUOTED, 0)]
        other = RECORD
        for mark in self.mark.finditer(data, inside.end()):
            if mark.group() == b"\n":
                if mark.start() in lines:  # from here on all is as seen from a record's start
                    other = state
                    break
            elif not mark["close"]:
                other = QUOTED
        return [(state, 0), (other, 0)]

    def records(self, source: Bytes, start: int, stop: int, state: int) -> Iterator[bytes]:
        """Records that start in the range, whole, also where they end beyond it."""
        source.extend(stop)
        position, limit = start - source.start, stop - source.start

        def more() -> bool:
            return source.extend(source.start + 2 * len(source.data) + 1024)

        if state == QUOTED:  # the end of a record that started in a range before
            while (found := self.rest.match(source.data, position)) is None:
                if not more():
                    return
            position = self._end(source, found.end(), more) + 1
        elif start == 0 and source.data.startswith(_BOM):
            position = len(_BOM)
        while position < limit:
            begin = position
            for mark in self.mark.finditer(source.data, position):
                if mark.group() == b"\n":
                    yield source.data[begin : mark.start()]
                    begin = mark.end()
                    if begin >= limit:
                        return
                elif not mark["close"] or mark.end() == len(source.data):
                    break  # it may go on in bytes that aren't held yet
            position = begin
            if not more():
                if position < len(source.data):
                    yield source.data[position : self._end(source, position, more)]
                return

    def _end(self, source: Bytes, position: int, more) -> int:
        while True:
            for mark in self.mark.finditer(source.data, position):
                if mark.group() == b"\n":
                    return mark.start()
                if not mark["close"] or mark.end() == len(source.data):
                    break
            if not more():
                return len(source.data)


def read_records(
    spark: SparkSession, path: str | Sequence[str], names: Sequence[str], header: bool, sep: str, quote: str, encoding: str
) -> DataFrame:
    """Text columns of delimited files whose quoted cells may hold line breaks.

    Files are split into byte ranges; whether a range starts inside quotes follows from the ranges
    before it. Records are cut out in the tasks and parsed by Spark's own parser. Empty lines
    are no records; with ``header``, the first record of each file is none.
    """
    cutter = Cutter(sep, quote, encoding)
    ranges = file_ranges(spark, path, cutter.report, b"\n", after=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                with Bytes(part["path"], max(0, part["start"] - 1), part["length"]) as source:
                    low, high = aligned(source, part["start"], part["stop"], b"\n", True)
                    skip, held, windows = header and low == 0, [], False
                    found = cutter.records(source, low, high, part["state"]) if low < high else ()
                    for record in found:
                        if windows := record.endswith(b"\r") or windows and source.start + len(source.data) == source.length:
                            record = record.removesuffix(b"\r").replace(b"\r\n", b"\n")  # as Spark's own reader
                        if not record:
                            continue
                        if skip:
                            skip = False
                            continue
                        held.append(record.decode(encoding, "replace"))
                        if len(held) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["record"])
                            held = []
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["record"])

    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    options = {"sep": sep, "quote": quote, "escape": quote, "mode": "PERMISSIVE", "multiLine": "true"}
    parsed = ranges.mapInArrow(cut, "record string").select(F.from_csv("record", schema, options).alias("row"))
    return parsed.select("row.*")
