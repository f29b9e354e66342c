"""JSON and XML documents as flat tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..errors import READ_FAILURES, DataLoadingError, EmptyDatasetError
from .flatten import column_names, flatten
from .ranges import file_ranges
from .registry import register_reader
from .xml_rows import columns_of, read_rows, report, seen_paths


def _read_json(spark: SparkSession, path: str, one_document: bool) -> DataFrame:
    try:
        nested = (
            spark.read.option("multiLine", one_document).option("mode", "FAILFAST").json(path)
        )
        if not nested.columns or nested.isEmpty():
            raise EmptyDatasetError(f"{path} has no records")
        return flatten(nested)
    except READ_FAILURES as error:
        raise DataLoadingError(f"invalid JSON in {path}") from error


@register_reader([".json"])
def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of records (or one record) per file, flattened."""
    return _read_json(spark, path, one_document=True)


@register_reader([".jsonl"])
def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One record per line, flattened; files are split between tasks."""
    return _read_json(spark, path, one_document=False)


@register_reader([".xml"], ["row_tags"])
def read_xml(
    spark: SparkSession, path: str, row_tags: Sequence[str] | None = None
) -> DataFrame:
    """Each child of the root is a row; leaf text is trimmed and attributes are ignored.

    Rows of different tags share one table whose other columns are null; elements of a row's tag
    deeper down are part of their row. ``row_tags`` keeps the rows of these tags only. Columns are
    named as by ``flatten``; a tag that occurs more than once below one parent, in any row, becomes a
    column per place. Blank text is null. Files are read in byte ranges, so that a file of any
    size is read by many tasks; only a single row has to fit in memory. Encodings must agree with
    ASCII below 128; entities that the document type declares are not known.
    """
    try:
        ranges = file_ranges(spark, path, report, b"<", after=False)
        tags = frozenset(row_tags) if row_tags else None
        paths = seen_paths(ranges, tags)
        if not paths:
            raise EmptyDatasetError(f"{path} has no rows")
        return read_rows(ranges, paths, column_names(columns_of(paths)), tags)
    except READ_FAILURES as error:
        raise DataLoadingError(f"invalid XML in {path}") from error
