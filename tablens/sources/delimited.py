"""Delimited text: every column is read as text, null words become null."""

from __future__ import annotations

import codecs
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import READ_FAILURES, DataLoadingError, EmptyDatasetError
from ..functions.values import null_word_to_null
from ..operators.columns import quoted
from .dialect import detect_dialects
from .records import read_records
from .registry import register_reader


def normalize_nulls_text(df: DataFrame) -> DataFrame:
    """Null words of text columns become null (trimmed, any case); other columns stay."""
    return df.select(
        *[
            null_word_to_null(quoted(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else quoted(f.name)
            for f in df.schema.fields
        ]
    )


def _column_names(first_row: Sequence[str | None], header: bool) -> list[str]:
    """Header names made unique, or ``column_1 …`` when there is no header."""
    names: list[str] = []
    for i, cell in enumerate(first_row):
        base = (cell or f"column_{i + 1}") if header else f"column_{i + 1}"
        name, repeat = base, 0
        while name in names:
            name, repeat = f"{base}_duplicated_{repeat}", repeat + 1
        names.append(name)
    return names


def _ascii_lines(encoding: str) -> bool:
    """Whether a line break is the byte 10 and no part of another character."""
    return codecs.lookup(encoding).name in {"utf-8", "ascii"} or encoding.lower().startswith(("iso-8859", "latin", "cp125", "windows-125"))


@register_reader(
    [".csv", ".tsv", ".txt"],
    ["has_header", "quote_char", "encoding", "sep", "multi_line"],
)
def read_delimited(
    spark: SparkSession,
    path: str,
    has_header: bool | None = None,
    quote_char: str | bool | None = None,
    encoding: str = "utf-8",
    sep: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Read a delimited file, or a folder of them, with detected or given options.

    Cells beyond the columns are dropped and short rows are filled with null. Files are
    grouped by dialect and columns; one group, the usual case, is one scan of ``path``.
    ``quote_char=False`` turns quoting off. ``multi_line=True`` allows line breaks inside quotes;
    files are split all the same, after one more pass that finds the splits inside quotes (but for
    encodings in which a line break isn't the byte 10, where a file is one task).
    """
    try:
        found = (
            detect_dialects(
                spark, path, encoding, sep, None if quote_char is None else (quote_char or "")
            )
            .where(F.size("first_row") > 0)
            .select(
                "path",
                "sep",
                "quote",
                (F.lit(has_header) if has_header is not None else F.col("header")).alias("header"),
                "first_row",
            )
        )
        layout = F.when(F.col("header"), F.col("first_row")).otherwise(
            F.transform("first_row", lambda c: F.lit(None).cast("string"))
        )
        keys = ("sep", "quote", "header", "layout")
        found = found.withColumn("layout", layout)
        groups = found.select(*keys).distinct().collect()
        if len(groups) > 1:  # only then are the file names of each group needed
            groups = found.groupBy(*keys).agg(F.collect_list("path").alias("paths")).collect()
    except READ_FAILURES as error:
        raise DataLoadingError(f"cannot read {path}") from error
    if not groups:
        raise EmptyDatasetError(f"{path} has no columns")
    frames = []
    for group in groups:
        names = _column_names(group["layout"], group["header"])
        quote = group["quote"] if quote_char is None else (quote_char or "")
        paths = path if len(groups) == 1 else list(group["paths"])
        if multi_line and quote and _ascii_lines(encoding):
            frames.append(read_records(spark, paths, names, group["header"], sep or group["sep"], quote, encoding))
            continue
        reader = spark.read.options(
            header=group["header"], sep=sep or group["sep"], quote=quote, escape=quote or "\\",
            encoding=encoding, mode="PERMISSIVE", multiLine=multi_line, enforceSchema=True,
        ).schema(T.StructType([T.StructField(n, T.StringType()) for n in names]))
        frames.append(reader.csv(paths))
    df = frames[0]
    for other in frames[1:]:
        df = df.unionByName(other, allowMissingColumns=True)
    if df.isEmpty():
        raise EmptyDatasetError(f"{path} has no rows")
    return normalize_nulls_text(df)
