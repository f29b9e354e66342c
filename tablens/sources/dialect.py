"""Delimiter, quote character and header of delimited text files, from their heads."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import is_header_null, is_identifier_like, is_plain_number
from .heads import file_heads

SNIFFED_CHARACTERS = 2048
USUAL_DELIMITERS = ",;\t|"

_HEAD_SCHEMA = (
    "path string, sep string, quote string, first_row array<string>, second_row array<string>"
)


def _sniff(text: str) -> tuple[str, str]:
    """Delimiter and quote character (empty for none) of a text sample."""
    for delimiters in (USUAL_DELIMITERS, None):
        try:
            found = csv.Sniffer().sniff(text, delimiters)
        except csv.Error:
            continue
        return found.delimiter, found.quotechar or ""
    return ",", '"'


def _describe(head: bytes, encoding: str, given_sep: str | None, given_quote: str | None) -> tuple:
    text = head.decode(encoding, errors="replace").lstrip("\ufeff")
    sample = text[:SNIFFED_CHARACTERS]
    if len(text) > len(sample) and "\n" in sample:
        sample = sample[: sample.rindex("\n") + 1]
    sep, quote = _sniff(sample.lstrip("\r\n"))
    sep = given_sep or sep
    quote = quote if given_quote is None else given_quote
    dialect = {"quotechar": quote} if quote else {"quoting": csv.QUOTE_NONE}
    rows = csv.reader(io.StringIO(text, newline=""), delimiter=sep, **dialect)
    filled = (row for row in rows if row)  # blank lines are no records, as in Spark's reader
    first, second = ([v or None for v in next(filled, [])] for _ in range(2))
    return sep, quote, first, second


def detect_dialects(
    spark: SparkSession, path: str, encoding: str = "utf-8", sep: str | None = None, quote: str | None = None
) -> DataFrame:
    """``(path, sep, quote, header, first_row, second_row)`` of every file below ``path``.

    The delimiter is found first, so that the header test sees the real columns. A given
    delimiter or quote character (empty for none) takes the place of the one that is found.
    """

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_describe(head, encoding, sep, quote) for head in batch["head"]]
            frame = pd.DataFrame(found, columns=["sep", "quote", "first_row", "second_row"])
            frame.insert(0, "path", batch["path"].values)
            yield frame

    rows = file_heads(spark, path, lines=2).mapInPandas(describe, _HEAD_SCHEMA)
    return rows.withColumn("header", header_test(F.col("first_row"), F.col("second_row")))


def header_test(first: Column, second: Column) -> Column:
    """Is the first row a header?

    At most one cell missing, nearly all cells different, and either more numbers in the
    second row, or mostly identifier-like cells, or nothing but rising numbers.
    """
    size = F.size(first)

    def how_many(row: Column, test) -> Column:
        return F.size(F.filter(row, test))

    numbers = F.transform(F.filter(first, is_plain_number), lambda c: c.try_cast("double"))
    neighbours = F.transform(
        numbers, lambda v, i: F.coalesce(F.get(numbers, i + 1) > v, F.lit(True))
    )
    rising = (F.size(numbers) == size) & F.forall(neighbours, lambda ok: ok)
    more_numbers = (F.size(second) > 0) & (
        how_many(first, is_plain_number) < how_many(second, is_plain_number)
    )
    identifiers = how_many(first, is_identifier_like) > 0.8 * size
    return (
        (size > 0)
        & (how_many(first, is_header_null) <= 1)
        & (F.size(F.array_distinct(first)) > 0.9 * size)
        & (more_numbers | identifiers | rising)
    )
