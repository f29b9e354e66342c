"""Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import READ_FAILURES, DataLoadingError, EmptyDatasetError
from ..functions.values import exact_null_word_to_null
from ..operators.columns import quoted
from .registry import register_reader


def normalize_nulls_exact(df: DataFrame) -> DataFrame:
    """Exact null words of text columns become null; other columns keep their values."""
    return df.select(
        *[
            exact_null_word_to_null(quoted(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else quoted(f.name)
            for f in df.schema.fields
        ]
    )


@register_reader([".parquet", ".pq"])
def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with null words of text columns read as null; one row is probed first."""
    try:
        df = spark.read.parquet(path)
        if not df.columns:
            raise EmptyDatasetError(f"{path} has no columns")
        if df.isEmpty():
            raise EmptyDatasetError(f"{path} has no rows")
    except READ_FAILURES as error:
        raise DataLoadingError(f"invalid Parquet in {path}") from error
    return normalize_nulls_exact(df)
