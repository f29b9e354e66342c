"""The whole profile of a table in a fixed number of jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.columns import categorical_columns, numeric_columns
from ..operators.frequencies import constant_columns, near_zero_variance
from ..operators.indexes import detect_index_columns
from ..operators.mutual_info import top_mutual_info_pairs
from ..operators.summary import (
    dataset_shape,
    describe_numeric,
    duplicate_rows,
    missing_values,
    outliers_per_column,
)


@dataclass
class Profile:
    """The parts of a profile, each a small table."""

    index_columns: list[str]
    shape: DataFrame
    duplicates: DataFrame
    missing: DataFrame
    outliers: DataFrame | None
    statistics: DataFrame | None
    constants: DataFrame
    near_zero_variance: DataFrame
    mutual_info: DataFrame

    def document(self) -> DataFrame:
        """The profile as one nested row, ready for ``write_json``."""
        row = self.shape.select("*", self.duplicates.scalar().alias("duplicated_rows"))
        parts = {
            "missing": self.missing,
            "outliers_per_column": self.outliers,
            "statistical_summary": self.statistics,
            "constant_columns": self.constants,
            "near_zero_variance_columns": self.near_zero_variance,
            "top_mutual_info_pairs": self.mutual_info,
        }
        for name, part in parts.items():
            if part is None:
                row = row.withColumn(name, F.array())
                continue
            # one record per column or pair
            packed = part.agg(F.sort_array(F.collect_list(F.struct("*"))))
            row = row.withColumn(name, packed.scalar())
        return row


def profile(
    df: DataFrame,
    analyze_outliers: bool = True,
    analyze_skew: bool = True,
    detect_constants: bool = True,
    order_by: list[str] | None = None,
) -> Profile:
    """Quality, distribution and association summary; index columns are left out of the last two."""
    skip = detect_index_columns(df, order_by)
    numeric = numeric_columns(df, skip)
    return Profile(
        index_columns=skip,
        shape=dataset_shape(df),
        duplicates=duplicate_rows(df),
        missing=missing_values(df),
        outliers=outliers_per_column(df, numeric) if analyze_outliers and numeric else None,
        statistics=describe_numeric(df, numeric) if analyze_skew and numeric else None,
        constants=constant_columns(df) if detect_constants else df.sparkSession.createDataFrame([], "column_name string, top_share double"),
        near_zero_variance=near_zero_variance(df, numeric + categorical_columns(df, skip)),
        mutual_info=top_mutual_info_pairs(df, skip=skip),
    )
