"""One source from load to profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..errors import ConfigurationError
from ..operators import charts, correlation, sampling, typing
from ..operators.indexes import detect_index_columns
from ..sinks.reports import write_json, write_sample, write_schema_report
from ..sources import load_file, read_table
from .profile import Profile, profile


class Dataset:
    """A file path or a database table, read lazily.

    ``load`` → ``infer`` → ``downcast`` each return the table and keep it as ``df``.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, db_url: str | None = None):
        if (path is None) == (db_url is None):
            raise ConfigurationError("give either a path or a database URL, not both")
        self.spark = spark
        self.path = path
        self._db_url = db_url
        self._df: DataFrame | None = None

    @property
    def df(self) -> DataFrame:
        return self._df if self._df is not None else self.load()

    def load(self, **options) -> DataFrame:
        if self._db_url is not None:
            self._df = read_table(self.spark, self._db_url, **options)
        else:
            self._df = load_file(self.spark, self.path, **options)
        return self._df

    def infer(self, schema_dir: str | None = None, compat: bool = False) -> tuple[DataFrame, DataFrame]:
        """The typed table and its schema report, written to ``schema_dir`` if given.

        Database tables keep their declared types.
        """
        raw = self.df
        if self._db_url is not None:
            report = typing.schema_report(raw, declared=True)
        else:
            kinds = typing.infer(raw, compat)
            report = typing.schema_report(raw, kinds)
            self._df = typing.convert_types(raw, kinds)
        if schema_dir is not None:
            write_schema_report(report, schema_dir)
        return self._df, report

    def downcast(self, floats: bool = False) -> DataFrame:
        self._df = typing.downcast(self.df, floats)
        return self._df

    def profile(self, path: str | None = None, **options) -> Profile:
        found = profile(self.df, **options)
        if path is not None:
            write_json(found.document(), path)
        return found

    def sample(self, max_rows: int, path: str | None = None, **options) -> DataFrame:
        _, rows = sampling.sample_auto(self.df, max_rows, **options)
        if path is not None:
            write_sample(rows, path)
        return rows

    def analyse(self, max_rows: int = 250, **options) -> dict:
        """Sample, profile, charts and correlations of the loaded table."""
        return {
            "sample": self.sample(max_rows, **options),
            "profile": self.profile(),
            "charts": self.charts(),
            "correlations": self.correlations(),
        }

    def correlations(self, threshold: float = 0.8, top_n: int = 5) -> dict[str, DataFrame]:
        pearson = correlation.corr_matrix(self.df)
        return {
            "heatmap": correlation.heatmap_cells(self.df),
            "strong_pairs": correlation.strong_correlations(self.df, threshold=threshold, top_n=top_n),
            "spearman": correlation.spearman_top_pair(self.df, reported=correlation.top_pairs(pearson)),
        }

    def charts(self, skip: Sequence[str] | None = None) -> dict[str, DataFrame]:
        """Chart data of the table without the ``skip`` columns, by default the index columns."""
        df = self.df.drop(*(detect_index_columns(self.df) if skip is None else skip))
        return {
            "histograms": charts.variance_histograms(df),
            "categories": charts.top_categories(df),
            "time_series": charts.time_series_charts(df),
            "boxes": charts.category_boxes(df),
        }
