"""Which reader serves which path."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..errors import ConfigurationError, UnknownSourceError


@dataclass(frozen=True)
class Reader:
    load: Callable[..., DataFrame]
    options: frozenset[str]


_READERS: dict[str, Reader] = {}


def register_reader(extensions: Sequence[str], options: Sequence[str] = ()):
    """Decorator: serve these extensions with ``load(spark, path, **options)``."""

    def add(load: Callable[..., DataFrame]):
        for extension in extensions:
            _READERS[extension.lower()] = Reader(load, frozenset(options))
        return load

    return add


def reader_for(path: str) -> Reader:
    lowered = path.lower().rstrip("/")
    for extension in sorted(_READERS, key=len, reverse=True):
        if lowered.endswith(extension):
            return _READERS[extension]
    known = ", ".join(sorted(_READERS))
    raise UnknownSourceError(f"no reader for {path}; supported extensions: {known}")


def load_file(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read a path with the reader of its extension; unknown options are refused."""
    reader = reader_for(path)
    unknown = sorted(set(options) - reader.options)
    if unknown:
        raise ConfigurationError(
            f"unknown options {unknown} for {path}; allowed: {sorted(reader.options)}"
        )
    return reader.load(spark, path, **options)
