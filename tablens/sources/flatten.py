"""Nested columns to flat ones."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.columns import chunks, quoted

# name of the text of an XML element that also has children
TEXT_FIELD = "_VALUE"


def flatten(df: DataFrame, prefix: Sequence[str] = ()) -> DataFrame:
    """Struct fields and list positions become columns; the row count stays.

    A column is named by the last two parts of its path; where two paths share that name,
    both get their full path. The longest list per path is found by one aggregate per level
    of lists; everything else is a projection.
    """
    leaves: list[tuple[tuple[str, ...], Column]] = []
    pending = [((*prefix, f.name), quoted(f.name), f.dataType) for f in df.schema.fields]
    while pending:
        lists = []
        for path, value, dtype in pending:
            _expand(path, value, dtype, leaves, lists)
        pending = []
        sizes = _longest(df, [value for _, value, _ in lists])
        for (path, value, element), size in zip(lists, sizes):
            pending += [((*path, str(i)), F.get(value, F.lit(i)), element) for i in range(size)]
    names = column_names([path for path, _ in leaves])
    return df.select(*[value.alias(name) for name, (_, value) in zip(names, leaves)])


def _expand(path, value, dtype, leaves, lists) -> None:
    if isinstance(dtype, T.StructType):
        for field in dtype.fields:
            part = () if field.name == TEXT_FIELD else (field.name,)
            _expand((*path, *part), value.getField(field.name), field.dataType, leaves, lists)
    elif isinstance(dtype, T.ArrayType):
        lists.append((path, value, dtype.elementType))
    else:
        leaves.append((path, value))


def _longest(df: DataFrame, values: Sequence[Column]) -> list[int]:
    sizes: list[int] = []
    for group in chunks(values, 200):
        row = df.agg(*[F.max(F.size(v)).alias(f"s{i}") for i, v in enumerate(group)]).first()
        sizes += [max(0, s or 0) for s in row]
    return sizes


def column_names(paths: Sequence[tuple[str, ...]]) -> list[str]:
    """The last two parts of each path, or all of them where two paths share these."""
    short = ["_".join(p[-2:]) for p in paths]
    uses = Counter(short)
    names: list[str] = []
    for path, name in zip(paths, short):
        name = name if uses[name] == 1 else "_".join(path)
        while name in names:
            name += "_"
        names.append(name)
    return names
