"""Readers. Importing this package registers them by file extension."""

from .artifacts import artifact_table
from .columnar import normalize_nulls_exact, read_parquet
from .database import read_table
from .delimited import normalize_nulls_text, read_delimited
from .dialect import detect_dialects
from .documents import read_json, read_jsonl, read_xml
from .flatten import flatten
from .registry import load_file, reader_for, register_reader
from .workbook import read_workbooks, union_schema_checked

__all__ = [
    "artifact_table", "detect_dialects", "flatten", "load_file", "normalize_nulls_exact",
    "normalize_nulls_text", "read_delimited", "read_json", "read_jsonl", "read_parquet",
    "read_table", "read_workbooks", "read_xml", "reader_for", "register_reader",
    "union_schema_checked",
]
