"""Folders of rendered artifacts as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: file types listed as artifacts
IMAGE_TYPES = ("png", "jpg", "jpeg", "webp")
DOCUMENT_TYPES = ("pdf", "svg")


def artifact_table(spark: SparkSession, path: str, documents: bool = False) -> DataFrame:
    """``(filename, size, content)``: base64 text of every artifact below ``path``."""
    types = IMAGE_TYPES + (DOCUMENT_TYPES if documents else ())
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{" + ",".join(types) + "}")
        .load(path)
    )
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("length").alias("size"),
        F.base64("content").alias("content"),
    )
