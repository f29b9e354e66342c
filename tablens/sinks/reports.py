"""Reports and samples as files, written by the executors."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.columns import is_datetime, quoted

_ISO = "yyyy-MM-dd'T'HH:mm:ss"


def write_json(df: DataFrame, path: str) -> str:
    """JSON lines with null fields kept."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)
    return path


def write_schema_report(report: DataFrame, folder: str) -> str:
    """The schema report under ``folder/schema-<time>``; returns the path."""
    stamp = datetime.now().strftime("%Y-%m-%d %H-%M-%S")
    return write_json(report.coalesce(1), f"{folder.rstrip('/')}/schema-{stamp}.json")


def iso_text(value: Column) -> Column:
    """ISO-8601 text; fractional seconds (six digits) only where there are any."""
    whole = F.date_format(value, _ISO)
    micros = F.date_format(value, _ISO + ".SSSSSS")
    return F.when(micros.endswith(".000000"), whole).otherwise(micros)


def json_rows(df: DataFrame) -> DataFrame:
    """``(json)``: one JSON object per row, dates and times as ISO-8601 text."""
    fields = [
        (iso_text(quoted(f.name)) if is_datetime(f.dataType) else quoted(f.name)).alias(f.name)
        for f in df.schema.fields
    ]
    return df.select(
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json")
    )


def write_json_documents(df: DataFrame, path: str) -> str:
    """One JSON array document per partition, written as its rows stream by."""

    def bracket(batches):
        first = True
        for batch in batches:
            lines = batch["json"].tolist()
            if lines and first:
                lines[0], first = "[" + lines[0], False
                lines[1:] = ["," + line for line in lines[1:]]
            else:
                lines = ["," + line for line in lines]
            yield pd.DataFrame({"value": lines})
        if not first:
            yield pd.DataFrame({"value": ["]"]})

    documents = json_rows(df).mapInPandas(bracket, "value string")
    documents.write.mode("errorifexists").text(path)
    return path


def write_sample(df: DataFrame, path: str) -> str:
    """A sample as JSON lines in one file (samples are small by construction)."""
    json_rows(df).coalesce(1).write.mode("errorifexists").text(path)
    return path


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> str:
    """CSV with a header, quoted so that ``read_delimited`` reads the same cells back."""
    df.write.mode("errorifexists").options(
        header=True, sep=sep, escape='"', timestampNTZFormat="yyyy-MM-dd HH:mm:ss"
    ).csv(path)
    return path


def markdown_sections(df: DataFrame, title: str, value_columns: list[str]) -> DataFrame:
    """``(section)``: one Markdown section per row, headed by the ``title`` column."""
    lines = [
        F.concat(F.lit(f"- {c}: "), F.coalesce(quoted(c).cast("string"), F.lit("n/a")))
        for c in value_columns
    ]
    return df.select(
        F.concat(
            F.lit("## "), quoted(title).cast("string"), F.lit("\n\n"),
            F.concat_ws("\n", *lines), F.lit("\n\n---\n"),
        ).alias("section")
    )


def write_markdown(sections: DataFrame, path: str, heading: str = "Analysis report") -> str:
    """Sections in their order under one heading, as one text file (one row per section)."""
    spark = sections.sparkSession
    head = spark.createDataFrame([(f"# {heading}\n",)], "section string")
    head.union(sections).coalesce(1).write.mode("errorifexists").text(path)
    return path
