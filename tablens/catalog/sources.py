"""Source and sink queries: Spark writes a driver table in some format, the reader reads it."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from ..plans import Dataset
from ..sinks import reports
from ..sources import (
    artifact_table,
    detect_dialects,
    flatten,
    load_file,
    union_schema_checked,
)
from ..storage import scratch_path
from .base import query, table

_ORDERS_TEXT = (
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, "
    "CAST(o_totalprice AS VARCHAR) AS o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders"
)


def _orders_csv(spark, sf, sep=","):
    path = scratch_path(spark, "orders") + ".csv"
    return reports.write_delimited(table(spark, sf, "orders"), path, sep)


@query("scan_csv", _ORDERS_TEXT)
def scan_csv(spark, sf):
    return load_file(spark, _orders_csv(spark, sf))


@query("scan_tsv", _ORDERS_TEXT)
def scan_tsv(spark, sf):
    return load_file(spark, _orders_csv(spark, sf, "\t"), has_header=True)


@query("detect_dialect")
def detect_dialect(spark, sf):
    path = scratch_path(spark, "mixed")
    for name, sep in (("orders", ";"), ("customer", "|"), ("part", ",")):
        reports.write_delimited(table(spark, sf, name), f"{path}/{name}", sep)
    found = detect_dialects(spark, path)
    return found.groupBy("sep", "quote", "header", F.size("first_row").alias("columns")).agg(
        F.count("*").alias("files")
    )


_EVENTS_FLAT = (
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, user_id, event_type, value, "
    "CAST(props->>'k' AS BIGINT) AS props_k, user_id AS pair_0, event_id AS pair_1 FROM events"
)


def _nested_events(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"),
        "user_id",
        "event_type",
        "value",
        F.from_json("props", "k bigint").alias("props"),
        F.array("user_id", "event_id").alias("pair"),
    )


@query("scan_json", _EVENTS_FLAT)
def scan_json(spark, sf):
    path = scratch_path(spark, "events") + ".json"
    return load_file(spark, reports.write_json_documents(_nested_events(spark, sf), path))


@query("scan_jsonl", _EVENTS_FLAT)
def scan_jsonl(spark, sf):
    path = scratch_path(spark, "events") + ".jsonl"
    return load_file(spark, reports.write_json(_nested_events(spark, sf), path))


@query(
    "flatten_json",
    "SELECT l_orderkey, l_quantity AS pair_0, l_extendedprice AS pair_1, l_tax AS b_c, l_discount AS \"0_d\", l_suppkey AS a_e FROM lineitem",
)
def flatten_json(spark, sf):
    return flatten(
        table(spark, sf, "lineitem").select(
            "l_orderkey",
            F.array("l_quantity", "l_extendedprice").alias("pair"),
            F.struct(
                F.struct(F.col("l_tax").alias("c")).alias("b"), F.col("l_suppkey").alias("e")
            ).alias("a"),
            F.array(F.struct(F.col("l_discount").alias("d"))).alias("parts"),
        )
    )


@query(
    "scan_xml",
    "SELECT CAST(c_custkey AS VARCHAR) AS customer_c_custkey, c_name AS customer_c_name, CAST(c_nationkey AS VARCHAR) AS place_nation, "
    "c_mktsegment AS place_segment FROM customer",
)
def scan_xml(spark, sf):
    path = scratch_path(spark, "customer") + ".xml"
    table(spark, sf, "customer").select(
        "c_custkey",
        F.concat(F.lit(" "), "c_name", F.lit("  ")).alias("c_name"),
        F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("place"),
    ).write.format("xml").options(rootTag="customers", rowTag="customer").save(path)
    return load_file(spark, path)


@query(
    "scan_xml_tags",
    "SELECT CAST(c_custkey AS VARCHAR) AS customer_key, c_name AS customer_name, NULL AS supplier_key, NULL AS place_nation FROM customer "
    "UNION ALL SELECT NULL, NULL, CAST(s_suppkey AS VARCHAR), CAST(s_nationkey AS VARCHAR) FROM supplier",
)
def scan_xml_tags(spark, sf):
    """Rows of two tags in one table, from files of both."""
    path = scratch_path(spark, "parties") + ".xml"
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    customers.write.format("xml").options(rootTag="parties", rowTag="customer").save(f"{path}/customers")
    suppliers = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("key"), F.struct(F.col("s_nationkey").alias("nation")).alias("place")
    )
    suppliers.write.format("xml").options(rootTag="parties", rowTag="supplier").save(f"{path}/suppliers")
    return load_file(spark, path)


@query("scan_parquet", "SELECT * FROM customer")
def scan_parquet(spark, sf):
    return load_file(spark, f"{sf}/customer.parquet")


_CONTENT = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def workbook_bytes(sheets: dict[str, pd.DataFrame]) -> bytes:
    """A minimal workbook: text cells inline, numbers as they are."""

    def cell(value) -> str:
        if pd.isna(value):
            return "<c/>"
        if isinstance(value, str):
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'
        return f"<c><v>{value}</v></c>"

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        listed, links = [], []
        for i, (name, frame) in enumerate(sheets.items(), start=1):
            listed.append(f'<sheet name="{escape(name)}" sheetId="{i}" r:id="r{i}"/>')
            links.append(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml" Type="{_OFFICE}/worksheet"/>')
            rows = [list(frame.columns), *frame.itertuples(index=False, name=None)]
            body = "".join(
                f'<row r="{n}">{"".join(cell(v) for v in row)}</row>' for n, row in enumerate(rows, start=1)
            )
            book.writestr(
                f"xl/worksheets/sheet{i}.xml",
                f'<worksheet xmlns="{_CONTENT}"><sheetData>{body}</sheetData></worksheet>',
            )
        book.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{_CONTENT}" xmlns:r="{_OFFICE}"><sheets>{"".join(listed)}</sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="{_PACKAGE}">{"".join(links)}</Relationships>',
        )
    return out.getvalue()


@query(
    "scan_xlsx",
    "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, CAST(p_size AS VARCHAR) AS p_size FROM part",
)
def scan_xlsx(spark, sf):
    path = scratch_path(spark, "part") + ".xlsx"

    def save(batches):
        """One workbook per batch of rows, into the shared folder."""
        import uuid

        from pyarrow import fs

        for batch in batches:
            root = "/" + path[len("file:"):].lstrip("/") if path.startswith("file:") else path
            target, base = fs.FileSystem.from_uri(root)
            target.create_dir(base)
            name = f"{base}/{uuid.uuid4().hex}.xlsx"
            with target.open_output_stream(name) as stream:
                stream.write(workbook_bytes({"parts": batch}))
            yield pd.DataFrame({"name": [name]})

    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    part.mapInPandas(save, "name string").write.format("noop").mode("overwrite").save()
    return load_file(spark, path)


@query(
    "union_schema_checked",
    "SELECT o_orderpriority, count(*) AS n FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT * FROM orders WHERE o_orderstatus <> 'F') t GROUP BY 1",
)
def union_checked(spark, sf):
    orders = table(spark, sf, "orders")
    both = union_schema_checked(
        [orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus <> 'F'")]
    )
    return both.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query(
    "sample_json",
    "SELECT '{\"event_id\":' || event_id || ',\"ts\":\"' || replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '.000000', '') || "
    "'\",\"user_id\":' || user_id || ',\"event_type\":\"' || event_type || '\"}' AS json FROM events",
)
def sample_json(spark, sf):
    return reports.json_rows(table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type"))


@query(
    "report_markdown",
    "SELECT '## ' || o_orderpriority || chr(10) || chr(10) || '- orders: ' || count(*) || chr(10) || '- customers: ' || count(DISTINCT o_custkey) || chr(10) || chr(10) || '---' || chr(10) AS section FROM orders GROUP BY o_orderpriority",
)
def report_markdown(spark, sf):
    per_priority = table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers")
    )
    return reports.markdown_sections(per_priority, "o_orderpriority", ["orders", "customers"])


@query("artifact_table")
def artifacts(spark, sf):
    """Page texts saved by the executors as ``.svg`` artifacts, listed as base64 rows."""
    path = scratch_path(spark, "pages")

    def save(batches):
        from pyarrow import fs

        root = "/" + path[len("file:"):].lstrip("/") if path.startswith("file:") else path
        target, base = fs.FileSystem.from_uri(root)
        target.create_dir(base)
        for batch in batches:
            names = [f"{base}/page_{key}.svg" for key in batch["page_id"]]
            for name, html in zip(names, batch["html"]):
                with target.open_output_stream(name) as stream:
                    stream.write(html.encode())
            yield pd.DataFrame({"name": names})

    pages = table(spark, sf, "pages").select("page_id", "html")
    pages.mapInPandas(save, "name string").write.format("noop").mode("overwrite").save()
    return artifact_table(spark, path, documents=True)


@query(
    "load_infer_downcast",
    "SELECT o_orderpriority, o_orderstatus, count(*) AS n, CAST(min(o_orderkey) AS BIGINT) AS first_key, CAST(max(o_custkey) AS BIGINT) AS last_customer, "
    "round(sum(o_totalprice), 2) AS total, max(o_orderdate) AS last_date FROM orders GROUP BY 1, 2",
)
def load_infer_downcast(spark, sf):
    data = Dataset(spark, path=_orders_csv(spark, sf))
    data.load()
    data.infer()
    return data.downcast().groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count("*").alias("n"),
        F.min("o_orderkey").cast("bigint").alias("first_key"),
        F.max("o_custkey").cast("bigint").alias("last_customer"),
        F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.max("o_orderdate").alias("last_date"),
    )
