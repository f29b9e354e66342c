import json
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablens import errors
from tablens.catalog.sources import workbook_bytes
from tablens.sinks import reports
from tablens.sources import (
    artifact_table,
    detect_dialects,
    flatten,
    load_file,
    reader_for,
    union_schema_checked,
)
from tablens.sources.database import database_error, jdbc_options


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def write(path, text):
    path.write_text(text)
    return str(path)


# ---- delimited text --------------------------------------------------------------------

def test_csv_with_header_nulls_and_ragged_rows(spark, tmp_path):
    path = write(
        tmp_path / "a.csv",
        'id,name,score\n1,"Smith, J",3.5\n2, N/A ,--\n3,plain\n4,x,7,extra\n5,"say ""hi""",-\n',
    )
    got = load_file(spark, path)
    assert got.columns == ["id", "name", "score"]
    assert rows_of(got) == [
        ("1", "Smith, J", "3.5"), ("2", None, None), ("3", "plain", None), ("4", "x", "7"),
        ("5", 'say "hi"', None),
    ]


@pytest.mark.parametrize("sep", [";", "\t", "|"])
def test_other_delimiters(spark, tmp_path, sep):
    lines = [["name", "city", "age"], *[[f"n{i}", f"c, {i}", str(i)] for i in range(9)]]
    path = write(tmp_path / "b.txt", "\n".join(sep.join(r) for r in lines))
    got = load_file(spark, path)
    assert got.columns == lines[0] and got.count() == 9


def test_no_header(spark, tmp_path):
    path = write(tmp_path / "c.csv", "5,a b!,2\n4,c d!,1\n3,e f!,9\n")
    assert load_file(spark, path).columns == ["column_1", "column_2", "column_3"]
    assert load_file(spark, path, has_header=True).columns == ["5", "a b!", "2"]


def test_header_names_are_made_unique(spark, tmp_path):
    path = write(tmp_path / "d.csv", "a,a,b\n1,2,3\n")
    assert load_file(spark, path, has_header=True).columns == ["a", "a_duplicated_0", "b"]


def test_a_folder_of_several_dialects(spark, tmp_path):
    folder = tmp_path / "mixed.csv"
    folder.mkdir()
    write(folder / "one.csv", "name,size\nx,1\ny,2\n")
    write(folder / "two.csv", "name;size;note\nz;3;n1\nw;4;n2\n")
    got = load_file(spark, str(folder))
    assert got.columns[:2] == ["name", "size"]
    assert rows_of(got) == [("w", "4", "n2"), ("x", "1", None), ("y", "2", None), ("z", "3", "n1")]
    found = {r["sep"]: r for r in detect_dialects(spark, str(folder)).collect()}
    assert set(found) == {",", ";"} and all(r["header"] for r in found.values())


def test_paths_with_blanks_and_signs(spark, tmp_path):
    path = write(tmp_path / "my file+1 100%.csv", "name,size\nx,1\n")
    assert rows_of(load_file(spark, path)) == [("x", "1")]


def test_multi_line_cells(spark, tmp_path):
    path = write(tmp_path / "e.csv", 'name,note\nx,"two\nlines"\ny,one\n')
    assert rows_of(load_file(spark, path, multi_line=True)) == [("x", "two\nlines"), ("y", "one")]


def test_other_encoding(spark, tmp_path):
    file = tmp_path / "f.csv"
    file.write_bytes("name,size\nJürgen,1\nZoë,2\n".encode("latin-1"))
    assert rows_of(load_file(spark, str(file), encoding="ISO-8859-1"))[0] == ("Jürgen", "1")


def test_header_only_and_missing_files(spark, tmp_path):
    with pytest.raises(errors.EmptyDatasetError):
        load_file(spark, write(tmp_path / "g.csv", "name,size\n"))
    with pytest.raises(errors.EmptyDatasetError):
        load_file(spark, write(tmp_path / "h.csv", ""))
    with pytest.raises(errors.DataLoadingError):
        load_file(spark, str(tmp_path / "nothing.csv"))


def test_unknown_options_and_extensions(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a,b\n1,2\n")
    with pytest.raises(errors.ConfigurationError, match="skip"):
        load_file(spark, path, skip=1)
    with pytest.raises(errors.UnknownSourceError):
        reader_for("table.docx")
    assert reader_for("X.PARQUET").load.__name__ == "read_parquet"


# ---- documents -------------------------------------------------------------------------

NESTED = [
    {"id": 1, "a": {"b": {"c": 5}}, "tags": ["x", "y"], "items": [{"p": 1}, {"p": 2, "q": "z"}], "other": {"b": {"c": 6}}},
    {"id": 2, "a": None, "tags": [], "items": None},
    {"id": 3, "a": {"b": {"c": None}}, "tags": ["w"], "extra": True},
]
FLAT = {
    "id": [1, 2, 3], "a_b_c": [5, None, None], "other_b_c": [6, None, None],
    "tags_0": ["x", None, "w"], "tags_1": ["y", None, None],
    "0_p": [1, None, None], "1_p": [2, None, None], "1_q": ["z", None, None],
    "extra": [None, None, True],
}


@pytest.mark.parametrize("extension", ["json", "jsonl"])
def test_nested_json(spark, tmp_path, extension):
    text = json.dumps(NESTED) if extension == "json" else "\n".join(map(json.dumps, NESTED))
    got = load_file(spark, write(tmp_path / f"n.{extension}", text)).orderBy("id")
    columns = {c: [r[c] for r in got.collect()] for c in got.columns}
    # 0_q exists in the list's type but holds no value
    assert columns.pop("0_q") == [None] * 3
    assert columns == FLAT


def test_broken_json(spark, tmp_path):
    with pytest.raises(errors.DataLoadingError):
        load_file(spark, write(tmp_path / "b.json", '[{"a": 1}, {"a": '))


def test_flatten_keeps_rows(spark):
    df = spark.range(100).select(
        "id", F.expr("IF(id % 3 = 0, array(array(id, id + 1), array(id)), NULL)").alias("grid")
    )
    got = flatten(df)
    assert got.count() == 100 and got.columns == ["id", "0_0", "0_1", "1_0"]


XML = """<?xml version="1.0"?>
<shop>
  <book isbn="1"><title lang="en"> One </title><price>  </price><author><name>A</name></author></book>
  <book isbn="2"><title>Two</title><price>5</price><tag>x</tag><tag>y</tag></book>
  <disc><title>Three</title></disc>
</shop>"""


def test_xml(spark, tmp_path):
    got = load_file(spark, write(tmp_path / "s.xml", XML)).toPandas()
    assert set(got.columns) == {"book_title", "book_price", "author_name", "tag_0", "tag_1", "disc_title"}
    rows = got.astype(object).where(got.notna(), None).sort_values("book_title").to_dict("records")
    assert rows[0] == {"book_title": "One", "book_price": None, "author_name": "A", "tag_0": None, "tag_1": None, "disc_title": None}
    assert rows[1]["tag_1"] == "y" and rows[1]["book_price"] == "5"
    assert rows[2]["disc_title"] == "Three" and rows[2]["book_title"] is None


def test_xml_without_rows_or_broken(spark, tmp_path):
    with pytest.raises(errors.EmptyDatasetError):
        load_file(spark, write(tmp_path / "e.xml", "<shop></shop>"))
    with pytest.raises(errors.DataLoadingError):
        load_file(spark, write(tmp_path / "b.xml", "<shop><book></shop>"))


# ---- parquet, workbooks, artifacts -----------------------------------------------------

def test_parquet_null_words(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    spark.createDataFrame([("n/a", 1), ("N/A", 2), (" ", 3), ("-", 4)], "s string, i int").write.parquet(path)
    assert rows_of(load_file(spark, path)) == [("-", 4), ("N/A", 2), (None, 1), (None, 3)]
    with pytest.raises(errors.DataLoadingError):
        load_file(spark, write(tmp_path / "bad.parquet", "no parquet"))
    empty = str(tmp_path / "e.parquet")
    spark.range(0).write.parquet(empty)
    with pytest.raises(errors.EmptyDatasetError):
        load_file(spark, empty)


def test_workbooks(spark, tmp_path):
    first = pd.DataFrame({"name": ["a", "b"], "size": [1, 2.5]})
    second = pd.DataFrame({"name": ["c & d"], "size": [3]})
    other = pd.DataFrame({"title": ["t"]})
    folder = tmp_path / "books.xlsx"
    folder.mkdir()
    (folder / "one.xlsx").write_bytes(workbook_bytes({"data": first, "more": second}))
    (folder / "two.xlsx").write_bytes(workbook_bytes({"data": second}))
    assert rows_of(load_file(spark, str(folder))) == [("a", "1.0"), ("b", "2.5"), ("c & d", "3")]
    assert rows_of(load_file(spark, str(folder), sheet_name="more")) == [("c & d", "3")]
    assert load_file(spark, str(folder), sheet_id=0).count() == 4
    assert load_file(spark, str(folder), has_header=False).columns == ["column_1", "column_2"]
    (folder / "three.xlsx").write_bytes(workbook_bytes({"data": other}))
    with pytest.raises(errors.DataLoadingError, match="different columns"):
        load_file(spark, str(folder))
    with pytest.raises(errors.ConfigurationError):
        load_file(spark, str(folder), sheet_id=-1)
    with pytest.raises(errors.EmptyDatasetError):
        load_file(spark, str(folder), sheet_name="absent")


def test_union_needs_equal_schemas(spark):
    a = spark.range(2)
    assert union_schema_checked([a, a]).count() == 4
    with pytest.raises(errors.DataLoadingError, match="columns"):
        union_schema_checked([a, a.withColumnRenamed("id", "x")])
    with pytest.raises(errors.DataLoadingError, match="types"):
        union_schema_checked([a, a.select(F.col("id").cast("int"))])


def test_artifacts(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x01\x02")
    (tmp_path / "b.svg").write_bytes(b"<svg/>")
    (tmp_path / "c.txt").write_bytes(b"no")
    assert rows_of(artifact_table(spark, str(tmp_path))) == [("a.png", 2, "AQI=")]
    assert len(rows_of(artifact_table(spark, str(tmp_path), documents=True))) == 2


# ---- databases (options and errors only: no database is started) -------------------------

def test_jdbc_options():
    got = jdbc_options("postgresql://me:p%40ss@db.example:5432/shop", "orders")
    assert got == {"url": "jdbc:postgresql://db.example:5432/shop", "user": "me", "password": "p@ss", "dbtable": "orders"}
    assert jdbc_options("sqlite:////data/x.db", "t")["url"] == "jdbc:sqlite:/data/x.db"
    assert jdbc_options("mssql://h/db", "t")["url"] == "jdbc:sqlserver://h;databaseName=db"
    with pytest.raises(errors.ConfigurationError):
        jdbc_options("postgresql+driver://h/db", "t")
    with pytest.raises(errors.ConfigurationError):
        jdbc_options("mysql://h/db", None)


@pytest.mark.parametrize(
    "message, kind",
    [
        ("FATAL: password authentication failed for user", errors.AuthenticationError),
        ("Connection refused", errors.NetworkError),
        ("Unknown database 'x'", errors.DatabaseNotFoundError),
        ('database "x" does not exist', errors.DatabaseNotFoundError),
        ("permission denied for schema s", errors.AccessDeniedError),
        ('relation "t" does not exist', errors.DataLoadingError),
        ("No suitable driver", errors.MissingDriverError),
        ("something else", errors.DatabaseError),
    ],
)
def test_database_errors(message, kind):
    error = database_error(message + " secret", "t")
    assert type(error) is kind and "secret" not in str(error)


def test_missing_jdbc_driver(spark):
    from tablens.sources import read_table

    with pytest.raises(errors.DataLoadingError) as caught:
        read_table(spark, "mysql://u:topsecret@localhost/db", "t")
    assert "topsecret" not in str(caught.value)


# ---- sinks -------------------------------------------------------------------------------

def test_json_rows_keep_nulls_and_iso_times(spark):
    df = spark.createDataFrame(
        [(1, None, datetime(2024, 1, 2, 3, 4, 5)), (2, "é", datetime(2024, 1, 2, 3, 4, 5, 600))],
        "i int, s string, t timestamp_ntz",
    )
    got = [json.loads(r["json"]) for r in reports.json_rows(df).collect()]
    assert got == [
        {"i": 1, "s": None, "t": "2024-01-02T03:04:05"},
        {"i": 2, "s": "é", "t": "2024-01-02T03:04:05.000600"},
    ]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'q"q', 1.5), ("c", "d", 2.0)], "x string, y string, z double")
    path = reports.write_delimited(df, str(tmp_path / "r.csv"))
    assert rows_of(load_file(spark, path, has_header=True)) == [("a,b", 'q"q', "1.5"), ("c", "d", "2.0")]


def test_json_documents(spark, tmp_path):
    path = reports.write_json_documents(spark.range(0, 100, 1, 3), str(tmp_path / "d.json"))
    assert sorted(r["id"] for r in load_file(spark, path).collect()) == list(range(100))


def test_markdown(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None)], "name string, n int, m int")
    sections = reports.markdown_sections(df, "name", ["n", "m"])
    assert sections.first()["section"] == "## a\n\n- n: 1\n- m: n/a\n\n---\n"
    path = reports.write_markdown(sections, str(tmp_path / "report"))
    assert spark.read.text(path, wholetext=True).first()["value"].startswith("# Analysis report\n")


def _write(folder, files):
    for name, text in files.items():
        (folder / name).write_text(text)
    return str(folder)


from tablens.sources.delimited import read_delimited  # noqa: E402


def test_given_separator_rules_names_and_header(spark, tmp_path):
    path = _write(tmp_path, {"a.csv": "id|a, b|c|d\n1|x, y|z|w\n2|p, q|r|s\n"})
    got = read_delimited(spark, path, sep="|")
    assert got.columns == ["id", "a, b", "c", "d"] and got.count() == 2


def test_blank_first_line_in_a_mixed_folder(spark, tmp_path):
    files = {"a.csv": "id,v\n1,x\n2,y\n", "b.csv": "\nid,v\n3,x\n4,y\n", "c.csv": "id;v\n5;x\n6;y\n"}
    got = read_delimited(spark, _write(tmp_path, files))
    assert sorted(r.id for r in got.collect()) == list("123456")


def test_header_longer_than_the_head(spark, tmp_path):
    names = [f"a_rather_long_name_{k}" for k in range(4000)]
    text = ",".join(names) + "\n" + ",".join(map(str, range(4000))) + "\n"
    assert len(read_delimited(spark, _write(tmp_path, {"a.csv": text})).columns) == 4000


# ---- XML in ranges ----------------------------------------------------------------------

def xml_by_hand(text):
    """Cells of every child of the root, by the standard parser."""
    from xml.etree import ElementTree

    out = []
    for child in ElementTree.fromstring(text):
        row = {}

        def walk(node, path):
            value = (node.text or "").strip()
            if value or not len(node):
                row[path] = value or None
            seen = {}
            for below in node:
                place = seen.get(below.tag, 0)
                seen[below.tag] = place + 1
                walk(below, f"{path}/{below.tag}[{place}]")

        walk(child, child.tag)
        out.append(row)
    return out


ODD_XML = (
    '<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE shop [<!ELEMENT a (b)> ]>\n<!-- <a>none</a> --><shop note="a > b">'
    + "".join(
        '<a k="&lt;b>" />' if k % 7 == 3 else
        f"<a><a><b>{k} é &amp; x</b></a><!-- </a><a> --><c><![CDATA[</a><a>{k}]]></c><c/> tail</a>" if k % 3 else f"<b at='>'>t{k}<?pi <a> ?></b>"
        for k in range(60)
    )
    + "<!-- <b> --></shop>\n<!-- end -->"
)


def test_xml_elements_at_every_range_size(tmp_path):
    from tablens.sources import xml_rows
    from tablens.sources.ranges import Bytes, aligned

    path = tmp_path / "odd.xml"
    path.write_bytes(ODD_XML.encode())
    size = path.stat().st_size
    expected = xml_by_hand(ODD_XML)
    for step in (*range(17, 400, 13), 5000, size):
        state, depth, got = 0, 0, []
        for start in range(0, size, step):
            with Bytes(f"file:{path}", max(0, start - 1), size) as source:
                low, high = aligned(source, start, min(size, start + step), b"<", False)
                if low < high:
                    found = xml_rows.report(source.data[low - source.start : high - source.start])
                    got += [xml_rows.cells(x, None) for x in xml_rows.elements(source, low, high, state, depth)]
                    state, depth = found[state][0], depth + found[state][1]
        assert got == expected, step
        assert (state, depth) == (0, 0)


def test_xml_tags_far_into_a_file(spark, tmp_path, monkeypatch):
    from tablens.sources import ranges

    monkeypatch.setattr(ranges, "RANGE_BYTES", 4000)
    text = "<r>" + "".join(f"<a><x>{k}</x><b><x>in {k}</x></b></a>" for k in range(6000)) + "".join(f"<b><x>{k}</x></b>" for k in range(500)) + "</r>"
    df = load_file(spark, write(tmp_path / "far.xml", text))
    assert sorted(df.columns) == ["a_b_x", "a_x", "b_x"]
    assert df.count() == 6500 and df.where("a_x is not null").count() == 6000
    assert df.where("a_x is null").selectExpr("count(distinct b_x)").first()[0] == 500
    assert load_file(spark, str(tmp_path / "far.xml"), row_tags=["b"]).count() == 500
    assert df.rdd.getNumPartitions() > 8


def test_xml_that_is_cut_off(spark, tmp_path):
    for k, text in enumerate(("<r><a>1</a>", "<r><a>1</a><!-- x </r>", "<r><a>1</b></r>", "<r><a>1</a></r></r>", "no markup", "<r><a x='1>2</a></r>")):
        with pytest.raises((errors.DataLoadingError, errors.EmptyDatasetError)):
            load_file(spark, write(tmp_path / f"cut{k}.xml", text))


# ---- line breaks inside quotes ----------------------------------------------------------

def odd_records(n=400):
    cell = ['plain', '"a\nb"', '"x ""y"" \n\n, z"', '', '5" wide', '"\n"', 'é', '"""\n"""', ' "no quote', '"q"']
    lines = [",".join(cell[(k * m + m) % len(cell)] for m in (1, 3, 7)) for k in range(n)]
    return "one,two,three\n" + "\n".join(lines)


def test_records_at_every_range_size(tmp_path):
    from tablens.sources.ranges import Bytes, aligned
    from tablens.sources.records import Cutter

    path = tmp_path / "r.csv"
    path.write_bytes(odd_records(60).encode())
    size, cutter = path.stat().st_size, Cutter(",", '"', "utf-8")
    with Bytes(f"file:{path}", 0, size) as source:
        expected = list(cutter.records(source, 0, size, 0))
    assert len(expected) == 61
    for step in (*range(3, 200, 7), 1000):
        state, got = 0, []
        for start in range(0, size, step):
            with Bytes(f"file:{path}", max(0, start - 1), size) as source:
                low, high = aligned(source, start, min(size, start + step), b"\n", True)
                if low < high:
                    found = cutter.report(source.data[low - source.start : high - source.start])
                    got += cutter.records(source, low, high, state)
                    state = found[state][0]
        assert got == expected, step


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_quoted_line_breaks_as_in_one_task(spark, tmp_path, monkeypatch, ends):
    from tablens.sources import ranges

    monkeypatch.setattr(ranges, "RANGE_BYTES", 700)
    path = write(tmp_path / "q.csv", odd_records().replace("\n", ends))
    options = {"header": True, "sep": ",", "quote": '"', "escape": '"', "multiLine": True, "inferSchema": False}
    expected = spark.read.options(**options).csv(path)
    got = load_file(spark, path, multi_line=True, has_header=True, sep=",", quote_char='"')
    key = lambda rows: sorted(map(str, rows))
    assert key(tuple(x if x and x.strip() else None for x in r) for r in got.collect()) == key(
        tuple(x if x and x.strip() else None for x in r) for r in expected.collect()
    )
    assert got.count() == 400 and got.rdd.getNumPartitions() > 8


def test_xml_report_keeps_no_marks():
    import tracemalloc

    from tablens.sources import xml_rows

    data = b"<r><k>1</k><v>some text</v></r>\n" * 100_000
    tracemalloc.start()
    found = xml_rows.report(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(xml_rows.TEXT, 0), (xml_rows.COMMENT, 0), (xml_rows.DATA, 0), (xml_rows.INSTRUCTION, 0)]
    assert peak < 1 << 20
    mixed = b"<a>--><b/><a></a>]]></a><!-- <a>"
    assert xml_rows.report(mixed) == [(1, 1 - 1), (1, -1), (1, -1), (xml_rows.INSTRUCTION, 0)]
