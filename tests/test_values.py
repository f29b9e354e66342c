from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablens.functions import text, values
from tablens.functions.bins import digitized_label, histogram_bin


def column(spark, rows, build, schema="v string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in df.select(build(F.col("v"))).collect()]


def test_null_words(spark):
    rows = ["N/A", " na ", "--", "-", "?", "", "  ", "x", None, "nil"]
    assert column(spark, rows, values.null_word_to_null) == [None] * 7 + ["x", None, "nil"]
    exact = column(spark, rows, values.exact_null_word_to_null)
    assert exact == ["N/A", " na ", None, "-", None, None, "  ", "x", None, "nil"]


def test_lenient_numbers(spark):
    rows = ["1", "-2.5", "1e3", ".5", "5.", "5d", " 5 ", "", "abc", None, "1_000", "+7"]
    got = column(spark, rows, values.to_double_lenient)
    assert got == [1.0, -2.5, 1000.0, 0.5, 5.0, None, None, None, None, None, None, 7.0]


def test_whole_numbers(spark):
    rows = [1.0, 1.5, float("inf"), float("nan"), None, -3.0]
    assert column(spark, rows, values.is_whole, "v double") == [True, False, False, False, False, True]


def test_booleans(spark):
    rows = ["TRUE", " yes", "1", "No", "0", "false", "y", None]
    assert column(spark, rows, values.parse_boolean) == [True] * 3 + [False] * 3 + [None] * 2


@pytest.mark.parametrize(
    "fmt, good, bad",
    [
        ("%Y-%m-%d %H:%M:%S", "2024-3-10 02:30:00", "2024-03-10"),
        ("%d-%m-%Y %H:%M:%S", "10-03-2024 02:30:00", "31-02-2024 00:00:00"),
        ("%d/%m/%Y %H:%M:%S", "10/03/2024 02:30:00", "10-03-2024 02:30:00"),
        ("%d %b %Y %H:%M:%S", "10 Mar 2024 02:30:00", "10 Mrz 2024 02:30:00"),
        ("%d %B %Y %H:%M:%S", "10 march 2024 02:30:00", "10 Marchy 2024 02:30:00"),
        ("%Y-%m-%d", "2024-03-10", "24-03-10"),
        ("%d-%m-%Y", "10-03-2024", "2024-03-10"),
        ("%m-%d-%Y", "03-10-2024", "13-10-2024"),
        ("%d/%m/%Y", "10/3/2024", "10/13/2024"),
        ("%m/%d/%Y", "3/10/2024", "13/10/2024"),
    ],
)
def test_datetime_formats(spark, fmt, good, bad):
    # 02:30 on that day does not exist in the session's zone: zone-free parsing keeps it
    expected = datetime(2024, 3, 10, *((2, 30) if "%H" in fmt else (0, 0)))
    got = column(spark, [good, bad, None, "x"], lambda c: values.parse_datetime(c, fmt))
    assert got == [expected, None, None, None]


def test_value_classes(spark):
    rows = ["name", "first_name", "a1", "12", "1.5", "a b-c", "é", "12ab", "", None, '"id"', "-"]
    identifiers = column(spark, rows, values.is_identifier_like)
    assert identifiers == [
        True, True, False, False, False, True, False, False, False, False, False, False,
    ]
    numbers = column(spark, ["1", "1.", ".5", ".", "-1", "1.2.3", None], values.is_plain_number)
    assert numbers == [True, True, True, False, False, False, False]


def test_bins_follow_their_edges(spark):
    rows = [i / 100 for i in range(11)]
    step = (0.1 - 0.0) / 20.0
    expected = [21 if v >= 0.1 else sum(v >= 0.0 + i * step for i in range(20)) for v in rows]
    got = column(spark, rows, lambda c: digitized_label(c, F.lit(0.0), F.lit(0.1), 20), "v double")
    assert got == expected
    closed = column(spark, rows, lambda c: histogram_bin(c, F.lit(0.0), F.lit(0.1), 20), "v double")
    assert closed == [min(v, 20) for v in expected]


def test_bins_without_width(spark):
    got = column(spark, [1.0, None], lambda c: digitized_label(c, F.lit(1.0), F.lit(1.0), 20), "v double")
    assert got == [0, None]
    got = column(spark, [1.0, None], lambda c: histogram_bin(c, F.lit(1.0), F.lit(1.0), 5), "v double")
    assert got == [1, None]


def test_code_fences(spark):
    rows = ["```json\n[1]\n```", "  ```\nx\n```\n", "plain", "a\n```b```"]
    assert column(spark, rows, text.unfenced) == ["[1]", "x", "plain", "a\n```b```"]


def test_json_fix(spark):
    rows = ['{"a": 1}', 'Sure: [ {"a": 1},\n {"b": 2} ] done', "no json", "[ {bad} ]", None]
    got = column(spark, rows, text.widest_json)
    assert got == ['{"a":1}', '[{"a":1},{"b":2}]', "no json", "[ {bad} ]", None]


def test_reply_split(spark):
    rows = ["plot_sales\nimport x\n y", "only code", " name \n\ncode \n"]
    assert column(spark, rows, text.reply_name) == ["plot_sales", "generated_task", "name"]
    assert column(spark, rows, text.reply_body) == ["import x\n y", "only code", "code"]


def test_slugs(spark):
    rows = ["Sales by Region!", "!!!", "a" * 50, "ok-name_1"]
    got = column(spark, rows, lambda c: text.file_slug(c, F.lit("code")))
    assert got == ["Sales_by_Region", "task", "a" * 40, "ok-name_1"]
    assert column(spark, [None, ""], lambda c: text.file_slug(c, F.lit("code"))) == ["e6fb06210faf"] * 2


def test_labels(spark):
    long = "x" * 45
    got = column(spark, [long, "short"], lambda c: text.shorten_label(c, F.lit(45)))
    assert got == ["x" * 39 + "…", "short…"]  # every label of the chart is marked
    assert column(spark, ["short"], lambda c: text.shorten_label(c, F.lit(40))) == ["short"]
