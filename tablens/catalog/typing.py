"""Value classification, type inference, conversion and narrowing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values
from ..operators import typing
from ..operators.columns import spread
from ..sources.columnar import normalize_nulls_exact
from ..sources.delimited import normalize_nulls_text
from .base import long_sql, query, select_sql, table

# lineitem as a delimited file would hold it: all text, with words that do not fit
DIRTY = (
    "CASE WHEN l_returnflag = 'A' THEN ' Yes' WHEN l_returnflag = 'R' THEN 'no' ELSE 'TRUE' END AS agreed",
    "CASE WHEN l_linenumber = 7 AND l_returnflag = 'A' THEN '5d' ELSE CAST(l_partkey AS STRING) END AS part",
    "CASE WHEN l_linenumber = 6 AND l_returnflag = 'A' THEN 'free' WHEN l_linenumber = 5 AND l_returnflag = 'R' THEN NULL ELSE CAST(l_extendedprice AS STRING) END AS price",
    "CASE WHEN l_linenumber < 4 THEN CAST(l_quantity AS STRING) ELSE CAST(l_quantity + 0.5 AS STRING) END AS mixed",
    "CASE WHEN l_linenumber = 1 THEN 'n/a' ELSE CAST(l_shipdate AS STRING) END AS shipped",
    "CONCAT(SUBSTRING(CAST(l_shipdate AS STRING), 9, 2), '/', SUBSTRING(CAST(l_shipdate AS STRING), 6, 2), '/', SUBSTRING(CAST(l_shipdate AS STRING), 1, 4)) AS day_first",
    "CASE WHEN l_quantity > 40 THEN 'F' WHEN l_quantity > 38 THEN '  ' WHEN l_quantity > 36 THEN ' N/A ' ELSE l_linestatus END AS status",
    "CASE WHEN l_tax > 0.05 THEN 'unknown' WHEN l_tax > 0.03 THEN 'Unknown' WHEN l_tax > 0.01 THEN '-' ELSE CONCAT('k', CAST(l_suppkey AS STRING), ' ', CAST(l_orderkey AS STRING)) END AS code",
    "CASE WHEN l_linenumber > 100 THEN 'x' END AS nothing",
)
DIRTY_COLUMNS = ("agreed", "part", "price", "mixed", "shipped", "day_first", "status", "code", "nothing")
DIRTY_CTE = f"dirty AS ({select_sql(DIRTY, 'lineitem')})"

_FOLDED = "lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"
_TEXT_NULLS = ", ".join(f"'{w}'" for w in values.NULL_WORDS_TEXT)
_EXACT_NULLS = ", ".join(f"'{w}'" for w in values.NULL_WORDS_EXACT)
_NUMBER = "'^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$'"


def dirty(spark, sf):
    return spread(table(spark, sf, "lineitem")).selectExpr(*DIRTY)


_SHOWN = ("status", "code", "shipped")


def _null_words_sql(expression: str) -> str:
    shown = ", ".join(expression.format(c=c) + f" AS {c}" for c in _SHOWN)
    return f"WITH {DIRTY_CTE} SELECT status, code, shipped, count(*) AS n FROM (SELECT {shown} FROM dirty) t GROUP BY 1, 2, 3"


@query(
    "normalize_nulls_csv",
    _null_words_sql("CASE WHEN " + _FOLDED + f" IN ({_TEXT_NULLS}) THEN NULL ELSE {{c}} END"),
)
def normalize_nulls_csv(spark, sf):
    return normalize_nulls_text(dirty(spark, sf)).groupBy(*_SHOWN).agg(F.count("*").alias("n"))


@query(
    "normalize_nulls_parquet",
    _null_words_sql(f"CASE WHEN {{c}} IN ({_EXACT_NULLS}) THEN NULL ELSE {{c}} END"),
)
def normalize_nulls_parquet(spark, sf):
    return normalize_nulls_exact(dirty(spark, sf)).groupBy(*_SHOWN).agg(F.count("*").alias("n"))


@query(
    "cast_lenient",
    f"WITH {DIRTY_CTE} SELECT CASE WHEN regexp_matches(part, {_NUMBER}) THEN TRY_CAST(part AS DOUBLE) END AS part, "
    f"CASE WHEN regexp_matches(price, {_NUMBER}) THEN TRY_CAST(price AS DOUBLE) END AS price, count(*) AS n FROM dirty GROUP BY 1, 2",
)
def cast_lenient(spark, sf):
    df = dirty(spark, sf)
    return (
        df.select(*[values.to_double_lenient(F.col(c)).alias(c) for c in ("part", "price")])
        .groupBy("part", "price")
        .agg(F.count("*").alias("n"))
    )


@query(
    "parse_datetime",
    f"WITH {DIRTY_CTE} SELECT try_strptime(shipped, '%Y-%m-%d %H:%M:%S') AS shipped, try_strptime(day_first, '%d/%m/%Y') AS day_first, count(*) AS n FROM dirty GROUP BY 1, 2",
)
def parse_datetime(spark, sf):
    return (
        dirty(spark, sf)
        .select(
            values.parse_datetime(F.col("shipped"), "%Y-%m-%d %H:%M:%S").alias("shipped"),
            values.parse_datetime(F.col("day_first"), "%d/%m/%Y").alias("day_first"),
        )
        .groupBy("shipped", "day_first")
        .agg(F.count("*").alias("n"))
    )


_WORD = _FOLDED.format(c="word")


@query(
    "parse_boolean",
    f"WITH {DIRTY_CTE}, words AS (SELECT agreed AS word FROM dirty UNION ALL SELECT status FROM dirty) "
    f"SELECT word, CASE WHEN {_WORD} IN ('true', '1', 'yes') THEN true WHEN {_WORD} IN ('false', '0', 'no') THEN false END AS parsed, count(*) AS n FROM words GROUP BY 1, 2",
)
def parse_boolean(spark, sf):
    df = dirty(spark, sf)
    words = df.select(F.col("agreed").alias("word")).union(df.select("status"))
    return (
        words.withColumn("parsed", values.parse_boolean(F.col("word")))
        .groupBy("word", "parsed")
        .agg(F.count("*").alias("n"))
    )


_HEADER_NULLS = ", ".join(f"'{w}'" for w in values.NULL_WORDS_HEADER)
_BARE = "regexp_replace(v, '^\\s+|\\s+$', '', 'g')"
_CORE = f"regexp_replace({_BARE}, '[_\\-\\s]+', '', 'g')"


@query(
    "classify_value",
    f"WITH {DIRTY_CTE}, cells AS ({long_sql('dirty', ('part', 'price', 'status', 'code', 'day_first'), 'VARCHAR')}) "
    "SELECT column_name, coalesce(regexp_matches(v, '^(\\d+\\.?\\d*|\\.\\d+)$'), false) AS is_number, "
    f"coalesce(regexp_matches({_BARE}, '^[A-Za-z0-9 _\\-]+$') AND NOT regexp_matches({_CORE}, '^[\\d.]*$') "
    f"AND length(regexp_replace({_CORE}, '[^\\p{{L}}]', '', 'g')) > 0.6 * length({_CORE}), false) AS is_identifier, "
    f"v IS NULL OR lower({_BARE}) IN ({_HEADER_NULLS}) AS is_null_like, count(*) AS n FROM cells GROUP BY ALL",
)
def classify_value(spark, sf):
    cells = dirty(spark, sf).unpivot(
        [], ["part", "price", "status", "code", "day_first"], "column_name", "v"
    )
    v = F.col("v")
    return (
        cells.select(
            "column_name",
            values.is_plain_number(v).alias("is_number"),
            values.is_identifier_like(v).alias("is_identifier"),
            values.is_header_null(v).alias("is_null_like"),
        )
        .groupBy("column_name", "is_number", "is_identifier", "is_null_like")
        .agg(F.count("*").alias("n"))
    )


_FORMATS = values.DATETIME_FORMATS
_DATED = ", ".join(
    f"count(CASE WHEN regexp_matches(v, '{values.datetime_regex(f)[0]}') THEN try_strptime(v, '{f}') END) AS f{i}"
    for i, f in enumerate(_FORMATS)
)
_CHOSEN = "CASE " + " ".join(f"WHEN f{i} > 0 THEN f{i}" for i in range(len(_FORMATS))) + " ELSE 0 END"
_CHOSEN_NAME = "CASE " + " ".join(f"WHEN f{i} > 0 THEN '{f}'" for i, f in enumerate(_FORMATS)) + " END"
_RATIOS = (
    f"{DIRTY_CTE}, cells AS ({long_sql('dirty', DIRTY_COLUMNS, 'VARCHAR')}), "
    "numbers AS (SELECT column_name, v, CASE WHEN regexp_matches(v, " + _NUMBER + ") THEN TRY_CAST(v AS DOUBLE) END AS x, "
    f"{_FOLDED.format(c='v')} IN ('true', 'false', 'yes', 'no', '0', '1') AS is_bool FROM cells), "
    "scores AS (SELECT column_name, count(v) AS n, count(x) AS numeric, count(CASE WHEN x % 1 = 0 THEN 1 END) AS whole, "
    f"coalesce(bool_and(is_bool), false) AS all_bool, count(DISTINCT v) AS n_unique, {_DATED} FROM numbers GROUP BY column_name), "
    "ratios AS (SELECT column_name, CASE WHEN n = 0 THEN 0 ELSE whole / CAST(n AS DOUBLE) END AS int_ratio, "
    "CASE WHEN n = 0 THEN 0 ELSE (numeric - whole) / CAST(n AS DOUBLE) END AS float_ratio, "
    f"CASE WHEN n = 0 THEN 0 ELSE ({_CHOSEN}) / CAST(n AS DOUBLE) END AS datetime_ratio, "
    "CASE WHEN all_bool THEN 1.0 ELSE 0.0 END AS boolean_ratio, "
    "CASE WHEN n = 0 THEN 0 ELSE 1 - n_unique / CAST(n AS DOUBLE) END AS category_ratio, "
    f"CASE WHEN n = 0 THEN 1 WHEN all_bool THEN 0 ELSE (n - numeric - ({_CHOSEN})) / CAST(n AS DOUBLE) END AS string_ratio, "
    f"{_CHOSEN_NAME} AS datetime_format FROM scores), "
    "decided AS (SELECT *, CASE WHEN boolean_ratio >= 0.98 THEN 'Boolean' WHEN int_ratio >= 0.9 THEN 'Int' WHEN float_ratio >= 0.9 THEN 'Float' "
    "WHEN int_ratio + float_ratio >= 0.9 THEN 'Float' WHEN datetime_ratio >= 0.7 THEN 'Datetime' WHEN category_ratio >= 0.95 THEN 'Category' ELSE 'String' END AS inferred_type, "
    "CASE WHEN boolean_ratio >= 0.98 THEN boolean_ratio / (boolean_ratio + string_ratio) WHEN int_ratio >= 0.9 THEN int_ratio WHEN float_ratio >= 0.9 THEN float_ratio "
    "WHEN int_ratio + float_ratio >= 0.9 THEN int_ratio + float_ratio WHEN datetime_ratio >= 0.7 THEN datetime_ratio / (datetime_ratio + string_ratio) "
    "WHEN category_ratio >= 0.95 THEN category_ratio ELSE string_ratio END AS confidence FROM ratios)"
)
_RATIO_COLUMNS = ("int_ratio", "float_ratio", "datetime_ratio", "boolean_ratio", "category_ratio", "string_ratio")


@query(
    "type_ratios",
    f"WITH {_RATIOS} SELECT column_name, "
    + ", ".join(f"CAST(round({c}, 8) AS DOUBLE) AS {c}" for c in _RATIO_COLUMNS)
    + ", datetime_format FROM ratios",
)
def type_ratios(spark, sf):
    return typing.type_ratios(dirty(spark, sf)).withColumns(
        {c: F.round(c, 8) for c in _RATIO_COLUMNS}
    )


@query(
    "infer_types",
    f"WITH {_RATIOS} SELECT column_name, inferred_type, CAST(round(confidence, 8) AS DOUBLE) AS confidence FROM decided",
)
def infer_types(spark, sf):
    return typing.infer_types(dirty(spark, sf)).withColumn("confidence", F.round("confidence", 8))


_CONVERTED = (
    f"converted AS (SELECT {_FOLDED.format(c='agreed')} IN ('true', '1', 'yes') AS agreed, "
    f"CAST(CASE WHEN regexp_matches(part, {_NUMBER}) THEN TRY_CAST(part AS DOUBLE) END AS BIGINT) AS part, "
    f"CASE WHEN regexp_matches(price, {_NUMBER}) THEN TRY_CAST(price AS DOUBLE) END AS price, CAST(mixed AS DOUBLE) AS mixed, "
    "try_strptime(shipped, '%Y-%m-%d %H:%M:%S') AS shipped, try_strptime(day_first, '%d/%m/%Y') AS day_first, status, code, nothing FROM dirty)"
)


@query(
    "convert_types",
    f"WITH {DIRTY_CTE}, {_CONVERTED} SELECT agreed, part, price, mixed, shipped, day_first, status, count(*) AS n FROM converted GROUP BY ALL",
)
def convert_types(spark, sf):
    columns = ("agreed", "part", "price", "mixed", "shipped", "day_first", "status")
    return typing.convert_types(dirty(spark, sf)).groupBy(*columns).agg(F.count("*").alias("n"))


@query(
    "schema_report",
    f"WITH {_RATIOS}, {_CONVERTED}, "
    "facts AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS total, count(*) - (SELECT count({c}) FROM dirty) AS null_values, "
        f"(SELECT count({c}) FROM dirty) - count({c}) AS invalid, count(DISTINCT {c}) AS distinct_count, "
        + (f"avg(length({c}))" if c in ("status", "code", "nothing") else "NULL")
        + " AS len FROM converted"
        for c in DIRTY_COLUMNS
    )
    + ") SELECT f.column_name AS name, inferred_type, printf('%.2f%%', confidence * 100) AS confidence, invalid AS invalid_conversions, null_values, distinct_count, "
    "printf('%.2f%%', distinct_count * 100.0 / total) AS unique_ratio, printf('%.2f%%', null_values * 100.0 / total) AS missing_ratio, "
    "CASE WHEN len IS NOT NULL THEN printf('%.2f', len) END AS mean_length, distinct_count = 1 AS is_constant, distinct_count = total AS is_identifier "
    "FROM facts f JOIN decided d ON f.column_name = d.column_name",
)
def schema_report(spark, sf):
    return typing.schema_report(dirty(spark, sf))


@query(
    "schema_report_declared",
    "SELECT name, inferred_type, '100%' AS confidence, CAST(0 AS BIGINT) AS invalid_conversions, CAST(0 AS BIGINT) AS null_values, distinct_count, "
    "printf('%.2f%%', distinct_count * 100.0 / total) AS unique_ratio, '0.00%' AS missing_ratio, mean_length, distinct_count = 1 AS is_constant, distinct_count = total AS is_identifier FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS name, '{t}' AS inferred_type, count(*) AS total, count(DISTINCT {c}) AS distinct_count, "
        + (f"printf('%.2f', avg(length({c})))" if t == "string" else "NULL")
        + " AS mean_length FROM customer"
        for c, t in (
            ("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
            ("c_acctbal", "double"), ("c_mktsegment", "string"),
        )
    )
    + ") t",
)
def schema_report_declared(spark, sf):
    return typing.schema_report(table(spark, sf, "customer"), declared=True)


def _narrow_sql(column: str, source: str) -> str:
    return (
        f"SELECT '{column}' AS column_name, 'bigint' AS from_type, CASE WHEN min({column}) >= -128 AND max({column}) < 128 THEN 'tinyint' "
        f"WHEN min({column}) >= -32768 AND max({column}) < 32768 THEN 'smallint' WHEN min({column}) >= -2147483648 AND max({column}) < 2147483648 THEN 'int' ELSE 'bigint' END AS to_type FROM {source}"
    )


_WIDE = (
    "l_orderkey", "l_partkey", "l_suppkey", "CAST(l_linenumber AS BIGINT) AS line",
    "l_orderkey * 100000000 AS large", "l_tax AS tax", "l_extendedprice * 1e300 AS huge", "l_returnflag",
)


@query(
    "downcast_plan",
    f"WITH wide AS ({select_sql(_WIDE, 'lineitem')}) "
    + " UNION ALL ".join(_narrow_sql(c, "wide") for c in ("l_orderkey", "l_partkey", "l_suppkey", "line", "large"))
    + " UNION ALL SELECT 'tax', 'double', CASE WHEN max(abs(tax)) <= 3.4e38 THEN 'float' ELSE 'double' END FROM wide"
    " UNION ALL SELECT 'huge', 'double', CASE WHEN max(abs(huge)) <= 3.4e38 THEN 'float' ELSE 'double' END FROM wide"
    " UNION ALL SELECT 'l_returnflag', 'string', 'string'",
)
def downcast_plan(spark, sf):
    return typing.downcast_plan(table(spark, sf, "lineitem").selectExpr(*_WIDE), floats=True)
