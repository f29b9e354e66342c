"""Queries over text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from .base import query, table

_STRIP = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


@query(
    "strip_code_fence",
    f"SELECT conv_id, turn, {_STRIP.format(c='text')} AS body FROM conversations",
)
def strip_code_fence(spark, sf):
    fenced = F.concat(F.lit("```python\n"), "text", F.lit("\n```\n"))
    plain = F.concat(F.lit("  "), "text", F.lit(" "))
    reply = F.when(F.col("role") == "user", fenced).otherwise(plain)
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", text.unfenced(reply).alias("body")
    )


@query(
    "json_fix",
    "SELECT event_id, CASE WHEN event_type = 'view' THEN json(props)::VARCHAR WHEN event_type = 'click' THEN json('[' || props || ']')::VARCHAR "
    "ELSE event_type || ': ' || props END AS fixed FROM events",
)
def json_fix(spark, sf):
    kind = F.col("event_type")
    reply = (
        F.when(kind == "view", F.col("props"))
        .when(kind == "click", F.concat(F.lit("Here is the plan: [ "), "props", F.lit(" ]\nDone.")))
        .otherwise(F.concat(kind, F.lit(": "), "props"))
    )
    return table(spark, sf, "events").select("event_id", text.widest_json(reply).alias("fixed"))


@query(
    "split_first_line",
    "SELECT conv_id, turn, CASE WHEN turn = 0 AND NOT contains(text, chr(10)) THEN 'generated_task' "
    f"WHEN turn = 0 THEN {_STRIP.format(c='split_part(text, chr(10), 1)')} ELSE role END AS name, "
    f"CASE WHEN turn = 0 AND contains(text, chr(10)) THEN {_STRIP.format(c='substring(text, position(chr(10) IN text) + 1)')} "
    f"ELSE {_STRIP.format(c='text')} END AS body FROM conversations",
)
def split_first_line(spark, sf):
    reply = F.when(F.col("turn") == 0, F.col("text")).otherwise(
        F.concat(F.col("role"), F.lit("\n"), F.col("text"))
    )
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", text.reply_name(reply).alias("name"), text.reply_body(reply).alias("body")
    )


@query(
    "slugify",
    "SELECT page_id, left(trim(regexp_replace(url, '[^a-zA-Z0-9_\\-]+', '_', 'g'), '_'), 40) AS slug, "
    "left(sha1(html), 12) AS digest FROM pages",
)
def slugify(spark, sf):
    url, html = F.col("url"), F.col("html")
    return table(spark, sf, "pages").select(
        "page_id",
        text.file_slug(url, html).alias("slug"),
        text.file_slug(F.lit(None).cast("string"), html).alias("digest"),
    )
