"""Column expressions for model replies and file names held in text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import strip_space


FENCE = "```"


def unfenced(c: Column) -> Column:
    """The text without a first line that opens a Markdown fence and a last line that closes it."""
    lines = F.split(strip_space(c), "\n")
    language = F.substring(strip_space(lines[0]), len(FENCE) + 1, 1 << 20)
    opens = (F.size(lines) > 1) & lines[0].startswith(FENCE) & language.rlike(r"\A\w*\z")
    body = F.when(opens, F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(1)))).otherwise(lines)
    closes = (F.size(body) > 1) & (strip_space(F.element_at(body, -1)) == FENCE)
    inner = F.when(closes, F.slice(body, F.lit(1), F.greatest(F.size(body) - 1, F.lit(1)))).otherwise(body)
    return strip_space(F.array_join(inner, "\n"))


def _places(pieces: Column, test) -> Column:
    """Numbers of the pieces that pass a test of the piece and its number."""
    found = F.transform(pieces, lambda x, i: F.when(test(strip_space(x), i), i))
    return F.filter(found, lambda i: i.isNotNull())


def widest_json(c: Column) -> Column:
    """JSON of the whole text, else of its widest list of objects, else the text itself.

    The list goes from the first ``[`` before a ``{`` to the last ``]`` behind a ``}``.
    """
    opened = F.split(c, r"\[")
    first = F.get(_places(opened, lambda x, i: (i > 0) & x.startswith("{")), F.lit(0))
    tail = F.concat(F.lit("["), F.array_join(F.slice(opened, first + 1, F.size(opened)), "["))
    closed = F.split(tail, r"\]")
    last = F.array_max(_places(closed, lambda x, i: (i < F.size(closed) - 1) & x.endswith("}")))
    block = F.concat(F.array_join(F.slice(closed, F.lit(1), last + 1), "]"), F.lit("]"))
    return F.coalesce(F.to_json(F.try_parse_json(c)), F.to_json(F.try_parse_json(block)), c)


def reply_name(c: Column) -> Column:
    """First line of a model reply; replies of a single line have no name of their own."""
    return F.when(
        c.contains("\n"), strip_space(F.substring_index(c, "\n", 1))
    ).when(c.isNotNull(), F.lit("generated_task"))


def reply_body(c: Column) -> Column:
    """What follows the first line, or the whole reply when it has one line only."""
    return strip_space(F.regexp_replace(c, r"\A[^\n]*\n", ""))


def file_slug(name: Column, content: Column) -> Column:
    """The runs of letters, digits, ``_`` and ``-`` of ``name``; without a name, a short digest of ``content``."""
    runs = F.array_join(F.regexp_extract_all(name, F.lit("[0-9A-Za-z_-]+"), F.lit(0)), "_")
    kept = F.substring(F.btrim(runs, F.lit("_")), 1, 40)
    digest = F.substring(F.sha1(content), 1, 12)
    return F.when(F.length(name) > 0, F.when(kept == "", F.lit("task")).otherwise(kept)).otherwise(digest)


def shorten_label(c: Column, longest: Column, limit: int = 40) -> Column:
    """Cut labels to ``limit - 1`` characters plus an ellipsis when any label exceeds it."""
    return F.when(
        longest > limit, F.concat(F.substring(c, 1, limit - 1), F.lit("…"))
    ).otherwise(c)


def percent_text(ratio: Column) -> Column:
    return F.format_string("%.2f%%", ratio * 100)
