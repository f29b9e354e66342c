"""Column expressions that classify, normalise and convert single values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: words treated as missing, by source ------------------------------
# delimited text: compared after trim and lower-casing
NULL_WORDS_TEXT = (
    "", "null", "none", "nan", "n/a", "na", "#n/a", "#na", "--", "-", "?",
    "unknown", "missing", "undefined", ".", "blank", "empty",
)
# Parquet: compared as stored
NULL_WORDS_EXACT = (
    " ", "", "null", "none", "nan", "n/a", "na", "#n/a", "#na", "--", "?",
    "unknown", "missing", "undefined", ".", "blank", "empty",
)
# header detection: compared after trim and lower-casing
NULL_WORDS_HEADER = (
    " ", "null", "none", "nan", "n/a", "na", "#n/a", "#na", "--", "?", "unknown",
    "missing", "#value!", "#ref!", "nil", "undefined", ".", "blank", "empty",
)
TRUE_WORDS = ("true", "1", "yes")
FALSE_WORDS = ("false", "0", "no")
DATETIME_FORMATS = (
    "%Y-%m-%d %H:%M:%S",
    "%d-%m-%Y %H:%M:%S",
    "%d/%m/%Y %H:%M:%S",
    "%d %b %Y %H:%M:%S",
    "%d %B %Y %H:%M:%S",
    "%Y-%m-%d",
    "%d-%m-%Y",
    "%m-%d-%Y",
    "%d/%m/%Y",
    "%m/%d/%Y",
)
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december",
)
# ---- end of fixed values --------------------------------------------------------------

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity|nan)$"


def strip_space(c: Column) -> Column:
    """Remove leading and trailing white space of any kind (plain ``trim`` removes blanks only)."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def folded(c: Column) -> Column:
    return F.lower(strip_space(c))


def null_word_to_null(c: Column) -> Column:
    """Delimited-text rule: trimmed, case-insensitive null words become null."""
    return F.when(~folded(c).isin(*NULL_WORDS_TEXT), c)


def exact_null_word_to_null(c: Column) -> Column:
    """Parquet rule: only exact, case-sensitive null words become null."""
    return F.when(~c.isin(*NULL_WORDS_EXACT), c)


def is_header_null(c: Column) -> Column:
    return c.isNull() | folded(c).isin(*NULL_WORDS_HEADER)


def is_plain_number(c: Column) -> Column:
    """Digits with at most one decimal point; no sign, blank or exponent."""
    return F.coalesce(c.rlike(r"^(\d+\.?\d*|\.\d+)$"), F.lit(False))


def is_identifier_like(c: Column) -> Column:
    """Looks like a column name: word characters, blanks and dashes, mostly letters."""
    letters = F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    signs = F.length(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    return F.coalesce(
        c.rlike(r"^\s*[A-Za-z0-9 _\-]+\s*$") & (letters > 0.6 * signs), F.lit(False)
    )


def to_double_lenient(c: Column) -> Column:
    """Text to double, null when the *whole* text is not a number (``'5d'``, ``' 5 '``)."""
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def is_whole(x: Column) -> Column:
    return F.coalesce(x % F.lit(1.0) == 0, F.lit(False))


def to_long_rounded(x: Column) -> Column:
    return F.round(x, 0).try_cast("bigint")


def is_boolean_word(c: Column) -> Column:
    return folded(c).isin(*TRUE_WORDS, *FALSE_WORDS)


def parse_boolean(c: Column) -> Column:
    word = folded(c)
    return (
        F.when(word.isin(*TRUE_WORDS), F.lit(True))
        .when(word.isin(*FALSE_WORDS), F.lit(False))
    )


_DIRECTIVES = {
    "Y": r"(\d{4})", "m": r"(\d{1,2})", "d": r"(\d{1,2})", "H": r"(\d{1,2})",
    "M": r"(\d{1,2})", "S": r"(\d{1,2})", "b": r"([A-Za-z]{3})", "B": r"([A-Za-z]+)",
}


def datetime_regex(fmt: str) -> tuple[str, str]:
    """Regular expression for a strftime format, and its directives in group order."""
    pieces = re.split(r"%(\w)", fmt)
    body = "".join(
        _DIRECTIVES[p] if i % 2 else re.escape(p) for i, p in enumerate(pieces)
    )
    return f"^{body}$", "".join(pieces[1::2])


def parse_datetime(c: Column, fmt: str) -> Column:
    """Text to a zone-free timestamp by one strftime format; null when it does not fit.

    The matched parts are put in ISO order, which the built-in cast reads.
    """
    regex, order = datetime_regex(fmt)
    group = {directive: f"${i}" for i, directive in enumerate(order, start=1)}
    clock = " {H}:{M}:{S}".format(**group) if "H" in order else ""
    named = next((d for d in "bB" if d in order), None)
    if fmt in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d"):
        iso = c
    elif named is None:
        iso = F.regexp_replace(c, regex, "{Y}-{m}-{d}".format(**group) + clock)
    else:
        names = F.array(*[F.lit(m[:3] if named == "b" else m) for m in MONTHS])
        name = F.lower(F.regexp_extract(c, regex, order.index(named) + 1))
        iso = F.concat(
            F.regexp_replace(c, regex, group["Y"] + "-"),
            F.nullif(F.array_position(names, name), F.lit(0)).cast("string"),
            F.regexp_replace(c, regex, "-" + group["d"] + clock),
        )
    return F.when(c.rlike(regex), iso.try_cast("timestamp_ntz"))
