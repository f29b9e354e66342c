"""Line deduplication by content-defined chunks of lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .common import BITMAP_ROWS, bitmap_of, in_bitmap, let

MASK = 2  # a boundary after every second line on average
LONG_WORDS = 50  # a line of so many words is a chunk by itself
LEAST_WORDS = 8  # chunks with fewer words stay

# fixed values: scripts without spaces (about two and about four characters a word), and white space
DENSE = r"\u2E80-\u2FFF\u3005-\u3007\u3021-\u3029\u3031-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\x{20000}-\x{3FFFF}"
LOOSE = r"\u0E00-\u0FFF\u1000-\u109F\u1780-\u17FF\u19E0-\u19FF\uA9E0-\uA9FF\uAA60-\uAA7F"
SPACE = r"\s\x1C-\x1F\u0085\u00A0\u1680\u2000-\u200B\u2028\u2029\u202F\u205F\u3000"
WORD = rf"[{DENSE}]{{1,2}}|[{LOOSE}]{{1,4}}|[^{SPACE}{DENSE}{LOOSE}]+"
FAR = r"[\u0E00-\u200B\u2028\u2029\u202F\u205F\u2E80-\x{10FFFF}]"  # lines without these take the faster pattern


def line_hash(line: Column) -> Column:
    """32 bits of a line."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def line_words(line: Column) -> Column:
    """Spaces plus one."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def text_words(text: Column) -> Column:
    """Words between white space of any kind; scripts without spaces count by their characters."""
    near = F.regexp_count(text, F.lit(r"[^\s\x1C-\x1F\u0085\u00A0]+"))
    return F.when(text.rlike(FAR), F.regexp_count(text, F.lit(WORD))).otherwise(near)


def chunks(text: Column, counts: Column | None = None) -> Column:
    """Array of ``(first, last, words, chunk)``: whole lines cut where their content says so.

    A cyclic-polynomial hash rolls over the hashes of two lines; a boundary stands after a line
    when the hash has a certain bit off, so an inserted line moves only the boundaries next to it.
    Boundaries also stand around lines of ``LONG_WORDS`` words or more. ``counts`` has the words of
    each line, if they are not to be counted by spaces.
    """

    def ends(marks: Column) -> Column:
        def is_end(i: Column) -> Column:
            before = F.coalesce(F.get(marks, i - 1)["hash"], F.lit(0).cast("long"))
            rolled = F.get(marks, i)["hash"].bitwiseXOR(F.shiftleft(before, 1))
            return (
                (i == F.size(marks) - 1)
                | (F.pmod(F.shiftright(rolled, 5), F.lit(MASK)) == 0)
                | (F.get(marks, i)["words"] >= LONG_WORDS)
                | F.coalesce(F.get(marks, i + 1)["words"] >= LONG_WORDS, F.lit(False))
            )

        return F.filter(F.sequence(F.lit(0), F.size(marks) - 1), is_end)

    def cut_at(lines: Column, marks: Column, stops: Column) -> Column:
        def piece(last: Column, k: Column) -> Column:
            first = F.coalesce(F.get(stops, k - 1) + 1, F.lit(0))
            chunk = F.array_join(F.slice(lines, first + 1, last - first + 1), "\n")
            return F.struct(
                first.alias("first"), last.alias("last"), size(first, last, chunk).alias("words"), chunk.alias("chunk")
            )

        return F.transform(stops, piece)

    def size(first: Column, last: Column, chunk: Column) -> Column:
        if counts is None:
            return line_words(chunk)
        return F.aggregate(F.slice(counts, first + 1, last - first + 1), F.lit(0), lambda n, x: n + x)

    def mark(line: Column, i: Column) -> Column:
        words = line_words(line) if counts is None else F.get(counts, i)
        return F.struct(line_hash(line).alias("hash"), words.alias("words"))

    return let(
        F.split(text, "\n"),
        lambda lines: let(
            F.transform(lines, mark),
            lambda marks: let(ends(marks), lambda stops: cut_at(lines, marks, stops)),
        ),
    )


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, first, last, hash, chunk)`` of all chunks that may go."""
    text = F.col(text_col)
    return (
        docs.where(text.isNotNull())
        .select(doc_key(id_col, text_col).alias("doc"), F.explode(chunks(text)).alias("piece"))
        .select("doc", "piece.*")
        .where((F.col("words") >= LEAST_WORDS) & ((F.col("last") > F.col("first")) | (F.col("words") >= LONG_WORDS)))
        .select("doc", "first", "last", F.xxhash64("chunk").alias("hash"), "chunk")
    )


def doc_key(id_col: str, text_col: str) -> Column:
    """Order and identity of a document; null ids come last."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.struct(
        F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash")
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated chunks of lines cut out of ``text_col``, plus ``removed_lines``.

    Of chunks of two or more lines (or one line of ``LONG_WORDS`` words or more) that are equal in
    every byte, the one in the document with the smallest id, first in it, stays; the others go,
    also within a document. Rows equal in id and text count as one document and change alike. Null
    and empty texts stay as they are; null ids come last in the order. An empty table gives no rows,
    and all other columns pass through. A text that loses everything becomes empty.

    Chunks whose 64-bit hash repeats are found by counts; only they are compared byte for byte, and
    only documents that lose lines are shuffled with their texts.
    """
    found = occurrences(docs, id_col, text_col)
    repeated = found.groupBy("hash").count().where("count > 1")
    bitmap = cut(bitmap_of(repeated, "hash", BITMAP_ROWS))
    again = in_bitmap(found, "hash", bitmap, BITMAP_ROWS)
    place = F.struct("doc", "first")
    settled = cut(
        again.groupBy("hash", "chunk")  # grouping compares the bytes
        .agg(F.min(place).alias("stays"), F.count("*").alias("n"))
        .where("n > 1")
        .select("hash", F.sha2("chunk", 256).alias("digest"), "stays")
    )
    losses = cut(
        again.withColumn("digest", F.sha2("chunk", 256))
        .select("hash", "digest", "doc", "first", "last")
        .join(settled, ["hash", "digest"])
        .where(place != F.col("stays"))
        .groupBy("doc")
        .agg(F.collect_set(F.struct("first", "last")).alias("gone"))
    )
    doc, gone = "__doc", "__gone"
    marked = docs.withColumn(doc, doc_key(id_col, text_col))
    losses = losses.select(F.col("doc").alias(doc), F.col("gone").alias(gone))
    joined = marked.join(losses, doc, "left")
    kept = F.filter(
        F.transform(F.split(F.col(text_col), "\n"), lambda line, i: F.struct(i.alias("i"), line.alias("line"))),
        lambda x: ~F.exists(F.col(gone), lambda g: x["i"].between(g["first"], g["last"])),
    )
    rest = F.array_join(F.transform(kept, lambda x: x["line"]), "\n")
    lost = F.aggregate(
        F.col(gone), F.lit(0), lambda n, g: n + (g["last"] - g["first"] + 1)
    )
    return joined.select(
        *[F.when(F.col(gone).isNull(), F.col(c)).otherwise(rest).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.coalesce(lost, F.lit(0)).alias("removed_lines"),
    )


def windows(counts: Column) -> Column:
    """Array of ``(first, last)``: the shortest windows of lines that hold ``LONG_WORDS`` words.

    One from each line on and one up to each line, given once if they are the same. A line lies in
    some repeated run of ``LONG_WORDS`` words exactly if it lies in a repeated one of these. Windows
    start and end at lines with words, so that none takes more than ``LONG_WORDS`` of such lines.
    """

    def reach(run: Column, start: Column) -> Column:
        def step(sofar: Column, mark: Column) -> Column:
            more = F.struct((sofar["words"] + mark["words"]).alias("words"), mark["i"].alias("at"))
            return F.when(sofar["words"] < LONG_WORDS, more).otherwise(sofar)

        return F.aggregate(run, F.struct(F.lit(0).alias("words"), start["i"].alias("at")), step)

    def onward(marks: Column) -> Column:
        def window(mark: Column, k: Column) -> Column:
            end = reach(F.slice(marks, k + 1, F.lit(LONG_WORDS)), mark)
            return let(end, lambda x: F.struct(mark["i"].alias("first"), x["at"].alias("last"), (x["words"] >= LONG_WORDS).alias("full")))

        return F.transform(marks, window)

    def backward(marks: Column) -> Column:
        def window(mark: Column, k: Column) -> Column:
            size = F.least(k + 1, F.lit(LONG_WORDS))
            start = reach(F.reverse(F.slice(marks, k + 2 - size, size)), mark)
            new = lambda x: x["words"] - mark["words"] >= LONG_WORDS  # noqa: E731  not the shortest from its first line on
            return let(start, lambda x: F.struct(x["at"].alias("first"), mark["i"].alias("last"), new(x).alias("full")))

        return F.transform(marks, window)

    def mark(words: Column, i: Column) -> Column:
        return F.struct(i.alias("i"), words.alias("words"))

    found = let(
        F.filter(F.transform(counts, mark), lambda x: x["words"] > 0),
        lambda marks: F.concat(onward(marks), backward(marks)),
    )
    return F.filter(found, lambda x: x["full"])


def passages(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """``(doc, first, last, digest)`` of all windows, and of chunks of several lines below their size."""
    text = F.col(text_col)

    def short(chunk: Column) -> Column:
        return (chunk["words"] >= LEAST_WORDS) & (chunk["words"] < LONG_WORDS) & (chunk["last"] > chunk["first"])

    def named(lines: Column, counts: Column) -> Column:
        def name(x: Column) -> Column:
            passage = F.array_join(F.slice(lines, x["first"] + 1, x["last"] - x["first"] + 1), "\n")
            return F.struct(x["first"].alias("first"), x["last"].alias("last"), digest(passage).alias("digest"))

        seeds = F.transform(
            F.filter(chunks(text, counts), short),
            lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), F.lit(True).alias("full")),
        )
        return F.transform(F.concat(windows(counts), seeds), name)

    found = let(
        F.split(text, "\n"),
        lambda lines: let(F.transform(lines, text_words), lambda counts: named(lines, counts)),
    )
    return (
        docs.where(text.isNotNull())
        .select(doc_key(id_col, text_col).alias("doc"), F.explode(found).alias("passage"))
        .select("doc", "passage.*")
    )


def passage_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines of repeated passages, plus ``removed_lines``.

    A line goes if it lies in a run of whole lines of ``LONG_WORDS`` words or more, first and last
    line not blank, that stands, equal in every byte, also at an earlier place that it does not
    overlap; or in such a chunk of two or
    more lines of ``LEAST_WORDS`` words or more. Places are ordered by id and line, so that the first
    copy of a passage stays. Words are parted by white space of any kind; in scripts without spaces
    they are counted by characters. Rows equal in id and text, null and empty texts, null ids, empty
    tables and other columns are treated as by ``line_dedup``.

    Passages whose 64-bit hash repeats are found by counts; only they are compared, by SHA-256, and
    only documents that lose lines are shuffled with their texts.
    """
    hashed = passages(docs, id_col, text_col, F.xxhash64).select(F.col("digest").alias("hash"))
    bitmap = cut(bitmap_of(hashed.groupBy("hash").count().where("count > 1"), "hash", BITMAP_ROWS))

    def both(passage: Column) -> Column:
        return F.struct(F.xxhash64(passage).alias("hash"), F.unhex(F.sha2(passage, 256)).alias("sha"))

    found = passages(docs, id_col, text_col, both).select("doc", "first", "last", "digest.*")
    again = cut(in_bitmap(found, "hash", bitmap, BITMAP_ROWS).drop("hash"))
    settled = (
        again.groupBy("sha")
        .agg(F.min(F.struct("doc", "first", "last")).alias("stays"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    losses = (
        again.join(settled, "sha")
        .where((F.col("doc") != F.col("stays.doc")) | (F.col("first") > F.col("stays.last")))
        .groupBy(F.col("doc").alias("__doc"))
        .agg(F.collect_set(F.struct("first", "last")).alias("__gone"))
    )
    joined = docs.withColumn("__doc", doc_key(id_col, text_col)).join(cut(losses), "__doc", "left")
    gone = F.flatten(F.transform("__gone", lambda g: F.sequence(g["first"], g["last"])))
    lines = F.split(F.col(text_col), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    rest = let(lines, lambda x: F.array_join(F.transform(kept, lambda i: F.get(x, i)), "\n"))
    lost = F.size(lines) - F.size(kept)
    return joined.select(
        *[F.when(F.col("__gone").isNull(), F.col(c)).otherwise(rest).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.when(F.col("__gone").isNull(), 0).otherwise(lost).alias("removed_lines"),
    )
