"""Frequent words of a corpus, found without shuffling words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HELD = 200_000  # words that a task counts at once
SENT = 4096  # words that a task names
LONGEST = 64  # characters of a word that may be named


def frequent_words(docs: DataFrame, text_col: str, split: Callable[[str], list[str]], most: int) -> list[str]:
    """At most ``most`` words of ``docs``, the most frequent first; only speed depends on them.

    Each task reads all its texts, counts words in bounded memory (rare ones are forgotten when
    there are too many) and names at most ``SENT``; their counts are summed.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    counts.update(split(text.as_py()))
                if len(counts) > HELD:
                    counts = Counter(dict(counts.most_common(HELD // 4)))
        top = [(w, n) for w, n in counts.most_common(SENT) if len(w) <= LONGEST and n > 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"]
        )

    named = docs.select(text_col).mapInArrow(count, "word string, n long")
    top = named.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return [row.word for row in top.collect()]
