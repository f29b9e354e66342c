"""Token counts of a piece model by two tiers of lookup tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import frequent_words

FREQUENT = 32768  # words in the broadcast table
CACHED = 400_000  # further words that a worker remembers

WORD = re.compile(r" *[^ ]+| +")


def split_words(text: str) -> list[str]:
    """Pre-tokens of a text: pieces never go over the end of a word into the next space.

    The model puts a space before a text and reads U+2581 as a space.
    """
    return WORD.findall(" " + text.replace("▁", " ")) if text else []


def word_lengths(model, words: list[str]) -> list[int]:
    """Tokens of each pre-token; the model adds the first space itself."""
    ids = model.encode([w[1:] for w in words], num_threads=1)
    return [len(x) if len(w) > 1 else 1 for w, x in zip(words, ids)]


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row per document.

    Counts are those of the ``sentencepiece`` model without added tokens. Null texts count as empty
    and have no tokens; null ids pass through; an empty table gives no rows; other columns are not
    read. The file must be at the same place on every worker.

    Lengths of the corpus's frequent pre-tokens are broadcast (at most ``FREQUENT``). Each worker
    encodes the others once and remembers at most ``CACHED``. Pre-tokens are never shuffled.
    """
    import sentencepiece

    frequent = frequent_words(docs, text_col, split_words, FREQUENT)
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    table = docs.sparkSession.sparkContext.broadcast(dict(zip(frequent, word_lengths(model, frequent))))
    del model

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        known = dict(table.value)
        for batch in batches:
            sizes, counts = [], []
            for scalar in batch.column(1):
                text = scalar.as_py() or ""
                words = split_words(text)
                try:
                    n = sum(map(known.__getitem__, words))
                except KeyError:
                    if len(known) > FREQUENT + CACHED:
                        known = dict(table.value)
                    missing = list({w for w in words if w not in known})
                    lengths = dict(zip(missing, word_lengths(model, missing)))
                    n = sum(lengths[w] if w in lengths else known[w] for w in words)
                    known.update((w, k) for w, k in lengths.items() if len(w) <= 64)
                sizes.append(len(text.encode()))
                counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    counted = docs.select(id_col, text_col).mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
