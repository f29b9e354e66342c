"""Language identification with string kernels, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAMS = (1, 2, 3, 4)  # the blended spectrum
SPACE = 1 << 15  # hashed n-grams; a text is a set of them
FIT_ROWS = 1600  # labelled rows to learn from, at most, evenly by language
LANDMARKS = 160
LANGUAGES = 256  # learned languages, at most; the most frequent ones
SCORED = 1 << 14  # characters that are scored at once; a text's score is the mean over all its pieces
RIDGE = 1e-3
PIECE = 1 << 18  # characters handled at once; texts are read whole
BATCH = 64


def spectrum(text: str, out: np.ndarray) -> bool:
    """Mark the n-grams of a whole text in ``out``; whether the text has a letter."""
    letter = False
    for start in range(0, len(text), PIECE):
        piece = text[max(0, start - GRAMS[-1] + 1) : start + PIECE].lower()
        letter = letter or any(map(str.isalpha, piece))
        codes = np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        rolled = np.zeros(len(codes), np.uint64)
        for n in range(1, GRAMS[-1] + 1):
            size = len(codes) - n + 1
            if size <= 0:
                break
            rolled = rolled[:size] * np.uint64(1_000_003) + codes[n - 1 :] + np.uint64(n)
            mixed = rolled * np.uint64(0x9E3779B97F4A7C15)
            out[(mixed >> np.uint64(49)).astype(np.int64)] = 1
    return letter


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # packed presence bits, one row per landmark
    weights: np.ndarray  # landmarks + 1 by languages

    def unpacked(self) -> tuple[np.ndarray, np.ndarray]:
        bits = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
        return bits.T.copy(), np.sqrt(np.maximum(bits.sum(1), 1))


def kernel(texts: np.ndarray, marks: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Shared n-grams of texts and landmarks over the root of the product of their counts."""
    sizes = np.sqrt(np.maximum(texts.sum(1), 1))
    return (texts @ marks) / sizes[:, None] / norms[None, :]


def fit(bits: np.ndarray, labels: list[str]) -> Model:
    """One-versus-rest ridge regression on the kernel with landmarks (Nyström features)."""
    languages = sorted(set(labels))
    by_language = [[k for k, x in enumerate(labels) if x == lang] for lang in languages]
    order = [rows[k] for k in range(max(map(len, by_language))) for rows in by_language if k < len(rows)]
    chosen = order[:LANDMARKS]
    model = Model(languages, bits[chosen], np.zeros((len(chosen) + 1, len(languages))))
    marks, norms = model.unpacked()
    between = kernel(np.ascontiguousarray(marks.T), marks, norms).astype(np.float64)
    squares, vectors = np.linalg.eigh(between)
    root = vectors / np.sqrt(np.maximum(squares, 1e-6))
    parts = (bits[k : k + BATCH] for k in range(0, len(bits), BATCH))  # rows take 32 times the room when unpacked
    values = np.concatenate([kernel(np.unpackbits(x, axis=1).astype(np.float32), marks, norms) for x in parts])
    features = np.c_[values.astype(np.float64) @ root, np.ones(len(bits))]
    targets = np.array([[1.0 if x == lang else 0.0 for lang in languages] for x in labels])
    share = 1 / np.array([len(by_language[languages.index(x)]) for x in labels])  # languages weigh the same
    weighted = features * share[:, None]
    ridge = RIDGE * np.eye(features.shape[1])
    solved = np.linalg.solve(features.T @ weighted + ridge, weighted.T @ targets)
    model.weights = np.r_[root @ solved[:-1], solved[-1:]]
    return model


def learn(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> Model:
    """Fit on at most about ``FIT_ROWS`` labelled rows, spread evenly over the languages by a hash."""
    counts = labelled.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(LANGUAGES).collect()
    if not counts:
        return Model([], np.zeros((0, SPACE // 8), np.uint8), np.zeros((1, 0)))
    quota = FIT_ROWS // len(counts)
    share = F.lit(0.0)  # of languages that aren't among the most frequent ones
    for row in counts:
        share = F.when(F.col(lang_col) == row[0], min(1.0, quota / row[1])).otherwise(share)
    ticket = F.xxhash64(F.col(id_col).cast("string"), F.xxhash64(text_col), F.lit(17))
    sample = (
        labelled.where(F.pmod(ticket, F.lit(1 << 30)) < share * (1 << 30))
        .select(ticket.alias("ticket"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    )

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for text in batch.column("text"):
                bits = np.zeros(SPACE, np.uint8)
                spectrum(text.as_py(), bits)
                packed.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("ticket"), batch.column("lang"), pa.array(packed, pa.binary())], ["ticket", "lang", "bits"]
            )

    drawn = sample.mapInArrow(marks, "ticket long, lang string, bits binary")
    rows = drawn.orderBy("ticket", "lang", "bits").limit(2 * FIT_ROWS).collect()
    if not rows:
        return Model([], np.zeros((0, SPACE // 8), np.uint8), np.zeros((1, 0)))
    return fit(np.array([np.frombuffer(r.bits, np.uint8) for r in rows]), [r.lang for r in rows])


def with_language(
    docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``docs`` with the columns ``lang_pred`` and ``score``; see ``language_id``."""
    labelled = docs.where(training & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    learned = learn(labelled, id_col, text_col, lang_col)
    # plain values, which workers can unpack without this package
    shared = docs.sparkSession.sparkContext.broadcast((learned.languages, learned.landmarks, learned.weights))
    place = docs.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        marks, norms = model.unpacked()
        weights = model.weights.astype(np.float32)
        room = np.zeros((BATCH, SPACE), np.float32)
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(place)]
            letters, sizes = [False] * len(texts), {}
            sums = np.zeros((len(texts), max(1, len(model.languages))))
            pieces = ((k, text[at : at + SCORED]) for k, text in enumerate(texts) for at in range(0, len(text), SCORED))
            while held := list(islice(pieces, BATCH)):
                room[:] = 0
                found = [spectrum(piece, room[row]) for row, (_, piece) in enumerate(held)]
                if not model.languages:
                    continue
                values = kernel(room[: len(held)], marks, norms) @ weights[:-1] + weights[-1]
                for (k, piece), known, row in zip(held, found, values):
                    letters[k] |= known
                    if known:  # pieces without a letter say nothing
                        sums[k] += np.float64(len(piece)) * row
                        sizes[k] = sizes.get(k, 0) + len(piece)
            names: list[str] = []
            scores: list[float] = []
            for k, known in enumerate(letters):
                row = sums[k] / max(1, sizes.get(k, 1))
                best = int(row.argmax())
                names.append(model.languages[best] if known else "und")
                scores.append(float(min(1.0, max(0.0, row[best]))) if known else 0.0)
            columns = [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(predict, schema)


def language_id(
    docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``(doc_id, lang_pred, score)``, one row per document.

    Learns from the rows where ``training`` holds and text and language are given. Predictions read
    nothing but the whole text. Null texts and texts without a letter are ``und`` with score 0, as
    is all text if nothing can be learned; null ids pass through; an empty table gives no rows.
    ``score`` is the regression value of the language, kept within 0 and 1; texts of more than ``SCORED``
    characters have the mean over pieces that together are the whole text, weighed by their length, so
    that length alone changes no score. Equal values go to the language that comes first by name. At
    most the ``LANGUAGES`` most frequent languages are learned.

    A text is the set of its n-grams, hashed to ``SPACE`` places; landmarks and weights are
    broadcast and have a fixed size. Batches of texts are scored by two matrix products.
    """
    found = with_language(docs.select(id_col, text_col, lang_col), training, id_col, text_col, lang_col)
    return found.select(F.col(id_col).alias("doc_id"), "lang_pred", "score")
