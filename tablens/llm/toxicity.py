"""Toxicity from the nearest labelled examples, found in a block-max inverted index."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

EXAMPLES = 8192  # labelled documents to learn from, at most
TERMS = 4096  # terms that tell the labels apart, at most
TELLING = 30.0  # chi-square that a term must reach
AFFIXES = range(4, 9)  # characters of the beginnings and ends of words that are terms as well
NEIGHBOURS = 15
BLOCK = 256  # index entries that share an upper bound
CONSTANT = 2.0  # a part that all vectors have, so that their directions tell many marks from few
NEAR = 0.02  # added to distances before votes are weighted by them
PRIOR = 0.5  # votes of the average example
CACHED = 400_000  # words and vectors that a worker remembers

SEPARATORS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def word_counts(text: str) -> Counter[bytes]:
    """Words of a whole text: runs of letters, digits and characters beyond ASCII, in lower case."""
    return Counter(text.lower().encode("utf-8", "replace").translate(SEPARATORS).split())


def word_terms(word: bytes) -> list[str]:
    """Terms of a word: itself, its beginnings and its ends."""
    text = word.decode("utf-8", "replace")
    return [text, *(x for n in AFFIXES if n < len(text) for x in (text[:n] + "-", "-" + text[-n:]))]


class Terms(dict):
    """Words to the numbers of their known terms; forgets all words when there are too many."""

    def __init__(self, known: list[str]):
        self.number = {term: k for k, term in enumerate(known)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > CACHED:
            self.clear()
        found = tuple(self.number[x] for x in word_terms(word) if x in self.number)
        if len(word) <= 64:
            self[word] = found
        return found

    def count(self, text: str) -> tuple[tuple[int, int], ...]:
        """``(term, occurrences in ten thousand words)`` of a text, by term."""
        counts, found = word_counts(text), Counter()
        for word, n in counts.items():
            for term in self[word]:
                found[term] += n
        words = sum(counts.values())
        return tuple(sorted((term, -(-10_000 * n // words)) for term, n in found.items()))


def vector(counts: tuple[tuple[int, int], ...], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and weights of a TF-IDF vector of length one; the constant part is the last term."""
    terms = np.array([*(t for t, _ in counts), len(idf)], np.int64)
    weights = np.array([*(math.log1p(n / 100) * idf[t] for t, n in counts), CONSTANT])
    return terms, weights / math.sqrt((weights**2).sum())


def build_index(examples: list[tuple[tuple, int, int]], idf: np.ndarray) -> dict:
    """Plain arrays of a block-max inverted index over ``(counts, label, id)``.

    Examples with equal vectors are one entry with its numbers of examples and toxic ones. Entries
    are sorted by their terms, most telling first, so that a block holds similar ones.
    """
    merged: dict[tuple, list[int]] = {}
    for counts, label, number in examples:
        entry = merged.setdefault(counts, [0, 0, number])
        entry[0], entry[1], entry[2] = entry[0] + 1, entry[1] + label, min(entry[2], number)
    keys = sorted(merged)
    postings: list[list[tuple[int, float]]] = [[] for _ in range(len(idf) + 1)]
    for at, counts in enumerate(keys):
        for term, weight in zip(*vector(counts, idf)):
            postings[term].append((at, weight))
    blocks = -(-len(keys) // BLOCK)
    starts, highest = np.zeros((len(postings), blocks + 1), np.int64), np.zeros((len(postings), blocks))
    entries, weights = np.array([p[0] for x in postings for p in x], np.int64), np.array([p[1] for x in postings for p in x])
    begin = 0
    for term, rows in enumerate(postings):
        own = slice(begin, begin + len(rows))
        starts[term] = begin + np.searchsorted(entries[own], np.arange(blocks + 1) * BLOCK)
        np.maximum.at(highest[term], entries[own] // BLOCK, weights[own])
        begin += len(rows)
    size = np.array([merged[k] for k in keys], np.int64).reshape(-1, 3)
    return {"starts": starts, "highest": highest, "entries": entries, "weights": weights, "keys": keys,
            "members": size[:, 0], "toxic": size[:, 1], "first": size[:, 2], "idf": idf}


def nearest(index: dict, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries and cosines, the nearest first, until ``NEIGHBOURS`` examples and one more are covered.

    The block with the highest bounds is summed first; its entries set a bar. Then the blocks
    whose bound reaches the bar are summed; what other blocks hold is farther away for certain.
    """
    starts, entries, values, members = index["starts"], index["entries"], index["weights"], index["members"]
    bounds = weights @ index["highest"][terms]
    sums = np.full(len(members), -1.0)

    def add(block: int) -> None:
        low, high = block * BLOCK, min(len(members), (block + 1) * BLOCK)
        sums[low:high] = 0
        for term, weight in zip(terms, weights):
            start, stop = starts[term, block], starts[term, block + 1]
            if stop > start:
                sums[entries[start:stop]] += weight * values[start:stop]

    def ranked() -> tuple[np.ndarray, np.ndarray, int]:
        seen = np.flatnonzero(sums >= 0)
        order = seen[np.lexsort((seen, -sums[seen]))]
        covered = members[order].cumsum()
        return order, covered, int(np.searchsorted(covered, NEIGHBOURS + 1))

    by_bound = np.argsort(-bounds, kind="stable")
    add(by_bound[0])
    order, covered, last = ranked()
    bar = sums[order[last]] if last < len(order) else -1.0
    for block in by_bound[1:]:
        if bounds[block] < bar - 1e-9:  # sums may differ from bounds by rounding
            break
        add(block)
    order, covered, last = ranked()
    return order[: last + 1], sums[order[: last + 1]]


def share(index: dict, found: np.ndarray, cosines: np.ndarray, own: tuple | None = None) -> float:
    """Share of the votes for toxic among the ``NEIGHBOURS`` nearest examples, nearer ones weighing more.

    Examples of an entry share what it may cast. ``own`` leaves one example, with its label, out.
    """
    base = index["toxic"].sum() / index["members"].sum()
    left, votes, total = NEIGHBOURS, PRIOR * base, PRIOR
    for at, cosine in zip(found, cosines):
        size, toxic = int(index["members"][at]), int(index["toxic"][at])
        if own is not None and index["keys"][at] == own[0]:
            size, toxic = size - 1, toxic - own[1]
        cast = min(left, size)
        if cast:
            weight = cast / (NEAR + max(0.0, 1 - cosine))
            votes, total, left = votes + weight * toxic / size, total + weight, left - cast
    return votes / total


def calibrate(shares: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve from the logit of a share to the rate of the label."""
    x = np.c_[np.log(shares / (1 - shares)), np.ones(len(shares))]
    fit = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ fit, -30, 30)))
        pull = 1e-2 * (fit - [1.0, 0.0])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (p - labels) + pull)
        fit = fit - np.clip(step, -1, 1)
    return max(0.05, float(fit[0])), float(fit[1])


def labelled_texts(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``(number, label, text)`` of at most ``EXAMPLES`` labelled documents, chosen by a hash of the id.

    An id with several labels is toxic if any says so; of several texts of an id the least counts.
    """
    known = labels.where(may_learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    chosen = (
        known.groupBy(F.col(id_col).cast("long").alias("number"))
        .agg((F.max(label_col) > 0).cast("int").alias("label"))
        .orderBy(F.xxhash64("number", F.lit(13)), "number")
        .limit(EXAMPLES)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("number"), F.coalesce(text_col, F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "number").groupBy("number", "label").agg(F.min("text").alias("text"))


def telling_terms(examples: DataFrame) -> list[tuple[str, int, int]]:
    """``(term, toxic examples with it, all with it)`` of terms that tell the labels apart, the best first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text")):
                counts[label].update({term for word in word_counts(text.as_py()) for term in word_terms(word)})
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([counts[1][x] for x in names], pa.int64()),
             pa.array([counts[0][x] for x in names], pa.int64())],
            ["term", "toxic", "clean"],
        )

    total = examples.agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).first()
    p, n = total.toxic or 0, total.n
    if p == 0 or p == n:
        return []
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    c, d = p - a, n - p - b
    rest = (a + b) * (c + d) * (a + c) * (b + d)
    chi = F.when(rest > 0, n * (a * d - b * c) ** 2 / rest).otherwise(0.0)
    sums = examples.mapInArrow(count, "term string, toxic long, clean long").groupBy("term")
    sums = sums.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).withColumn("chi", chi)
    best = sums.where(F.col("chi") >= TELLING).orderBy(F.desc("chi"), "term").limit(TERMS).collect()
    return [(row.term, row.toxic, row.toxic + row.clean) for row in best]


def toxicity(
    docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """``(doc_id, score, predicted, nearest_id, nearest_cosine, evidence)``, one row per document.

    ``score`` (0 to 1) is the calibrated, distance-weighted vote of the nearest labelled documents;
    ``predicted`` is 1 from 0.5 on. ``evidence`` lists up to ``NEIGHBOURS`` index entries that voted:
    the least id of an entry, its examples, how many of them are toxic, and the cosine. Labels are
    learned from the rows of ``labels`` where ``may_learn`` holds, from at most ``EXAMPLES`` ids.

    Vectors are TF-IDF weights (occurrences per word, so length alone changes nothing) of words and
    of their beginnings and ends, as far as these tell the labels apart by a chi-square test, with a
    constant part. Whole texts are read. Null and empty texts have the constant part only. Null ids
    pass through; rows that repeat an id are scored each by itself; an empty table gives no rows.
    Rows of ``labels`` without id or label teach nothing. If all examples have one label, all texts
    get that label; without any example the score is 0. Other columns are not read. Examples at the
    same distance share the votes that are left, so that no order of rows decides.
    """
    spark = docs.sparkSession
    examples = written(labelled_texts(docs, labels, may_learn, id_col, text_col, label_col))
    chosen = telling_terms(examples)
    names = [term for term, _, _ in chosen]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(names)
        for batch in batches:
            counts = [terms.count(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("number"), batch.column("label"),
                 pa.array([[t for t, _ in x] for x in counts], pa.list_(pa.int32())),
                 pa.array([[n for _, n in x] for x in counts], pa.list_(pa.int32()))],
                ["number", "label", "terms", "n"],
            )

    rows = examples.mapInArrow(read, "number long, label int, terms array<int>, n array<int>").orderBy("number").collect()
    learned = [(tuple(zip(r.terms, r.n)), r.label, r.number) for r in rows]
    idf = np.log((1 + len(rows)) / (1 + np.array([n for _, _, n in chosen], np.float64)))
    shared = spark.sparkContext.broadcast((names, build_index(learned, idf)))
    if not rows:
        curve = (0.0, 0.0)
    else:

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, index = shared.value
            terms = Terms(names)
            for batch in batches:
                found = []
                for label, text in zip(batch.column("label").to_pylist(), batch.column("text")):
                    counts = terms.count(text.as_py())
                    found.append(share(index, *nearest(index, *vector(counts, index["idf"])), (counts, label)))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column("label")], ["share", "label"])

        checked = np.array(examples.mapInArrow(check, "share double, label int").orderBy("share", "label").collect(), np.float64)
        curve = calibrate(np.clip(checked[:, 0], 1e-6, 1 - 1e-6), checked[:, 1])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, index = shared.value
        terms = Terms(names)
        known: dict[tuple, tuple] = {}

        def verdict(counts: tuple) -> tuple:
            if not len(index["keys"]):
                return 0.0, 0, None, None, []
            found, cosines = nearest(index, *vector(counts, index["idf"]))
            x = min(1 - 1e-6, max(1e-6, share(index, found, cosines)))
            score = 1 / (1 + math.exp(-(curve[0] * math.log(x / (1 - x)) + curve[1])))
            told = [
                {"id": int(index["first"][k]), "examples": int(index["members"][k]), "toxic": int(index["toxic"][k]), "cosine": float(c)}
                for k, c in zip(found, cosines)
            ]
            return score, int(score >= 0.5), told[0]["id"], told[0]["cosine"], told[:NEIGHBOURS]

        for batch in batches:
            out = []
            for text in batch.column(1):
                counts = terms.count(text.as_py() or "")
                if counts not in known:
                    if len(known) > CACHED // 40:
                        known.clear()
                    known[counts] = verdict(counts)
                out.append(known[counts])
            kinds = (pa.float64(), pa.int32(), pa.int64(), pa.float64(), evidence)
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns], ["doc_id", "score", "predicted", "nearest_id", "nearest_cosine", "evidence"]
            )

    evidence = pa.list_(pa.struct([("id", pa.int64()), ("examples", pa.int64()), ("toxic", pa.int64()), ("cosine", pa.float64())]))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, score double, predicted int, nearest_id long, nearest_cosine double, "
    schema += "evidence array<struct<id:long,examples:long,toxic:long,cosine:double>>"
    return docs.select(id_col, text_col).mapInArrow(judge, schema)
