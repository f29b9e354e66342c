"""Ranked lexical search with bit-sliced Bloom signatures and exact scores."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bitmap_of, in_bitmap, written

TOP = 10
BLOCK_BYTES = 4 << 20  # text of the items that are searched for together
BLOCK_DOCS = 1024  # documents in a block of signatures, at most
BLOCK_CELLS = 1 << 26  # bits of a block before they are packed, about
WAITING = 2_000_000  # distinct terms that a task gathers before it cuts blocks
ROWS_PER_ENTRY = 10  # bitmap rows for each entry of a block's largest document
MOST_ROWS = 1 << 22  # of a block; beyond it bounds get looser and results stay the same
PROBES = 4  # rows that an entry sets
GROUP_CELLS = 1 << 22  # items times terms that are bounded at once
TERMS_AT_ONCE = 2048
CACHED = 1_000_000  # term hashes that a worker remembers
BROADCAST_ROWS = 200_000  # documents to score that are broadcast; more are joined by shuffle
BITMAP_WORDS = 1 << 18

#: Occurrences at which a term gets one more entry: 1, 2, 3, 4, 6, 8, 12, 16 and so on.
LEVELS = np.array(sorted({1, *(k << n for k in (2, 3) for n in range(32))}), np.int64)

# ASCII letters and digits and everything beyond ASCII are parts of terms; only A-Z are lowered
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)
)


def term_counts(text: str | None) -> Counter[bytes]:
    """Occurrences of the terms of a whole text."""
    return Counter((text or "").encode("utf-8", "replace").translate(TERM_BYTES).split())


class Hashes(dict):
    """Terms to 64-bit hashes; forgets all when there are too many."""

    def __missing__(self, term: bytes) -> int:
        if len(self) > CACHED:
            self.clear()
        self[term] = found = xxhash.xxh3_64_intdigest(term)
        return found


def probes(hashes: np.ndarray, level: int, rows: int) -> list[np.ndarray]:
    """The bitmap rows of terms at a level."""
    mixed = hashes + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    first, step = mixed >> np.uint64(32), (mixed & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return [((first + np.uint64(k) * step) % np.uint64(rows)).astype(np.int64) for k in range(PROBES)]


def sliced(parts: list[tuple[np.ndarray, np.ndarray]], rows: int) -> bytes:
    """Bitmap rows over documents: a document's bit is set in the rows of all its entries."""
    hashes, tfs = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    place = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    bits = np.zeros((rows, len(parts)), bool)
    for level, least in enumerate(LEVELS):
        kept = tfs >= least
        if not kept.any():
            break
        hashes, tfs, place = hashes[kept], tfs[kept], place[kept]
        for row in probes(hashes, level, rows):
            bits[row, place] = True
    return np.packbits(bits, axis=1).tobytes()


def signature_blocks(waiting: list[tuple]) -> Iterator[tuple[list, list[int], int, bytes]]:
    """``(ids, sizes, rows, slices)`` of blocks of documents with about as many entries each."""
    entries = [int(np.searchsorted(LEVELS, tfs, side="right").sum()) for _, _, _, tfs in waiting]
    order = sorted(range(len(waiting)), key=lambda k: entries[k], reverse=True)
    at = 0
    while at < len(order):
        rows = min(MOST_ROWS, max(64, ROWS_PER_ENTRY * entries[order[at]]))
        block = [waiting[k] for k in order[at : at + max(8, min(BLOCK_DOCS, BLOCK_CELLS // rows))]]
        alike = sum(2 * entries[k] >= entries[order[at]] for k in order[at : at + len(block)])
        block = block[: max(8, alike)]  # smaller documents would have rows that they don't need
        yield [d[0] for d in block], [d[1] for d in block], rows, sliced([d[2:] for d in block], rows)
        at += len(block)


def read_corpus(docs: DataFrame, watched: set[bytes], with_index: bool) -> DataFrame:
    """Blocks of signatures, and rows with counts of documents, terms and watched terms.

    Columns ``ids, sizes, rows, slices`` (null in the rows with counts) and ``n_docs, n_terms,
    terms, counts``, one such row per task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(watched)
    kind = docs.schema[0].dataType.simpleString()
    schema = f"ids array<{kind}>, sizes array<long>, rows int, slices binary, n_docs long, n_terms long, "
    schema += "terms array<binary>, counts array<long>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        watched, hash_of = shared.value, Hashes()
        n_docs = n_terms = held = 0
        frequencies: Counter[bytes] = Counter()
        waiting: list[tuple] = []
        ids = None

        def row(block: tuple | None, counts: tuple | None) -> pa.RecordBatch:
            values = [*(block or [None] * 4), *(counts or [None] * 4)]
            types = [pa.list_(ids), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.int64(), pa.int64(),
                     pa.list_(pa.binary()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, types)],
                ["ids", "sizes", "rows", "slices", "n_docs", "n_terms", "terms", "counts"],
            )

        for batch in batches:
            ids = batch.column(0).type
            for key, scalar in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = term_counts(scalar.as_py())
                if not counts:
                    continue
                size = sum(counts.values())
                n_docs, n_terms = n_docs + 1, n_terms + size
                frequencies.update(counts.keys() & watched)
                if with_index:
                    hashes = np.fromiter(map(hash_of.__getitem__, counts), np.uint64, len(counts))
                    waiting.append((key, size, hashes, np.fromiter(counts.values(), np.int64, len(counts))))
                    held += len(counts)
                    if held > WAITING:
                        yield from (row(block, None) for block in signature_blocks(waiting))
                        waiting, held = [], 0
        if ids is not None:
            yield from (row(block, None) for block in signature_blocks(waiting))
            yield row(None, (n_docs, n_terms, list(frequencies), list(frequencies.values())))

    return docs.mapInArrow(read, schema)


def length_factor(size: int, n_docs: int, n_terms: int) -> int:
    return 100 - 75 + (75 * size * n_docs) // n_terms


def group_items(items: list[dict[bytes, int]]) -> list[list[int]]:
    """Items in groups whose number times their terms stays bounded (a group has one item at least)."""
    groups: list[list[int]] = []
    terms: set[bytes] = set()
    for number, item in enumerate(items):
        joint = terms | item.keys()
        if not groups or (len(groups[-1]) + 1) * len(joint) > GROUP_CELLS:
            groups.append([])
            joint = set(item)
        groups[-1].append(number)
        terms = joint
    return groups


class Bounds:
    """Upper bounds of the scores of items over blocks of signatures."""

    def __init__(self, items: list[dict[bytes, int]], weights: dict[bytes, int], n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.groups = []
        for numbers in group_items(items):
            terms = sorted({t for k in numbers for t in items[k] if weights.get(t)})
            at = {t: k for k, t in enumerate(terms)}
            cells = [(row, at[t], n) for row, k in enumerate(numbers) for t, n in items[k].items() if t in at]
            self.groups.append((
                np.array(numbers), np.array([xxhash.xxh3_64_intdigest(t) for t in terms], np.uint64),
                np.array([weights[t] for t in terms], np.float64), np.array(cells, np.int64).reshape(-1, 3),
            ))

    def levels(self, hashes: np.ndarray, bits: np.ndarray, docs: int) -> np.ndarray:
        """How many levels each term may have reached in each document, never too few."""
        reached = np.zeros((len(hashes), docs), np.uint8)
        active, before = np.arange(len(hashes)), None
        for level in range(len(LEVELS)):
            first, *others = probes(hashes[active], level, len(bits))
            hit = bits[first]
            for row in others:
                hit &= bits[row]
            if before is not None:
                hit &= before
            alive = hit.any(axis=1)
            if not alive.any():
                break
            active, before = active[alive], hit[alive]
            reached[active] += np.unpackbits(before, axis=1, count=docs)
        return reached

    def of_block(self, sizes: list[int], rows: int, slices: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(item numbers, bounds)`` by group: bounds have a row per item and a column per document.

        A term adds its weight times the share it has at the most occurrences its level allows.
        """
        docs = len(sizes)
        bits = np.frombuffer(slices, np.uint8).reshape(rows, -1)
        factors = np.array([length_factor(n, self.n_docs, self.n_terms) for n in sizes], np.int64)
        most = np.minimum(np.append(LEVELS, 1 << 33)[: len(LEVELS)][:, None] - 1, np.array(sizes)[None, :])
        shares = (1_000_000_000 * most) // (1000 * most + 8 * factors[None, :])
        places = np.arange(docs)
        for numbers, hashes, weights, cells in self.groups:
            bounds = np.zeros((len(numbers), docs))
            for start in range(0, len(hashes), TERMS_AT_ONCE):
                part = slice(start, start + TERMS_AT_ONCE)
                reached = self.levels(hashes[part], bits, docs)
                own = cells[(cells[:, 1] >= start) & (cells[:, 1] < start + TERMS_AT_ONCE)]
                counts = np.zeros((len(numbers), len(reached)))
                counts[own[:, 0], own[:, 1] - start] = own[:, 2]
                bounds += counts @ (shares[reached, places] * weights[part][:, None])
            yield numbers, bounds

    def slack(self, items: list[dict[bytes, int]], weights: dict[bytes, int]) -> np.ndarray:
        """What rounding can take from a bound: nothing while all sums are whole numbers below 2^53."""
        largest = np.array([1e6 * sum(n * weights.get(t, 0) for t, n in item.items()) for item in items])
        return np.where(largest < 2.0**53, 0.0, 1e-12 * largest)


def best_bounds(index: DataFrame, shared, kind: str) -> DataFrame:
    """``(item_no, doc_id, bound)``: of each task and item, the ``TOP`` documents with the highest bounds."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n_docs, n_terms = shared.value
        bounds = Bounds(items, weights, n_docs, n_terms)
        best: list[list[tuple]] = [[] for _ in items]
        bars = np.zeros(len(items))
        ids = None
        for batch in batches:
            ids = batch.column("ids").type.value_type
            for block in batch.to_pylist():
                for numbers, found in bounds.of_block(block["sizes"], block["rows"], block["slices"]):
                    for row in np.flatnonzero(found.max(axis=1) > bars[numbers]):
                        item, own = numbers[row], found[row]
                        top = np.argsort(-own, kind="stable")[:TOP]
                        best[item] += [(float(own[k]), block["ids"][k]) for k in top if own[k] > bars[item]]
                        best[item].sort(key=lambda x: -x[0])
                        del best[item][TOP:]
                        if len(best[item]) == TOP:
                            bars[item] = best[item][-1][0]
        if ids is not None:
            rows = [(k, key, bound) for k, found in enumerate(best) for bound, key in found]
            kinds = (pa.int32(), ids, pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["item_no", "doc_id", "bound"]
            )

    return index.select("ids", "sizes", "rows", "slices").mapInArrow(search, f"item_no int, doc_id {kind}, bound double")


def not_excluded(index: DataFrame, shared, bars: list[tuple], kind: str) -> DataFrame:
    """``(doc_id, items)``: documents whose bound does not fall short of the bar ``(score, id)`` of an item."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n_docs, n_terms = shared.value
        bounds = Bounds(items, weights, n_docs, n_terms)
        slack = bounds.slack(items, weights)
        least = np.array([score for score, _ in bars], np.float64) - slack
        for batch in batches:
            found_ids: list = []
            found_items: list[list[int]] = []
            for block in batch.to_pylist():
                hits: dict[int, list[int]] = {}
                for numbers, found in bounds.of_block(block["sizes"], block["rows"], block["slices"]):
                    rows, places = np.nonzero(found >= least[numbers][:, None])
                    for row, place in zip(rows.tolist(), places.tolist()):
                        item, key = int(numbers[row]), block["ids"][place]
                        # an equal score comes after the bar's document if its id does
                        late = bars[item][1] is not None and not slack[item] and (key is None or key > bars[item][1])
                        if found[row, place] > bars[item][0] or not late:
                            hits.setdefault(place, []).append(item)
                found_ids += [block["ids"][k] for k in hits]
                found_items += hits.values()
            yield pa.RecordBatch.from_arrays(
                [pa.array(found_ids, batch.column("ids").type.value_type), pa.array(found_items, pa.list_(pa.int32()))],
                ["doc_id", "items"],
            )

    return index.select("ids", "sizes", "rows", "slices").mapInArrow(search, f"doc_id {kind}, items array<int>")


def exact_scores(docs: DataFrame, wanted: DataFrame, shared, kind: str) -> DataFrame:
    """``(item_no, doc_id, score)`` from the whole texts of the wanted ``(doc_id, items)``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n_docs, n_terms = shared.value
        for batch in batches:
            rows: list[tuple] = []
            for key, scalar, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                counts = term_counts(scalar.as_py())
                extra = 8 * length_factor(sum(counts.values()), n_docs, n_terms)
                parts = {t: weights[t] * ((1_000_000_000 * n) // (1000 * n + extra)) for t, n in counts.items() if t in weights}
                for item in asked:
                    total = sum(n * parts[t] for t, n in items[item].items() if t in parts)
                    if total:
                        rows.append((item, key, total))
            kinds = (pa.int32(), batch.column(0).type, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["item_no", "doc_id", "score"]
            )

    asked = wanted.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    asked = written(asked.withColumnRenamed("doc_id", "wanted_id"))
    key, text = docs.columns
    texts = docs.withColumn("__hash", F.xxhash64(key))
    if asked.count() <= BROADCAST_ROWS:
        side = F.broadcast(asked)
    else:  # texts that are surely not wanted stay where they are
        bitmap = bitmap_of(asked.select(F.xxhash64("wanted_id").alias("h")), "h", BITMAP_WORDS)
        texts, side = in_bitmap(texts, "__hash", bitmap, BITMAP_WORDS), asked
    joined = texts.join(side, F.col(key).eqNullSafe(F.col("wanted_id"))).select(key, text, "items")
    return joined.mapInArrow(score, f"item_no int, doc_id {kind}, score long")


def ranked_search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``TOP`` documents with the highest scores above 0 of each item.

    A term is a run of ASCII letters, digits and characters beyond ASCII; only A-Z are lowered. With
    N documents that have terms, L terms in them, n terms in a document, and df documents with a
    term, the term weighs ``floor(1000 ln((2N+2)/(2df+1)))``, a document has ``m = 25 + 75 n N div L``,
    and each of an item's terms, repeats included, adds ``weight * (10^9 tf div (1000 tf + 8 m))``.
    Equal scores go by ascending id, null last.

    Null and empty texts have no terms: such documents are in no result and in no count, such items
    get no rows. Rows that repeat an id are documents of their own. Rows of ``items`` that repeat id
    and text are answered once; one id with different texts is answered for each. Empty tables
    give no rows. Other columns are not read.

    All texts are read once into blocks of bit-sliced Bloom signatures: bitmap rows over documents,
    with entries for terms and for levels of occurrences, so that a block tells how often a term may
    occur in each of its documents, never too seldom. Sums of weighted slices bound the scores. The
    documents with the highest bounds are scored first and set a bar for each item; then all
    documents whose bound reaches it are scored exactly. Items are searched for in blocks of
    about ``BLOCK_BYTES`` of text; more items take more passes over the signatures.
    """
    spark = docs.sparkSession
    docs = docs.select(id_col, text_col)
    kind = docs.schema[0].dataType.simpleString()
    asked = items.where(F.col(item_text_col).isNotNull())
    asked = asked.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("item")).distinct()
    item_kind = asked.schema["item_id"].dataType
    total = asked.agg(F.sum(F.octet_length("item"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    number = F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks))
    index = result = None
    for block in range(blocks):
        rows = asked.where(number == block).orderBy("item_id", "item").collect()  # about BLOCK_BYTES
        wanted = [dict(term_counts(row.item)) for row in rows]
        corpus = written(read_corpus(docs, {t for item in wanted for t in item}, index is None))
        if index is None:
            index = corpus.where("slices is not null")
        counts = corpus.where("slices is null")
        sizes = counts.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
        n_docs, n_terms = sizes.docs or 0, sizes.terms or 0
        found = counts.select(F.explode(F.map_from_arrays("terms", "counts")).alias("term", "n")).groupBy("term").agg(F.sum("n"))
        weights = {bytes(t): math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in found.collect()}
        shared = spark.sparkContext.broadcast((wanted, weights, n_docs, n_terms))
        first = best_bounds(index, shared, kind)
        place = Window.partitionBy("item_no").orderBy(F.desc("bound"), F.asc_nulls_last("doc_id"))
        seeds = first.withColumn("place", F.row_number().over(place)).where(F.col("place") <= TOP)
        seeds = seeds.select("doc_id", F.array("item_no").alias("items"))
        place = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = exact_scores(docs, seeds, shared, kind).withColumn("rank", F.row_number().over(place))
        bars: list[tuple] = [(1, None)] * len(rows)  # a result has a score above 0
        for row in ranked.where(F.col("rank") == TOP).collect():
            bars[row.item_no] = (row.score, row.doc_id)
        scored = exact_scores(docs, not_excluded(index, shared, bars, kind), shared, kind)
        top = scored.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= TOP)
        names = spark.createDataFrame(
            [(k, row.item_id) for k, row in enumerate(rows)],
            T.StructType([T.StructField("item_no", T.IntegerType()), T.StructField("item_id", item_kind)]),
        )
        named = top.join(F.broadcast(names), "item_no").select("item_id", "rank", "doc_id", "score")
        result = named if result is None else result.unionByName(named)
    return result
