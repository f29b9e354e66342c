"""Benchmark decontamination by pieces and edit distance."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERRORS = 0.1  # edits for each character of an item
LEAST_PIECE = 8  # characters of a piece; short items get a smaller budget
BLOCK_BYTES = 4 << 20  # items matched in one pass over the documents


def plain(text: str) -> str:
    """Lower case with runs of white space as one space."""
    return " ".join(text.lower().split())


def pieces(item: str, errors: float = ERRORS) -> tuple[int, list[tuple[int, str]]]:
    """The error budget of an item, and budget + 1 pieces with their places."""
    budget = min(int(len(item) * errors), max(0, len(item) // LEAST_PIECE - 1))
    cuts = [k * len(item) // (budget + 1) for k in range(budget + 2)]
    return budget, [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """Least edit distance of the pattern to any part of the text, and the first end of such a part.

    Bit-parallel over the pattern: one machine step of integers for each character of the text.
    """
    m, ones = len(pattern), (1 << len(pattern)) - 1
    masks: dict[str, int] = {}
    for k, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << k
    up, down, score, top = ones, 0, m, 1 << (m - 1)
    best, end = budget + 1, -1
    for k, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = (down | ~(xh | up)) & ones, up & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1, mh << 1
        up, down = (mh | ~(xv | ph)) & ones, ph & xv & ones
        if score < best:
            best, end = score, k + 1
    return (best, end) if end >= 0 else None


def levels(item: str, budget: int, parts: list[tuple[int, str]]) -> list[list[tuple[int, int, int]]]:
    """For each piece, the parts of the item around it ``(start, end, budget)``, smallest first, without the item.

    Pieces are the leaves of a binary tree, and a node with n leaves may have n - 1 errors. If both
    children of a node had more than they may, the node would have as well; so every match has a
    piece around which all parts match within their budgets.
    """
    around: list[list[tuple[int, int, int]]] = [[] for _ in parts]
    places = [at for at, _ in parts] + [len(item)]
    work = [(0, len(parts))]
    while work:
        a, b = work.pop()
        if b - a < 2:
            continue
        if b - a < len(parts):
            for k in range(a, b):
                around[k].append((places[a], places[b], b - a - 1))
        middle = (a + b + 1) // 2
        work += [(a, middle), (middle, b)]
    return [x[::-1] for x in around]


def compile_items(texts: dict[int, str], errors: float = ERRORS):
    """An automaton of the pieces of plain items, and the items by number with their budgets."""
    import ahocorasick

    items, places = {}, {}
    for key, item in texts.items():
        budget, parts = pieces(item, errors)
        items[key] = item, budget
        for (at, piece), around in zip(parts, levels(item, budget, parts)):
            places.setdefault(piece, []).append((key, at, len(piece), around))
    automaton = ahocorasick.Automaton()
    for piece, hits in places.items():
        automaton.add_word(piece, hits)
    if places:
        automaton.make_automaton()
    return automaton, items


def grows(text: str, item: str, origin: int, at: int, size: int, around: list[tuple[int, int, int]]) -> bool:
    """Whether the parts around a piece found in the text match as well; ``origin`` is where the item would start."""
    for a, b, budget in around:
        if budget == 1:  # one half of the other piece is whole
            c, d = (at + size, b) if a == at else (a, at)
            window, half = text[max(0, origin + c - 1) : max(0, origin + d + 1)], (c + d) // 2
            if item[c:half] not in window and item[half:d] not in window:
                return False
        elif myers(item[a:b], text[max(0, origin + a - budget) : max(0, origin + b + budget)], budget) is None:
            return False
    return True


def matches(text: str, automaton, items: dict[int, tuple[str, int]]) -> dict[int, tuple[int, int]]:
    """Items found in a plain text with their distance and the end of the match."""
    windows: dict[int, list[list[int]]] = {}
    for end, hits in automaton.iter(text):
        for key, at, size, around in hits:
            item, budget = items[key]
            origin = end + 1 - size - at
            start, stop = origin - budget, origin + len(item) + budget
            spans = windows.get(key)
            if spans and spans[-1][0] <= start and stop <= spans[-1][1]:
                continue
            if not grows(text, item, origin, at, size, around):
                continue
            if spans and spans[-1][0] <= start <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], stop)
            else:
                windows.setdefault(key, []).append([start, stop])
    found = {}
    for key, spans in windows.items():
        item, budget = items[key]
        tries = ((myers(item, text[max(0, a) : b], budget), max(0, a)) for a, b in spans)
        good = [(hit[0], base + hit[1]) for hit, base in tries if hit]
        if good:
            found[key] = min(good)
    return found


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, id_col: str = "doc_id",
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``(doc_id, item_id, distance, match_end)``: each benchmark item that a document contains.

    An item is contained when a part of the text is within ``errors`` edits per character of it,
    both in lower case with single spaces. One row per document and item, with the least distance
    and the first end of such a match in the plain text. Rows repeated in either table repeat.
    Null and empty texts and items match nothing; null ids pass through; empty tables give no rows.

    An item is cut into one piece more than it may have errors, so a match holds a whole piece; an
    automaton finds the pieces in one pass, and windows around hits are compared, first of the parts
    around the piece, then of the item. Items are broadcast in blocks of about ``BLOCK_BYTES``; more
    items take more passes, not more memory.
    """
    items = benchmark.where(F.col(item_text_col).isNotNull()).select(
        F.col(item_col).alias("item_id"), F.col(item_text_col).alias("item")
    )
    total = items.agg(F.sum(F.octet_length("item"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    id_kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema["item_id"].dataType
    out = f"doc_id {id_kind}, item_no int, distance int, match_end long"
    number = F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks))
    result = None
    for block in range(blocks):
        rows = items.where(number == block).collect()  # about BLOCK_BYTES
        texts = {k: plain(row.item) for k, row in enumerate(rows)}
        found = _search(docs.select(id_col, text_col), {k: t for k, t in texts.items() if t}, errors, out)
        names = docs.sparkSession.createDataFrame(
            [(k, row.item_id) for k, row in enumerate(rows)],
            f"item_no int, item_id {item_kind.simpleString()}",
        )
        named = found.join(F.broadcast(names), "item_no").select("doc_id", "item_id", "distance", "match_end")
        result = named if result is None else result.unionByName(named)
    return result


def _search(docs: DataFrame, texts: dict[int, str], errors: float, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(texts)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, items = compile_items(shared.value, errors)
        for batch in batches:
            rows: list[tuple] = []
            for k, scalar in enumerate(batch.column(1)):
                if items and scalar.is_valid:
                    hits = matches(plain(scalar.as_py()), automaton, items)
                    rows += [(k, key, d, e) for key, (d, e) in hits.items()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                    pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([r[2] for r in rows], pa.int32()),
                    pa.array([r[3] for r in rows], pa.int64()),
                ],
                ["doc_id", "item_no", "distance", "match_end"],
            )

    return docs.mapInArrow(search, schema)
