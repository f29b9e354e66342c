"""Children of the root of XML files, cut out of byte ranges and flattened."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame

from .ranges import Bytes, Report, aligned

TEXT, COMMENT, DATA, INSTRUCTION = range(4)
_ENDS = {COMMENT: b"-->", DATA: b"]]>", INSTRUCTION: b"?>"}
_STARTS = {b"<!--": COMMENT, b"<![CDATA[": DATA, b"<?": INSTRUCTION}

#: A comment, character data or instruction (or just its start, if it doesn't end here), a
#: document type with at most one bracket, or a tag.
_MARK = re.compile(
    rb"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|(?P<open><!--|<!\[CDATA\[|<\?)"
    rb"|<!DOCTYPE[^\[>]*(?:\[.*?\]\s*)?>"
    rb"|(?P<tag></?[^\s!?/>][^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*>)",
    re.S,
)
_NAME = re.compile(rb"[^\s/>]+")
_ENCODING = re.compile(rb"<\?xml[^>]*?encoding\s*=\s*[\"']([^\"']+)")


def step_of(tag: bytes) -> int:
    """Change of depth at a tag."""
    return -1 if tag.startswith(b"</") else 0 if tag.endswith(b"/>") else 1


def report(data: bytes) -> Report:
    """End state and change of depth of a range that starts at ``<``, for each state at its start."""
    depth, state = 0, TEXT
    for mark in _MARK.finditer(data):
        if mark["open"]:
            state = _STARTS[mark["open"]]
            break
        if mark["tag"]:
            depth += step_of(mark["tag"])
    found = [(state, depth)]
    for inside, end in _ENDS.items():
        place = data.find(end)
        found.append((inside, 0) if place < 0 else _resumed(data, place + len(end), state, depth))
    return found


def _resumed(data: bytes, at: int, state: int, depth: int) -> tuple[int, int]:
    """End state and change of depth from ``at`` on; ``state`` and ``depth`` are those from the start as TEXT.

    The marks from both places are read side by side: from the first common one on all is the same,
    which is mostly soon, and no marks are kept.
    """
    others, before, own = _MARK.finditer(data), 0, 0
    other = next(others, None)
    for mark in _MARK.finditer(data, at):
        while other is not None and other.start() < mark.start():
            if other["tag"]:
                before += step_of(other["tag"])
            other = None if other["open"] else next(others, None)
        if other is not None and other.start() == mark.start():
            return state, own + depth - before
        if mark["open"]:
            return _STARTS[mark["open"]], own
        if mark["tag"]:
            own += step_of(mark["tag"])
    return TEXT, own


def elements(source: Bytes, start: int, stop: int, state: int, depth: int) -> Iterator[bytes]:
    """Children of the root that start in the range, whole, also where they end beyond it."""
    source.extend(stop)
    position = start - source.start
    limit, child = stop - source.start, None

    def more() -> bool:
        return source.extend(source.start + 2 * len(source.data) - position + 1024)

    if state != TEXT:
        while (place := source.data.find(_ENDS[state], position)) < 0:
            if not more():
                raise ValueError("malformed XML: a part doesn't end")
        position = place + len(_ENDS[state])
    while position < limit or child is not None:
        mark = _MARK.search(source.data, position)
        if mark is None or mark["open"]:
            if child is None and mark is None and position < limit and b"<" not in source.data[position:limit]:
                break  # nothing but text is left
            if more():
                continue
            if mark is None and child is None and not source.data[position:].strip():
                break
            raise ValueError("malformed XML: a part doesn't end")
        if child is None and mark.start() >= limit:
            break
        position = mark.end()
        if not mark["tag"]:
            continue
        step = step_of(mark["tag"])
        if child is None and depth == 1 and step >= 0:
            child = mark.start()
        depth += step
        if child is not None and depth == 1:
            yield source.data[child:position]
            child = None
        if depth < 0:
            raise ValueError("malformed XML: more end tags than start tags")
    if stop == source.length and depth != 0:
        raise ValueError("malformed XML: an element doesn't end")


def cells(element: bytes, encoding: str | None) -> dict[str, str | None]:
    """Trimmed text of an element's leaves by path, and of inner elements that begin with text.

    A path names each tag with its place among the siblings of that name: ``book/tag[1]``.
    """
    out: dict[str, str | None] = {}
    path: list[list] = []  # path, counts of child tags, text before the first child

    def start(tag: str, _) -> None:
        if path:
            counts = path[-1][1]
            place, counts[tag] = counts[tag], counts[tag] + 1
            path.append([f"{path[-1][0]}/{tag}[{place}]", Counter(), []])
        else:
            path.append([tag, Counter(), []])

    def text(data: str) -> None:
        if path and not path[-1][1]:
            path[-1][2].append(data)

    def end(_) -> None:
        name, children, parts = path.pop()
        value = "".join(parts).strip()
        if value or not children:
            out[name] = value or None

    parser = expat.ParserCreate(encoding)
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    parser.Parse(element, True)
    return out


def rows(batches: Iterator[pa.RecordBatch], tags: frozenset[str] | None) -> Iterator[dict[str, str | None]]:
    """Cells of the elements in ranges; of the given tags only, if any are given."""
    for batch in batches:
        for part in batch.to_pylist():
            with Bytes(part["path"], 0, part["length"]) as head:
                head.extend(1024)
                declared = _ENCODING.search(head.data)
            encoding = declared[1].decode("ascii") if declared else None
            with Bytes(part["path"], max(0, part["start"] - 1), part["length"]) as source:
                low, high = aligned(source, part["start"], part["stop"], b"<", False)
                if low < high:
                    for element in elements(source, low, high, part["state"], part["depth"]):
                        if tags is None or _NAME.match(element, 1)[0].decode(encoding or "utf-8") in tags:
                            yield cells(element, encoding)


def seen_paths(ranges: DataFrame, tags: frozenset[str] | None) -> list[str]:
    """All paths of cells, in the order of their names and places."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: set[str] = set()
        for row in rows(batches, tags):
            paths.update(row)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(paths), pa.string())], ["path"])

    found = ranges.mapInArrow(collect, "path string").distinct().collect()  # the columns of the table
    return sorted((row.path for row in found), key=lambda p: [int(x) if x.isdigit() else x for x in re.split(r"[\[\]]", p)])


def columns_of(paths: list[str]) -> list[tuple[str, ...]]:
    """Parts of the column name of each path: places only below tags that occur more than once."""
    repeated = {re.sub(r"\[\d+\]", "", p[: m.end()]) for p in paths for m in re.finditer(r"\[(\d+)\]", p) if int(m[1])}
    out = []
    for path in paths:
        parts: list[str] = []
        for k, piece in enumerate(path.split("/")):
            tag, _, place = piece.partition("[")
            parts.append(tag)
            if k and re.sub(r"\[\d+\]", "", "/".join(path.split("/")[: k + 1])) in repeated:
                parts.append(place.rstrip("]"))
        out.append(tuple(parts))
    return out


def read_rows(ranges: DataFrame, paths: list[str], names: list[str], tags: frozenset[str] | None) -> DataFrame:
    """One text column per path."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([row.get(p) for row in held], pa.string()) for p in paths], names)

        for row in rows(batches, tags):
            held.append(row)
            if len(held) == 4096:
                yield batch()
                held.clear()
        yield batch()

    quoted = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    return ranges.mapInArrow(read, quoted)
