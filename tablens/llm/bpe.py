"""Byte-level BPE with a minimal acyclic transducer for frequent words."""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import mmap
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .words import frequent_words

FREQUENT = 32768  # words in the transducer
CACHED = 200_000  # words that a worker remembers
SPECIAL = "\0"  # added to special strings among words
AT_ONCE = 1 << 20  # characters of texts that are split before their words are looked up, and given back at once

# fixed value: how byte-level vocabularies split a text
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same split with Python's own, faster expressions, for texts of characters that both read alike.
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
ALIKE = 0x3000  # characters from here on are left to the exact pattern


def odd_characters() -> re.Pattern:
    """Finds a character that the two patterns may read in different ways."""
    kinds = [(r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}"), (r"\s", r"\s")]
    every = "".join(map(chr, range(ALIKE)))
    odd = {c for own, exact in kinds for c in {*re.findall(own, every)} ^ {*regex.findall(exact, every)}}
    return re.compile(f"[{''.join(map(re.escape, sorted(odd)))}{chr(ALIKE)}-{chr(0x10FFFF)}]")


def splitter():
    """Splits a text as ``PATTERN`` does."""
    plain, exact, odd = re.compile(PLAIN).findall, regex.compile(PATTERN).findall, odd_characters().search
    return lambda text: exact(text) if odd(text) else plain(text)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file, and its byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Merges:
    """Vocabulary and merge rules of a tokenizer file."""

    WIDTH = 1 << 31
    NONE = 1 << 40  # rank of pairs that no rule joins

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        ids = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = {i: piece for piece, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.single = [ids[bytes([b])] for b in range(256)]
        self.rules = {}
        for rank, rule in enumerate(spec["model"]["merges"]):
            left, right = rule.split(" ") if isinstance(rule, str) else rule
            a, b = (bytes(letters[c] for c in x) for x in (left, right))
            self.rules.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        # the same as arrays: pairs in order with their ranks, and what each rank makes
        ordered = sorted((a * self.WIDTH + b, rank, made) for (a, b), (rank, made) in self.rules.items())
        ordered = ordered or [(-1, self.NONE, 0)]
        self.pairs, self.pair_ranks = (np.array([x[k] for x in ordered], np.int64) for k in (0, 1))
        self.merged = np.zeros(len(spec["model"]["merges"]) + 1, np.int64)
        for _, rank, made in ordered:
            self.merged[min(rank, len(self.merged) - 1)] = made
        self.bytes_ids = np.array(self.single, np.int64)

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word: the pair of the lowest rank joins first, the leftmost of equal ones."""
        ids = [self.single[b] for b in word]
        if len(ids) > 48:
            return self._merge_long(ids)
        get = self.rules.get
        while len(ids) > 1:
            best, at = None, 0
            for k, pair in enumerate(zip(ids, ids[1:])):
                rule = get(pair)
                if rule is not None and (best is None or rule[0] < best[0]):
                    best, at = rule, k
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """Ids of many words: those of one length are merged side by side, a pair of each at a time."""
        found: list[list[int]] = [[]] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            by_length.setdefault(len(word), []).append(k)
        for length, places in by_length.items():
            if length > 48 or len(places) < 8:
                for k in places:
                    found[k] = self.merge(words[k])
                continue
            raw = np.frombuffer(b"".join(words[k] for k in places), np.uint8).reshape(-1, length)
            ids, at = self.bytes_ids[raw], np.array(places)
            ranks = self.ranks(ids[:, :-1], ids[:, 1:])
            while len(at):
                best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(at), np.int64)
                rows = np.arange(len(at))
                rank = ranks[rows, best] if ranks.shape[1] else np.full(len(at), self.NONE)
                done = rank == self.NONE
                for k, row in zip(at[done].tolist(), ids[done].tolist()):
                    found[k] = row
                ids, ranks, at, best, rank = (x[~done] for x in (ids, ranks, at, best, rank))
                rows = np.arange(len(at))
                ids[rows, best] = self.merged[rank]
                kept = np.ones(ids.shape, bool)
                kept[rows, best + 1] = False
                ids = ids[kept].reshape(len(at), ids.shape[1] - 1)
                kept = np.ones(ranks.shape, bool)
                kept[rows, best] = False
                ranks = ranks[kept].reshape(len(at), max(0, ranks.shape[1] - 1))
                for side in (best - 1, best):  # the pairs that the new piece is in
                    own = np.flatnonzero((side >= 0) & (side < ranks.shape[1]))
                    ranks[own, side[own]] = self.ranks(ids[own, side[own]], ids[own, side[own] + 1])
        return found

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``NONE`` where no rule joins them."""
        keys = left * self.WIDTH + right
        place = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[place] == keys, self.pair_ranks[place], self.NONE)

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs and linked places, for words of any length."""
        n, get = len(ids), self.rules.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r[0], k, a, b) for k, (a, b) in enumerate(zip(ids, ids[1:])) if (r := get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = get((a, b))[1], -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for p, q in ((before[k], k), (k, after[k])):
                if p >= 0 and q >= 0 and (r := get((ids[p], ids[q]))):
                    heapq.heappush(heap, (r[0], p, ids[p], ids[q]))
        return [i for i in ids if i >= 0]


class Transducer:
    """Words to ids: a minimal acyclic automaton whose states share suffixes.

    Each edge carries how many words come before those through it; their sum along a word is the
    word's number, which finds its ids. All parts are arrays in one file that is memory-mapped.
    """

    FACTOR = 0x9E3779B1

    @classmethod
    def build(cls, words: list[bytes], ids: list[list[int]]) -> bytes:
        """The file of the transducer; ``words`` sorted and distinct."""
        register: dict[tuple, int] = {}
        edges: dict[int, list[tuple[int, int]]] = {}
        counts: dict[int, int] = {}
        finals: set[int] = set()
        path: list[list] = [[False, []]]  # states of the last word: final, edges (byte, state)

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, out = path.pop()
                key = (final, tuple(out))
                if key not in register:
                    register[key] = state = len(register) + 1
                    edges[state] = out
                    counts[state] = final + sum(counts[t] for _, t in out)
                    if final:
                        finals.add(state)
                byte, _ = path[-1][1][-1]
                path[-1][1][-1] = (byte, register[key])

        last = b""
        for word in words:
            common = 0
            while common < min(len(last), len(word)) and last[common] == word[common]:
                common += 1
            close(common)
            for byte in word[common:]:
                path[-1][1].append((byte, -1))
                path.append([False, []])
            path[-1][0] = True
            last = word
        close(0)
        edges[0] = path[0][1]
        size = 1 << max(4, (2 * sum(map(len, edges.values()))).bit_length())
        keys, to, skip = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int32)
        for state, out in edges.items():
            seen = int(state in finals)
            for byte, target in out:
                slot = (((state << 8 | byte) * cls.FACTOR) >> 7) & (size - 1)
                while keys[slot] >= 0:
                    slot = (slot + 1) & (size - 1)
                keys[slot], to[slot], skip[slot] = state << 8 | byte, target, seen
                seen += counts[target]
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        flat = np.array([i for x in ids for i in x], np.int32)
        final = np.zeros(len(edges), np.int8)
        final[[s for s in finals]] = 1
        head = np.array([size, len(ends), len(flat), len(final)], np.int64)
        return b"".join(x.tobytes() for x in (head, keys, to, skip, ends, flat, final))

    def __init__(self, file: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(file)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view, at = memoryview(self.map), 32
        size, ends, flat, final = view[:32].cast("q")

        def part(kind: str, n: int) -> memoryview:
            nonlocal at
            width = {"q": 8, "i": 4, "b": 1}[kind] * n
            at += width
            return view[at - width : at].cast(kind)

        self.mask = size - 1
        self.keys, self.to, self.skip = part("q", size), part("i", size), part("i", size)
        self.ends, self.flat, self.final = part("i", ends), part("i", flat), part("b", final)

    def find_all(self, words: list[bytes]) -> list[list[int] | None]:
        """``find`` of many words: those of one length go through the automaton side by side."""
        found: list[list[int] | None] = [None] * len(words)
        keys, to, skip = (np.frombuffer(x, kind) for x, kind in ((self.keys, np.int64), (self.to, np.int32), (self.skip, np.int32)))
        by_length: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            if word:
                by_length.setdefault(len(word), []).append(k)
        for length, places in by_length.items():
            at = np.array(places)
            raw = np.frombuffer(b"".join([words[k] for k in places]), np.uint8).reshape(-1, length)
            state, number = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for column in range(length):
                if not len(at):
                    break
                key = state << 8 | raw[:, column]
                slot = ((key * self.FACTOR) >> 7) & self.mask
                open_rows = np.flatnonzero((keys[slot] != key) & (keys[slot] >= 0))
                while len(open_rows):
                    slot[open_rows] = (slot[open_rows] + 1) & self.mask
                    open_rows = open_rows[(keys[slot[open_rows]] != key[open_rows]) & (keys[slot[open_rows]] >= 0)]
                hit = keys[slot] == key
                raw, at, slot, number = raw[hit], at[hit], slot[hit], number[hit]
                state, number = to[slot].astype(np.int64), number + skip[slot]
            for k, last, n in zip(at.tolist(), state.tolist(), number.tolist()):
                if self.final[last]:
                    found[k] = self.flat[self.ends[n] : self.ends[n + 1]].tolist()
        return found

    def find(self, word: bytes) -> list[int] | None:
        state = number = 0
        keys, mask = self.keys, self.mask
        for byte in word:
            key = state << 8 | byte
            slot = ((key * self.FACTOR) >> 7) & mask
            while keys[slot] != key:
                if keys[slot] < 0:
                    return None
                slot = (slot + 1) & mask
            state, number = self.to[slot], number + self.skip[slot]
        if not word or not self.final[state]:
            return None
        return self.flat[self.ends[number] : self.ends[number + 1]].tolist()


def bpe(
    docs: DataFrame,
    tokenizer_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
    with_decoded: bool | None = None,
) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded])``, one row per document.

    Ids are those of the ``tokenizers`` library without added tokens; special strings inside a text
    are single tokens, as is its default. ``decoded`` is made from the ids; by default
    it comes with them, ``with_decoded`` says otherwise. Null texts count as empty; null ids of rows pass through; an empty table gives no rows; other columns are not read.
    The file must be at the same place on every worker.

    Frequent words of the corpus are compiled into a transducer of bounded size and broadcast. Other
    words are merged by the rules; workers remember at most ``CACHED`` words.
    """
    with_decoded = with_ids if with_decoded is None else with_decoded
    find = splitter()
    merges = Merges(tokenizer_file)
    words = frequent_words(docs, text_col, str.split, FREQUENT)
    frequent = sorted({w.encode() for word in words for w in find(" " + word)})[:FREQUENT]
    compiled = Transducer.build(frequent, merges.merge_all(frequent))
    shared = docs.sparkSession.sparkContext.broadcast(compiled)
    del merges, find

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the tables below are large and have no cycles
        try:
            yield from encoded(batches)
        finally:
            gc.enable()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = splitter()
        merges, lexicon = Merges(tokenizer_file), Transducer(shared.value)
        piece = merges.pieces.__getitem__
        special = regex.compile("(" + "|".join(map(regex.escape, merges.special)) + ")") if merges.special else None

        names = [str(i) for i in range(1 + max(merges.pieces, default=0))]

        def learn(words: set[str]) -> None:
            """Words to their ids, written out, and the bytes of these: by the transducer, or else by the rules."""
            unseen = [(word, word.encode()) for word in words]
            looked_up = lexicon.find_all([raw for _, raw in unseen])
            others = [x for x, ids in zip(unseen, looked_up) if ids is None]
            pairs = [(x[0], ids) for x, ids in zip(unseen, looked_up) if ids is not None]
            pairs += zip([word for word, _ in others], merges.merge_all([raw for _, raw in others]))
            for word, ids in pairs:
                written_of[word] = ",".join([names[i] for i in ids])
                bytes_of[word] = b"".join([piece(i) for i in ids])

        def words_of(text: str) -> list[str]:
            """The words of a text; special strings are words by themselves."""
            if special is None or not any(mark in text for mark in merges.special):
                return find(text)
            parts = special.split(text)
            return [w for k, x in enumerate(parts) for w in (find(x) if k % 2 == 0 else [x + SPECIAL])]

        def forget() -> None:
            written_of.clear()
            bytes_of.clear()
            written_of.update((text + SPECIAL, str(i)) for text, i in merges.special.items())
            bytes_of.update((text + SPECIAL, text.encode()) for text in merges.special)

        def encoded_texts(doc_ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], []]
            split = list(map(words_of, texts))
            if len(written_of) > CACHED:
                forget()
            learn(set().union(*split) - written_of.keys())
            for words in split:
                written = ",".join(map(written_of.__getitem__, words))
                decoded = b"".join(map(bytes_of.__getitem__, words)).decode("utf-8", "replace")
                out[0].append(written.count(",") + bool(words))
                out[1].append(hashlib.sha256(written.encode()).hexdigest())
                out[2].append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    out[3].append(np.array(written.split(",") if words else [], np.int32))
                if with_decoded:
                    out[4].append(decoded)
            columns = [doc_ids, pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(out[3], pa.list_(pa.int32())))
                names.append("ids")
            if with_decoded:
                columns.append(pa.array(out[4], pa.string()))
                names.append("decoded")
            return pa.RecordBatch.from_arrays(columns, names)

        written_of: dict[str, str] = {}
        bytes_of: dict[str, bytes] = {}
        forget()
        for batch in batches:
            start = 0
            while start < batch.num_rows:  # a batch may hold thousands of long texts
                texts, size = [], 0
                for value in batch.column(1).slice(start):
                    text = value.as_py() or ""
                    size += len(text)
                    if texts and size > AT_ONCE:
                        break
                    texts.append(text)
                yield encoded_texts(batch.column(0).slice(start, len(texts)), texts)
                start += len(texts)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += (", ids array<int>" if with_ids else "") + (", decoded string" if with_decoded else "")
    return docs.select(id_col, text_col).mapInArrow(encode, schema)
