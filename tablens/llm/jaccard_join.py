"""Similarity join on word shingles: routed by parts of the sets, large groups parted by sketches, joined with signature trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .common import BITMAP_ROWS, bitmap_of, in_bitmap
from .components import components

SHINGLE = 5
PERCENT = 80
RATIO = 1.5  # sizes of a class
SPARE = 1.3  # parts for each error that a class allows
WIDE = 200  # shingles of sets that have a fixed number of signatures
BANDS = 64  # these
BINS = 4  # least hashes in each
BLOCK_LOAD = 2_000_000  # shingles, and DOC_LOAD for each text, that one tree holds
DOC_LOAD = 500
BITS = 2048
FANOUT = 8
LEAST_BITS = 512  # of a sketch
MOST_BITS = 4096
FEW = 64  # sets with one signature that are compared in all pairs at once


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a whole text."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - SHINGLE + 1)
    mixed = np.full(n, min(len(words), SHINGLE), np.uint64)
    for k in range(min(SHINGLE, len(words))):
        mixed = (mixed ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def set_key(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def node_of(key: bytes) -> int:
    return int.from_bytes(key[:8], "big", signed=True)


def size_classes(n: int) -> list[tuple[int, int]]:
    """Number and largest size of the class of ``n``, and of the next if partners can be in it."""
    number, low = 0, 1
    while True:
        high = max(low + 1, int(low * RATIO))
        if n < high:
            break
        number, low = number + 1, high
    out = [(number, high - 1)]
    if high * PERCENT <= 100 * n:
        out.append((number + 1, max(high + 1, int(high * RATIO)) - 1))
    return out


def routes(tokens: np.ndarray) -> np.ndarray:
    """Signatures such that any two linked sets share one; their number is bounded (see ``bands``).

    Up to ``WIDE`` shingles this is certain: linked sets differ in a bounded number of shingles. Cut
    into more parts by hash than that, some parts agree, and one of these isn't empty if the spare
    parts outnumber the empty ones. As many small parts as can be spared aren't sent. Sets with too
    many empty parts also send the first hashes in order, a fifth of them and one more; two such
    sets share one of these.
    """
    n = len(tokens)
    differ = (n + n * 100 // PERCENT) * (100 - PERCENT) // (100 + PERCENT)
    out = []
    for number, largest in size_classes(n):
        if largest > WIDE:
            out.append(bands(tokens))
            break
        parts = int(SPARE * (2 * largest * (100 - PERCENT) // (100 + PERCENT))) + 2
        place = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        mixed = (tokens ^ (tokens >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        sums = np.add.reduceat(mixed ^ (mixed >> np.uint64(27)), starts)
        salt = np.uint64((number + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
        signature = (sums ^ (place[starts] + salt)) * np.uint64(0x9E3779B97F4A7C15)
        signature ^= signature >> np.uint64(30)
        spare = len(starts) - differ - 1  # so many parts with content needn't be sent
        if spare >= 0:  # the smallest, by a bound on their size, which both sets then respect
            sizes = np.diff(np.r_[starts, n])
            signature = signature[sizes >= np.sort(sizes)[min(spare, len(sizes) - 1)]]
        out.append(signature)
        if spare < 0:
            first = n - -(-n * PERCENT // 100) + 1
            out.append(tokens[:first] * np.uint64(0x2545F4914F6CDD1D) + np.uint64(1))
    return np.unique(np.concatenate(out))


def bands(tokens: np.ndarray) -> np.ndarray:
    """At most ``BANDS`` signatures of a wide set, each of the least hashes of ``BINS`` ranges of hashes.

    Two sets agree in a range at least as often as they are similar. At ``PERCENT`` they share no
    signature with a probability below 3e-15, less than that of two texts with one 64-bit hash.
    """
    place = (tokens >> np.uint64(32)) * np.uint64(BANDS * BINS) >> np.uint64(32)
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    least = np.zeros(BANDS * BINS, np.uint64)
    least[place[starts].astype(np.int64)] = tokens[starts]
    least = least.reshape(BANDS, BINS)
    signature = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(BINS):
        signature = (signature ^ least[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        signature ^= signature >> np.uint64(30)
    return signature[least.any(axis=1)]


def sketch(tokens: np.ndarray) -> bytes:
    """A bitmap of at least twice as many bits as tokens, within limits: bit by the low bits of each token."""
    bits = LEAST_BITS
    while bits < MOST_BITS and bits < 2 * len(tokens):
        bits *= 2
    out = np.zeros(bits, np.uint8)
    out[(tokens & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def read_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, n_shingles, key, node, signs, sketch)``; of equal sets in a batch, the first has signatures and a sketch."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, signs, sketches = [], [], [], []
            seen: set[bytes] = set()
            for scalar in batch.column(1):
                tokens = shingles(scalar.as_py())
                key = set_key(tokens)
                sizes.append(len(tokens))
                keys.append(key)
                new = len(tokens) and key not in seen
                signs.append(routes(tokens).tobytes() if new else None)
                sketches.append(sketch(tokens) if new else None)
                seen.add(key)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(map(node_of, keys), pa.int64()), pa.array(signs, pa.binary()),
                 pa.array(sketches, pa.binary())],
                ["doc_id", "n_shingles", "key", "node", "signs", "sketch"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        read, f"doc_id {kind}, n_shingles long, key binary, node long, signs binary, sketch binary"
    )


def read_tokens(docs: DataFrame, text_col: str) -> DataFrame:
    """``(key, tokens)``; of equal sets in a batch, the first."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[bytes, bytes] = {}
            for scalar in batch.column(0):
                tokens = shingles(scalar.as_py())
                if len(tokens):
                    sets.setdefault(set_key(tokens), tokens.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sets), pa.binary()), pa.array(list(sets.values()), pa.binary())], ["key", "tokens"]
            )

    return docs.select(text_col).mapInArrow(read, "key binary, tokens binary")


def route(sets: DataFrame) -> DataFrame:
    """``(a, b)``: nodes of ``(node, signs)`` that share a signature, as stars."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            packed = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            signs = np.concatenate(packed)
            owners = np.repeat(batch.column(0).to_numpy(), list(map(len, packed)))
            order = np.lexsort((owners, signs))
            signs, owners = signs[order], owners[order]
            first = np.r_[True, signs[1:] != signs[:-1]]
            heads = owners[first][np.cumsum(first) - 1]
            links = np.unique(np.c_[owners[~first], heads[~first]], axis=0)
            signs, owners = signs[first], owners[first]
            order = np.argsort(owners, kind="stable")  # runs of one owner take little room in the shuffle
            yield batch_of(signs[order], owners[order], None)
            if len(links):
                yield batch_of(None, links[:, 0].copy(), links[:, 1].copy())

    def batch_of(sign, a, b) -> pa.RecordBatch:
        signs, others = (pa.nulls(len(a), pa.int64()) if x is None else pa.array(x) for x in (sign, b))
        return pa.RecordBatch.from_arrays([signs, pa.array(a), others], ["sign", "a", "b"])

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_sign, last_head = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            signs, owners = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            first = np.r_[last_sign is None or signs[0] != last_sign, signs[1:] != signs[:-1]]
            heads = np.r_[last_head if last_head is not None else 0, owners[first]][np.cumsum(first)]
            last_sign, last_head = signs[-1], heads[-1]
            links = np.unique(np.c_[owners[~first], heads[~first]], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0].copy()), pa.array(links[:, 1].copy())], ["a", "b"])

    sent = sets.mapInArrow(send, "sign long, a long, b long")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one shuffle: local links go along under their own key
    key = F.coalesce("sign", F.xxhash64("a", "b"))
    dealt = sent.select(key.alias("sign"), "a", "b").repartition(parts, "sign")

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def signs() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                links = batch.column(2).is_valid()
                found = batch.filter(links).select(["a", "b"])
                if found.num_rows:
                    ready.append(found)
                yield batch.filter(pa.compute.invert(links))

        ready: list[pa.RecordBatch] = []
        for out in stars(signs()):
            yield from ready
            ready.clear()
            yield out
        yield from ready

    return dealt.sortWithinPartitions("sign", "a").mapInArrow(both, "a long, b long").distinct()


# ---- large groups ------------------------------------------------------------------------


def folded(sketches: list[bytes]) -> list[np.ndarray]:
    """By level: sketches folded to ``LEAST_BITS << level`` bits, in words; rows of smaller ones are zeros."""
    lengths = np.fromiter(map(len, sketches), np.int64, len(sketches))
    out: list[np.ndarray] = []
    held = LEAST_BITS // 8
    while held <= lengths.max():
        level = np.zeros((len(sketches), held), np.uint8)
        for length in np.unique(lengths[lengths >= held]):
            rows = np.flatnonzero(lengths == length)
            own = np.frombuffer(b"".join(sketches[k] for k in rows), np.uint8).reshape(len(rows), -1, held)
            level[rows] = np.bitwise_or.reduce(own, axis=1)
        out.append(level.view(np.uint64))
        held *= 2
    return out


def likely_links(signs: np.ndarray, sizes: np.ndarray, sketches: list[bytes]) -> np.ndarray:
    """Pairs of rows with one signature that may be linked; rows come by signature, then by size.

    Bits that only one of two sketches has stand for shingles that only one of the sets has, so a
    pair is passed over only if its sets can't be linked. What the pairs join, and nothing less, is
    returned: a large run is searched from one row to the next, through the rows not reached yet.
    """
    levels = folded(sketches)
    bits = [np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in levels]
    top = np.log2(np.fromiter(map(len, sketches), np.int64, len(sketches)) * 8 // LEAST_BITS).astype(np.int64)

    def alike(i: np.ndarray, j: np.ndarray, level: int) -> np.ndarray:
        both = np.bitwise_count(levels[level][i] & levels[level][j]).sum(axis=-1, dtype=np.int64)
        need = -(-(sizes[i] + sizes[j]) * PERCENT // (100 + PERCENT))
        most = np.minimum(sizes[i] - bits[level][i], sizes[j] - bits[level][j]) + both
        return (most >= need) & (100 * np.minimum(sizes[i], sizes[j]) >= PERCENT * np.maximum(sizes[i], sizes[j]))

    starts = np.flatnonzero(np.r_[True, signs[1:] != signs[:-1]])
    lengths = np.diff(np.r_[starts, len(signs)])
    found = []
    for length in np.unique(lengths[(lengths > 1) & (lengths <= FEW)]):
        left, right = np.triu_indices(length, 1)
        runs = starts[lengths == length]
        step = max(1, (1 << 16) // len(left))
        for k in range(0, len(runs), step):
            i, j = ((runs[k : k + step, None] + x).ravel() for x in (left, right))
            level = np.minimum(top[i], top[j])
            for x in np.unique(level):
                a, b = i[level == x], j[level == x]
                same = alike(a, b, x)
                found.append(np.c_[a[same], b[same]])
    for start, length in zip(starts[lengths > FEW], lengths[lengths > FEW], strict=True):
        left = np.arange(start, start + length)  # not reached yet, by size
        reached: list[int] = []
        while len(left):
            if not reached:
                reached, left = [int(left[0])], left[1:]
            i = reached.pop()
            low = np.searchsorted(sizes[left], -(-sizes[i] * PERCENT // 100))
            high = np.searchsorted(sizes[left], sizes[i] * 100 // PERCENT, "right")
            if low < high:
                near = left[low:high]
                next_ones = near[alike(np.int64(i), near, min(top[i], top[near].min()))]
                found.append(np.c_[np.full(len(next_ones), i), next_ones])
                reached += next_ones.tolist()
                left = np.r_[left[:low], np.setdiff1d(near, next_ones, assume_unique=True), left[high:]]
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def likely(sets: DataFrame) -> DataFrame:
    """``(a, b)``: links that join what may be linked among ``(node, n, signs, sketch)``, a row for each node.

    Linked sets share a signature, so only pairs with one are looked at. Sketches go along with the
    signatures that two sets or more have.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                packed = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
                owners = np.repeat(batch.column(0).to_numpy(), list(map(len, packed)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(packed)), pa.array(owners)], ["sign", "node"])

    def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = batch.column(0).to_numpy()
            last = int(np.searchsorted(signs, signs[-1]))
            if held and (last or held[-1].column(0)[0].as_py() != signs[0]):
                yield pa.Table.from_batches([*held, batch.slice(0, last)])
                held = []
            elif last:
                yield pa.Table.from_batches([batch.slice(0, last)])
            held.append(batch.slice(last))
        if held:
            yield pa.Table.from_batches(held)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches):
            signs, nodes, sizes = (rows.column(k).to_numpy() for k in range(3))
            pairs = np.unique(np.sort(nodes[likely_links(signs, sizes, rows.column(3).to_pylist())], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1].copy()), pa.array(pairs[:, 0].copy())], ["a", "b"])

    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = sets.select("node", "signs").mapInArrow(send, "sign long, node long")
    shared = sent.withColumn("sets", F.count("*").over(Window.partitionBy("sign"))).where("sets > 1").drop("sets")
    dealt = shared.join(sets.select("node", "n", "sketch"), "node").select("sign", "node", "n", "sketch")
    return dealt.repartition(parts, "sign").sortWithinPartitions("sign", "n").mapInArrow(compare, "a long, b long").distinct()


def parted(sets: DataFrame, base: DataFrame) -> DataFrame:
    """``sets``, but labels too large for one tree are parted into what their sketches join.

    Signatures of a few frequent shingles tie most texts together as a corpus grows. Sets that stay
    alone in a parted label have no link and go.
    """
    wide = cut(loads(sets).where(F.col("load") > BLOCK_LOAD).select("label"))
    if wide.isEmpty():
        return sets
    many = sets.join(wide, "label")
    rows = in_bitmap(base.where("signs is not null"), "node", bitmap_of(many, "node", BITMAP_ROWS), BITMAP_ROWS)
    # not a semi join: Spark would push that below the bitmap
    one = rows.join(many.select("key"), "key").groupBy("key", "node").agg(
        F.first("n_shingles").alias("n"), F.first("signs").alias("signs"), F.first("sketch").alias("sketch")
    )
    nodes = named_nodes(components(likely(cut(one.drop("key")))))
    return cut(sets.join(wide, "label", "left_anti").unionByName(many.drop("label").join(nodes, "node").select(sets.columns)))


# ---- signature trees ---------------------------------------------------------------------


@dataclass
class Node:
    union: int  # OR of the token bitmaps
    common: int  # AND of them
    low: int  # least and largest size
    high: int
    members: range
    children: list["Node"] = field(default_factory=list)
    joined: bool = False  # all members are in one component


def bitmap(tokens: np.ndarray) -> int:
    bits = np.zeros(BITS, np.uint8)
    bits[(tokens & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def tree(sets: list[np.ndarray], start: int = 0) -> Node:
    """Leaves are sets, numbered from ``start``; ``sets`` come by size."""
    level = []
    for k, x in enumerate(sets):
        bits = bitmap(x)
        level.append(Node(bits, bits, len(x), len(x), range(start + k, start + k + 1), joined=True))
    while len(level) > 1:
        above = []
        for k in range(0, len(level), FANOUT):
            part = level[k : k + FANOUT]
            if len(part) == 1:  # a node with one child would hide its sets from a leaf
                above += part
                continue
            union, common = 0, -1
            for node in part:
                union, common = union | node.union, common & node.common
            span = range(part[0].members.start, part[-1].members.stop)
            above.append(Node(union, common, part[0].low, part[-1].high, span, part))
        level = above
    return level[0]


def tree_links(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links that join what the sets' links join: a forest, not all pairs.

    Dual traversal of one tree with itself or of two trees. A pair of nodes is passed over when its
    sizes are too far apart, when its largest possible overlap is too small, or when all its members
    are in one component already.
    """
    sets = left + (right or [])
    if not left or (right is not None and not right):
        return []
    parent = list(range(len(sets)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def joined(node: Node) -> bool:
        if not node.joined and all(map(joined, node.children)):
            node.joined = len({find(x.members.start) for x in node.children}) == 1
        return node.joined

    links: list[tuple[int, int]] = []
    first = tree(left)
    stack = [(first, first if right is None else tree(right, len(left)))]
    while stack:
        a, b = stack.pop()
        small, large = (a, b) if a.high <= b.high else (b, a)
        if 100 * small.high < PERCENT * large.low:
            continue
        need = -(-(a.low + b.low) * PERCENT // (100 + PERCENT))
        if min(a.high - (a.common & ~b.union).bit_count(), b.high - (b.common & ~a.union).bit_count()) < need:
            continue
        if a is not b and joined(a) and joined(b) and find(a.members.start) == find(b.members.start):
            continue
        if a is b:
            if not joined(a):
                kids = a.children
                stack += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(len(kids) - 1, i, -1)]
                stack += [(x, x) for x in kids]
        elif a.children or b.children:
            if len(a.members) >= len(b.members):
                stack += [(x, b) for x in a.children]
            else:
                stack += [(a, x) for x in b.children]
        else:
            i, j = a.members.start, b.members.start
            x, y = sets[i], sets[j]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= PERCENT * (len(x) + len(y) - both):
                parent[find(i)] = find(j)
                links.append((i, j))
    return links


def loads(sets: DataFrame) -> DataFrame:
    """``(label, load)``: what a tree of a label's sets holds."""
    return sets.groupBy("label").agg(F.sum(F.col("n") + DOC_LOAD).alias("load"))


def join_blocks(sets: DataFrame, tokens: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between keys of ``sets`` ``(label, key, n)`` with ``tokens`` ``(key, tokens)``.

    Sets of one label may be linked. A label too large for one tree is split by size, then by hash,
    into blocks, and blocks of the same or neighbouring sizes meet in pairs.
    """
    load = F.sum(F.col("n") + DOC_LOAD)
    wide = cut(loads(sets).where(F.col("load") > BLOCK_LOAD).select("label"))
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT) + 0.01)).cast("int")
    few = sets.join(wide, "label", "left_anti").select(
        "label", "key", "n", F.lit("0").alias("pair"), F.lit(False).alias("second")
    )
    many = sets.join(wide, "label").withColumn("step", step)
    blocks = cut(many.groupBy("label", "step").agg(F.ceil(load / BLOCK_LOAD).cast("int").alias("blocks")))
    here = blocks.select("label", "step", "blocks")
    above = blocks.select("label", (F.col("step") - 1).alias("step"), F.col("blocks").alias("up"))
    below = blocks.select("label", (F.col("step") + 1).alias("step"), F.col("blocks").alias("down"))
    layout = here.join(above, ["label", "step"], "left").join(below, ["label", "step"], "left").na.fill(0, ["up", "down"])

    def pairs(count: str, name, second) -> Column:
        every = F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(every, lambda k: F.struct(name(k).alias("pair"), second(k).alias("second")))

    own = F.col("own")
    placed = many.join(layout, ["label", "step"]).withColumn("own", F.pmod(F.hash("key"), F.col("blocks")))
    spread = placed.withColumn(
        "to",
        F.explode(
            F.concat(
                pairs("blocks", lambda k: F.concat_ws(":", F.lit("same"), "step", F.least(own, k), F.greatest(own, k)), lambda k: own > k),
                pairs("up", lambda k: F.concat_ws(":", F.lit("next"), "step", own, k), lambda k: F.lit(False)),
                pairs("down", lambda k: F.concat_ws(":", F.lit("next"), F.col("step") - 1, k, own), lambda k: F.lit(True)),
            )
        ),
    ).select("label", "key", "n", "to.pair", "to.second")

    def join(group: pa.Table) -> pa.Table:
        group = group.sort_by([("n", "ascending"), ("key", "ascending")])
        second = group.column("second").to_pylist()
        keys = group.column("key").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in group.column("tokens").to_pylist()]
        one, two = ([k for k, s in enumerate(second) if s is flag] for flag in (False, True))
        cross = group.column("pair")[0].as_py()
        alone = cross == "0" or (cross.startswith("same") and len(set(cross.split(":")[2:])) == 1)
        found = tree_links([sets[k] for k in one], None if alone else [sets[k] for k in two])
        order = one if alone else one + two
        return pa.table(
            {
                "a": pa.array([keys[order[i]] for i, _ in found], pa.binary()),
                "b": pa.array([keys[order[j]] for _, j in found], pa.binary()),
            }
        )

    places = few.unionByName(spread).groupBy("key").agg(F.collect_list(F.struct("label", "n", "pair", "second")).alias("places"))
    # the sets of copies come in turn; one of each key goes on to its places
    one = places.join(tokens, "key").groupBy("key").agg(F.first("places").alias("places"), F.first("tokens").alias("tokens"))
    dealt = one.select("key", "tokens", F.explode("places").alias("to")).select("to.*", "key", "tokens")
    return dealt.groupBy("label", "pair").applyInArrow(join, "a binary, b binary")


def named_nodes(joined: DataFrame) -> DataFrame:
    """``(node, label)`` of all nodes in components ``(node, component)``."""
    return joined.select("node", F.col("component").alias("label")).unionByName(
        joined.select(F.col("component").alias("node"), F.col("component").alias("label")).distinct()
    )


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per document.

    Sets of shingles of ``SHINGLE`` words (ASCII letters in lower case; fewer words make one
    shingle) link at a Jaccard similarity of ``PERCENT`` or more. ``component_id`` is the smallest
    id reachable over links. Null texts and texts without words have no shingles and stand alone
    under their own id. Null ids are passed over when the smallest is taken. Repeated rows belong
    together. An empty table gives no rows; other columns are not read.

    Equal sets become one node. Nodes that share a signature, and what they reach, form a group; a
    group too large for one tree is parted by sketches of its sets, which pass all linked pairs;
    signature trees join each group exactly. Every text is read once for its signatures; one text of
    each set in a group, found with a bitmap of ids, is read again for its shingles. Texts are never
    shuffled, and only the sets in groups are.
    """
    base = cut(read_sets(docs, id_col, text_col))
    nodes = named_nodes(components(route(base.where("signs is not null").select("node", "signs"))))
    one = base.where("signs is not null").groupBy("node", "key").agg(
        F.first("n_shingles").alias("n"), F.min(F.xxhash64("doc_id")).alias("ticket")
    )
    sets = parted(cut(one.join(nodes, "node").select("label", "node", "key", "n", "ticket")), base)
    again = in_bitmap(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("ticket")),
        "ticket",
        bitmap_of(sets, "ticket", BITMAP_ROWS),
        BITMAP_ROWS,
    )
    tokens = read_tokens(again, "text")
    joined = components(join_blocks(sets.select("label", "key", "n"), tokens))
    named = base.select("doc_id", "n_shingles", "key").join(
        joined.withColumnRenamed("node", "key"), "key", "left"
    ).withColumn("group", F.coalesce("component", "key"))
    alone = named.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    grouped = named.where("n_shingles > 0")
    least = grouped.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return alone.unionByName(grouped.join(least, "group").select("doc_id", "n_shingles", "component_id"))
