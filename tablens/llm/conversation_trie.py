"""Prefix trie of conversations, rolled up by depth bands."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BAND = 16  # depths that a node is carried up at once
SHARED_TURNS = 6  # a conversation takes fewer than so many turns from the first of its hundred
HUNDRED = 100
CHUNK = 1024  # ids of one chunk of a list that goes over several tasks
HOT = 1000  # a node with more than this part of all nodes as children meets them by broadcast


def turns_of(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(conv, turn, a, b, size)``: a turn's role and text as 120 bits of SHA-256, and its code points."""
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    bits = lambda start: F.conv(F.substring("digest", start, 15), 16, 10).cast("long")
    kept = conversations.where(F.col(conv_col).isNotNull())
    return kept.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), digest.alias("digest"),
        F.length(text).cast("long").alias("size"),
    ).select("conv", "turn", bits(1).alias("a"), bits(16).alias("b"), "size")


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their place, from 1, in their conversation as ``before + here``, and the parts they lie in.

    Turns are dealt out by ranges, so a conversation of any length lies in many parts; ``here``
    counts inside a part, and one record per part and conversation says how many came ``before``.
    """
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))  # equal turns may lie in several parts
    dealt = turns.withColumn("salt", salt).repartitionByRange(parts, "conv", F.asc_nulls_first("turn"), "a", "b", "salt")
    dealt = written(dealt.withColumn("part", F.spark_partition_id()).drop("salt"))
    inside = Window.partitionBy("part", "conv").orderBy(F.asc_nulls_first("turn"), "a", "b")
    placed = dealt.withColumn("here", F.row_number().over(inside).cast("long")).drop("turn")
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("part", "conv").agg(F.count("*").alias("n"))
    return placed, counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def rebuilt(turns: DataFrame, shared: Column) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations ``(conv, depth, up_a, up_b, a, b, size)`` and their ``(conv, depth)`` at the end.

    The first ``shared`` turns come from the conversation ``conv - conv % 100``. ``a, b`` name the
    whole prefix (an exclusive or of digests of place and turn), ``up_a, up_b`` the prefix without
    the last turn.
    """
    placed, parts = numbered(turns)
    placed, parts = written(placed), written(parts)
    convs = parts.groupBy("conv").agg(F.sum("n").alias("own")).withColumn("h", shared)
    convs = convs.withColumn("base", F.col("conv") - F.col("conv") % HUNDRED)
    # of the first conversations of hundreds, the turns that others may take
    heads = parts.where((F.col("conv") % HUNDRED == 0) & (F.col("before") < SHARED_TURNS - 1))
    first = (
        placed.where(F.col("conv") % HUNDRED == 0).join(heads.select("part", "conv", "before"), ["part", "conv"])
        .withColumn("place", F.col("before") + F.col("here")).where(F.col("place") < SHARED_TURNS)
        .groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "a", "b", "size"))).alias("head"))
    )
    none = F.from_json(F.lit("[]"), first.schema["head"].dataType)
    convs = convs.join(first, "base", "left").withColumn("head", F.slice(F.coalesce("head", none), 1, F.greatest("h", F.lit(1)).cast("int")))
    convs = convs.withColumn("head", F.when(F.col("h") > 0, F.col("head")).otherwise(none)).withColumn("taken", F.size("head").cast("long"))
    convs = written(convs.select("conv", "own", "h", "head", "taken"))

    def mixed(place: Column, a: Column, b: Column) -> list[Column]:
        return [F.xxhash64(place, a, b), F.xxhash64(b, place, a, F.lit(1))]

    shared_turns = convs.select("conv", F.explode("head").alias("t")).select(
        "conv", F.col("t.place").alias("depth"), *(x.alias(n) for x, n in zip(mixed(F.col("t.place"), F.col("t.a"), F.col("t.b")), "xy")),
        F.col("t.size").alias("size"),
    )
    running = Window.partitionBy("conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    shared_turns = shared_turns.withColumns({"a": F.bit_xor("x").over(running), "b": F.bit_xor("y").over(running)})
    heads = shared_turns.groupBy("conv").agg(F.bit_xor("x").alias("head_x"), F.bit_xor("y").alias("head_y"))
    # own turns after the first h: what precedes them is the head and the own turns of earlier parts
    where = parts.select("part", "conv", "before").join(convs.select("conv", "h", "taken"), "conv").join(heads, "conv", "left")
    own = placed.join(where, ["part", "conv"]).withColumn("depth", F.col("before") + F.col("here") - F.col("h") + F.col("taken"))
    own = own.where(F.col("before") + F.col("here") > F.col("h"))
    own = own.withColumns(dict(zip("xy", mixed(F.col("depth"), F.col("a"), F.col("b")))))
    own = written(own.select("part", "conv", "depth", "x", "y", "size", "head_x", "head_y"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy("part", "conv", "head_x", "head_y").agg(F.bit_xor("x").alias("sum_x"), F.bit_xor("y").alias("sum_y"))
    zero = F.lit(0).cast("long")
    for n in "xy":
        sums = sums.withColumn(
            f"to_{n}", F.coalesce(f"head_{n}", zero).bitwiseXOR(F.coalesce(F.bit_xor(f"sum_{n}").over(earlier), zero))
        )
    inside = Window.partitionBy("part", "conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    own = own.join(sums.select("part", "conv", "to_x", "to_y"), ["part", "conv"]).withColumns(
        {"a": F.col("to_x").bitwiseXOR(F.bit_xor("x").over(inside)), "b": F.col("to_y").bitwiseXOR(F.bit_xor("y").over(inside))}
    )
    columns = ["conv", "depth", "x", "y", "a", "b", "size"]
    turns = shared_turns.select(columns).unionByName(own.select(columns))
    root = convs.select("conv", *(F.lit(0).cast("long").alias(n) for n in columns[1:]))
    up = [F.col("a").bitwiseXOR(F.col("x")).alias("up_a"), F.col("b").bitwiseXOR(F.col("y")).alias("up_b")]
    rows = turns.unionByName(root).select("conv", "depth", *up, "a", "b", "size")
    ends = convs.select("conv", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("depth"))
    return rows, ends


def end_digests(ends: DataFrame) -> DataFrame:
    """``(a, b, ends_sha256)`` of ``(a, b, conv)``: SHA-256 of the ids, ascending, joined by commas.

    Ids are sorted by ranges and hashed as they stream by. A node whose ids may go over the edge of a
    task is sent on in chunks of ``CHUNK`` ids, which one task hashes in order: the digest of one
    string can't be made in parts, but no task keeps more than a chunk.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, held, sent = None, True, [], 0

        def rows(found: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], ["a", "b", "ends_sha256", "chunk", "ids"]
            )

        # the first node of a task goes on in chunks, as does the last one; what lies between is whole
        for batch in batches:
            found: list[tuple] = []
            for a, b, conv in zip(*(batch.column(n).to_pylist() for n in ("a", "b", "conv"))):
                if (a, b) != now:
                    if now is not None:
                        if first:
                            found.append((*now, None, sent, ",".join(held)))
                        else:
                            found += closed(now, held, sent)
                        first = False
                    now, held, sent = (a, b), [], 0
                held.append(str(conv))
                if len(held) == CHUNK:
                    found.append((*now, None, sent, ",".join(held)))
                    held, sent = [], sent + 1
            yield rows(found)
        if now is not None:
            yield rows([(*now, None, sent, ",".join(held))])

    def closed(now: tuple, held: list[str], sent: int) -> list[tuple]:
        if sent:  # its first chunks are on their way
            return [(*now, None, sent, ",".join(held))]
        return [(*now, hashlib.sha256(",".join(held).encode()).hexdigest(), None, None)]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, any_id = None, None, False

        def rows(found: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], ["a", "b", "ends_sha256"])

        for batch in batches:
            found = []
            for a, b, ids in zip(*(batch.column(n).to_pylist() for n in ("a", "b", "ids"))):
                if (a, b) != now:
                    if now is not None:
                        found.append((*now, state.hexdigest()))
                    now, state, any_id = (a, b), hashlib.sha256(), False
                if ids:
                    state.update((("," if any_id else "") + ids).encode())
                    any_id = True
            yield rows(found)
        if now is not None:
            yield rows([(*now, state.hexdigest())])

    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ends.repartitionByRange(parts, "a", "b", "conv").sortWithinPartitions("a", "b", "conv").select("a", "b", "conv")
    streamed = dealt.mapInArrow(stream, "a long, b long, ends_sha256 string, chunk long, ids string")
    streamed = written(streamed.withColumn("part", F.spark_partition_id()))
    whole = streamed.where("chunk is null").select("a", "b", "ends_sha256")
    chunks = streamed.where("chunk is not null").repartition("a", "b").sortWithinPartitions("a", "b", "part", "chunk")
    joined = chunks.select("a", "b", "ids").mapInArrow(join, "a long, b long, ends_sha256 string")
    return whole.unionByName(joined)


def rolled_up(rows: DataFrame, height: int) -> DataFrame:
    """``(a, b, leaves, saved)``: the sums of each node's subtree.

    ``rows (conv, depth, a, b, mine, leaves, saved)`` are the nodes on paths from the root; a node's
    own numbers are on the one row that is ``mine``, the others have zeros. ``height`` is the largest depth.

    Inside a band of ``BAND`` depths, each path hands its numbers up to its nodes in the band. The
    tops of bands make a trie of their own, which is rolled up in the same way, so that rounds grow
    with the logarithm of the height; the totals of the tops then go up to the nodes of the band above.
    """

    def sums(df: DataFrame) -> DataFrame:
        return df.groupBy("a", "b").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))

    stretch = rows.groupBy("conv", F.expr(f"depth div {BAND}").alias("band")).agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("depth", "a", "b", "mine", "leaves", "saved")))).alias("up")
    )
    # nodes of a stretch, deepest first, each with the sums from the deepest to itself
    start = F.expr("array(struct(0L as a, 0L as b, 0L as leaves, 0L as saved))")

    def step(done, node):
        last = F.element_at(done, -1)
        more = [(last[n] + node[n]).alias(n) for n in ("leaves", "saved")]
        return F.concat(done, F.array(F.struct(node["a"].alias("a"), node["b"].alias("b"), *more)))

    def carried(stretch: DataFrame) -> DataFrame:
        own = stretch.where(F.exists("up", lambda node: node["mine"]))  # others have nothing to hand up
        return sums(own.select(F.explode(F.slice(F.aggregate("up", start, step), 2, BAND)).alias("n")).select("n.*"))

    if height < BAND:
        return carried(stretch)
    stretch = written(stretch)
    inside = written(carried(stretch))
    tops = stretch.select("conv", "band", F.element_at("up", -1).alias("n")).where(F.col("n.depth") % BAND == 0)
    tops = tops.select("conv", F.col("band").alias("depth"), "n.a", "n.b")
    kept = tops.groupBy("a", "b").agg(F.min("conv").alias("conv"), F.max("depth").alias("depth")).join(inside, ["a", "b"])
    kept = written(kept)
    paths = tops.join(kept.select("conv", "depth", "leaves", "saved"), ["conv", "depth"], "left")
    paths = paths.withColumn("mine", F.col("leaves").isNotNull())
    paths = paths.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("leaves", "saved")})
    totals = written(rolled_up(written(paths), height // BAND))
    # the total of a top goes to the nodes of the band above, on the path that keeps the top
    given = kept.where("depth > 0").select("conv", (F.col("depth") - 1).alias("band"), "a", "b").join(totals, ["a", "b"])
    above = given.select("conv", "band", "leaves", "saved").join(stretch.select("conv", "band", "up"), ["conv", "band"])
    above = above.select(F.explode("up").alias("n"), "leaves", "saved").select("n.a", "n.b", "leaves", "saved")
    return sums(inside.unionByName(above))


def conversation_trie(
    conversations: DataFrame, shared: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations.

    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``; a
    node is named by its smallest member and its depth. Turns are ordered by turn, null first; equal
    turns by the SHA-256 of role and text. A conversation takes its first ``shared`` turns (an
    expression over ``conv``, 0 to 5; none without it) from conversation ``conv - conv % 100``, or all
    of them if that has fewer, and its own turns after the first ``shared``; it may end up without turns.

    Null roles and texts count as empty. Turns without a conversation id belong to none and are left
    out. Equal rows are turns of their own. An empty table gives no rows. Other columns are not read.
    Nodes are told apart by 128 bits made from SHA-256 of their turns.

    Texts are read once and never shuffled. Turns are numbered in ranges, so that a conversation may
    be of any length; nodes meet by counts, combined in each task; subtree sums go up by depth bands.
    """
    shared = F.lit(0) if shared is None else shared
    turns = written(turns_of(conversations, conv_col, turn_col, role_col, text_col))
    rows, ends = rebuilt(turns, shared.cast("long"))
    rows, ends = written(rows), written(ends)
    nodes = rows.groupBy("a", "b").agg(
        F.min("conv").alias("conv"), F.count("*").alias("n"), F.max("depth").alias("depth"),
        F.max("size").alias("size"), F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b"),
    )
    nodes = written(nodes)
    below = nodes.where("depth > 0").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("children"))
    nodes = written(nodes.join(below, ["a", "b"], "left").withColumn("children", F.coalesce("children", F.lit(0))))
    own = nodes.select(
        F.col("conv").alias("conv"), "depth", (F.col("children") == 0).cast("long").alias("leaves"),
        ((F.col("n") - 1) * F.col("size")).alias("saved"),
    )
    paths = rows.select("conv", "depth", "a", "b").join(own, ["conv", "depth"], "left")
    paths = paths.withColumn("mine", F.col("leaves").isNotNull())
    paths = paths.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("leaves", "saved")})
    height = nodes.agg(F.max("depth")).first()[0] or 0
    totals = rolled_up(written(paths), height)
    last = rows.join(ends, ["conv", "depth"]).select("a", "b", "conv")
    digests = end_digests(last)
    # few nodes can have many children; these are broadcast, so that no task gets all children of one
    limit = nodes.count() / HOT
    parents = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv").alias("parent_conv_id"), "children")
    many = F.broadcast(parents.where(F.col("children") > limit).drop("children"))
    few = parents.where(F.col("children") <= limit).drop("children")
    of_few = nodes.join(many, ["up_a", "up_b"], "left_anti").join(few, ["up_a", "up_b"], "left")
    placed = nodes.join(many, ["up_a", "up_b"]).unionByName(of_few)
    full = placed.join(totals, ["a", "b"]).join(digests, ["a", "b"], "left")
    return full.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
