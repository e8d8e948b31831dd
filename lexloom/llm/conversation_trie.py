"""Trie of conversation prefixes, finished shard by shard.

A conversation is the sequence of its turns' digests, 16 bytes a turn. Conversations are sorted
by (sequence, conv_id) into ranges. Where two ranges meet, the turns that the last conversation
of the one and the first of the other have in common are the splitter path: only nodes on a
splitter path can have members in several ranges. The trie of these paths, the skeleton, goes to
every task. A task reads its range in order with one stack of open nodes, finishes every node off
the skeleton, and hands on partial aggregates of skeleton nodes, which Spark reduces. Sums over
subtrees of the skeleton are differences of running sums in preorder.

The skeleton is measured before it is built; where its paths are over SKELETON_BYTES, neighbouring
ranges are joined until they are not. A task holds one path of open nodes and the children of open
nodes, never a range. SHA-256 has no partial sums, so the ids that end at a skeleton node are hashed
as a stream of sorted chunks.

Defined cases: null role and text are empty. Turns stand by number, null first, equal numbers by
digest, repeated rows each count. Rows without conv_id form no conversation. A conversation's
sequence is one value (16 bytes a turn). An empty table has no nodes, not even the root. Only the
columns conv_id, turn, role and text are read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lexloom.session import checkpoint

TURN = 16  # bytes of a turn's digest
SHARD_TURNS = 16_384
MAX_SHARDS = 20_000
SKELETON_BYTES = 64 << 20
CHUNK_BYTES = 64 << 10  # text of ids handed on at once
ROWS_OUT = 4_096
_PARTS = ("kind int, node int, conv_id bigint, depth int, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
          "saved bigint, turn_bytes bigint, ends string")
_DONE, _PARTIAL, _IDS = 0, 1, 2
_NOTHING = hashlib.sha256(b"").hexdigest()


def original(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, turns (in order; digest and bytes of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turn = F.struct("turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return (
        conversations.where("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("conv_id"))
        .agg(F.transform(F.array_sort(F.collect_list(turn), _by_turn), lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))
    )


def _by_turn(a, b):
    """Order of two turns: number (null first), then digest."""
    def less(x, y):
        return F.when(x < y, -1).when(x > y, 1)
    nulls = F.when(a["turn"].isNull() & b["turn"].isNotNull(), -1).when(a["turn"].isNotNull() & b["turn"].isNull(), 1)
    return F.coalesce(nulls, less(a["turn"], b["turn"]), less(a["digest"], b["digest"]), F.lit(0))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Every conversation with the first h turns of its family's head in place of its own first h."""
    h = (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    heads = turns.where("conv_id % 5 = 0").select(F.col("conv_id").alias("head"), F.slice("turns", 1, 8).alias("head_turns"))
    own = turns.withColumn("head", F.col("conv_id") - F.col("conv_id") % 5).withColumn("h", h)
    late = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    early = F.slice(F.coalesce("head_turns", F.slice("turns", 1, 0)), 1, F.col("h"))
    return own.join(heads, "head", "left").select("conv_id", F.concat(early, late).alias("turns"))


class _Skeleton:
    """Trie of splitter paths, nodes numbered in preorder; node 0 is the root."""

    def __init__(self, paths: list[bytes]):
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth = [-1], [0]
        for path in sorted(paths):
            node = 0
            for i in range(0, len(path), TURN):
                step = (node, path[i:i + TURN])
                if step not in self.child:
                    self.child[step] = len(self.parent)
                    self.parent.append(node)
                    self.depth.append(self.depth[node] + 1)
                node = self.child[step]

    def rows(self) -> list[tuple[int, int, int, int, int]]:
        """(node, parent, depth, last node of the subtree, children on the skeleton)."""
        last, children = list(range(len(self.parent))), [0] * len(self.parent)
        for node in range(len(self.parent) - 1, 0, -1):
            last[self.parent[node]] = max(last[self.parent[node]], last[node])
            children[self.parent[node]] += 1
        return list(zip(range(len(last)), self.parent, self.depth, last, children))


def _common(a: bytes, b: bytes) -> int:
    """Number of turns two paths share from the start."""
    n = 0
    while n < min(len(a), len(b)) and a[n:n + TURN] == b[n:n + TURN]:
        n += TURN
    return n // TURN


class _Node:
    """An open node: aggregates of what is closed below it so far."""
    __slots__ = ("skeleton", "bytes", "first", "convs", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, skeleton: int, size: int):
        self.skeleton, self.bytes = skeleton, size
        self.first, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends = None  # a hash off the skeleton, a list of ids on it
        self.waiting: list[list] = []


class _Walk:
    """Closes nodes as sorted conversations pass; ``out`` collects rows of _PARTS."""

    def __init__(self, child: dict[tuple[int, bytes], int]):
        self.child, self.out = child, []
        self.open: list[_Node] = []
        self.path = b""

    def add(self, conv_id: int, path: bytes, sizes: list[int]) -> None:
        if not self.open:
            self.open, self.path = [_Node(0, 0)], b""
        same = _common(self.path, path)
        self._close(same + 1)
        for d in range(same, len(path) // TURN):
            above = self.open[-1].skeleton
            step = self.child.get((above, path[d * TURN:(d + 1) * TURN]), -1) if above >= 0 else -1
            self.open.append(_Node(step, sizes[d]))
        self.path = path
        self._end(self.open[-1], conv_id)

    def _end(self, node: _Node, conv_id: int) -> None:
        node.first = conv_id if node.first is None else min(node.first, conv_id)
        node.convs += 1
        if node.skeleton < 0:
            if node.ends is None:
                node.ends = hashlib.sha256(b"%d" % conv_id)
            else:
                node.ends.update(b",%d" % conv_id)
            return
        node.ends = node.ends or []
        node.ends.append(conv_id)
        if len(node.ends) * 8 > CHUNK_BYTES:
            self._hand_on(node)

    def _hand_on(self, node: _Node) -> None:
        if node.ends:
            self.out.append([_IDS, node.skeleton, node.ends[0], *[None] * 7, ",".join(map(str, node.ends))])
            node.ends = []

    def _close(self, keep: int) -> None:
        """Closes open nodes until ``keep`` are left."""
        while len(self.open) > keep:
            depth = len(self.open) - 1
            node = self.open.pop()
            above = self.open[-1] if self.open else None
            if above is not None:
                above.convs += node.convs
                above.first = node.first if above.first is None else min(above.first, node.first)
            if node.skeleton >= 0:
                self._hand_on(node)
                self.out.append([_PARTIAL, node.skeleton, node.first, depth, None, node.convs, node.children, node.leaves, node.saved, node.bytes, None])
                continue
            leaves = node.leaves if node.children else 1
            saved = node.saved + (node.convs - 1) * node.bytes
            above.children += 1
            above.leaves += leaves
            above.saved += saved
            row = [_DONE, None, node.first, depth, None, node.convs, node.children, leaves, saved, node.bytes, node.ends.hexdigest() if node.ends else _NOTHING]
            for child in node.waiting:
                child[4] = node.first
            self.out.extend(node.waiting)
            if above.skeleton >= 0:
                row[1] = above.skeleton  # the parent's first conversation may be in another range
                self.out.append(row)
            else:
                above.waiting.append(row)

    def finish(self) -> None:
        self._close(0)


def _batches(walk: _Walk, schema: pa.Schema, least: int) -> Iterator[pa.RecordBatch]:
    if len(walk.out) >= least and walk.out:
        columns = list(zip(*walk.out))
        walk.out.clear()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _parts_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in _PARTS.split(", ")])


def _skeleton(shards: DataFrame) -> tuple[_Skeleton, int]:
    """The splitter paths' trie, and by how many neighbouring ranges were joined for its size."""
    joined = 1
    while True:
        edges = shards.groupBy(F.floor(F.col("shard") / joined).alias("shard")).agg(F.min("path").alias("low"), F.max("path").alias("high"))
        size = edges.agg(F.sum(F.length("low") + F.length("high"))).first()[0] or 0
        if size <= SKELETON_BYTES:
            break
        joined *= 2
    rows = sorted(edges.collect(), key=lambda r: r.shard)
    return _Skeleton([bytes(b.low)[:TURN * _common(bytes(a.high), bytes(b.low))] for a, b in zip(rows, rows[1:])]), joined


def nodes(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the trie of ``paths`` (conv_id, turns of digest and bytes), a row each.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256; the root has depth 0 and no parent.
    """
    spark = paths.sparkSession
    flat = checkpoint(paths.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")).alias("path"),
        F.transform("turns", lambda t: t["bytes"]).alias("sizes")), "paths")
    turns = flat.agg(F.sum(F.length("path") / TURN + 1)).first()[0] or 0
    n = max(1, min(MAX_SHARDS, int(-(-turns // shard_turns))))
    shards = checkpoint(flat.repartitionByRange(n, "path", "conv_id").withColumn("shard", F.spark_partition_id()), "shards")
    skeleton, joined = _skeleton(shards)
    child, schema = spark.sparkContext.broadcast(skeleton.child), _parts_schema()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_walk, shard = _Walk(child.value), None
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    open_walk.finish()
                    shard = row["shard"]
                open_walk.add(row["conv_id"], row["path"], row["sizes"])
                yield from _batches(open_walk, schema, ROWS_OUT)
        open_walk.finish()
        yield from _batches(open_walk, schema, 1)

    ordered = shards.withColumn("shard", F.floor(F.col("shard") / joined).cast("int")).repartition(n, "shard").sortWithinPartitions("shard", "path", "conv_id")
    parts = checkpoint(ordered.mapInArrow(walk, _PARTS), "trie")
    top = _reduced(parts, skeleton)
    done = parts.where(F.col("kind") == _DONE).select(
        "node", "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends")
    above = F.broadcast(top.select(F.col("node").alias("above"), F.col("conv_id").alias("above_conv_id")))  # the skeleton, of bounded size
    lower = done.join(above, F.col("node") == F.col("above"), "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above_conv_id"))
    upper = top.join(above, F.col("parent") == F.col("above"), "left").withColumn("parent_conv_id", F.col("above_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")]
    return lower.select(*columns).unionByName(upper.select(*columns))


def _reduced(parts: DataFrame, skeleton: _Skeleton) -> DataFrame:
    """Finished skeleton nodes: partial aggregates added up over ranges, then over subtrees."""
    spark = parts.sparkSession
    shape = spark.createDataFrame(skeleton.rows(), "node int, parent int, depth bigint, last int, inner_children bigint")
    sums = parts.where(F.col("kind") == _PARTIAL).groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved").alias("saved"), F.max("turn_bytes").alias("turn_bytes"))
    own = sums.join(shape, "node").withColumn("n_children", F.col("n_children") + F.col("inner_children"))
    own = own.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")))
    own = own.withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("turn_bytes"))
    upto = Window.orderBy("node").rowsBetween(Window.unboundedPreceding, 0)  # over the skeleton only
    run = own.withColumn("leaves_upto", F.sum("n_leaves").over(upto)).withColumn("saved_upto", F.sum("saved").over(upto))
    ends = run.select(F.col("node").alias("last"), F.col("leaves_upto").alias("leaves_end"), F.col("saved_upto").alias("saved_end"))
    whole = run.join(ends, "last").withColumn("n_leaves", F.col("leaves_end") - F.col("leaves_upto") + F.col("n_leaves"))
    whole = whole.withColumn("saved", F.col("saved_end") - F.col("saved_upto") + F.col("saved"))
    hashed = parts.where(F.col("kind") == _IDS).select("node", "conv_id", "ends").repartition("node").sortWithinPartitions("node", "conv_id")
    hashed = hashed.mapInArrow(_hash_ids, "node int, ends string")
    return checkpoint(whole.join(hashed, "node", "left").withColumn("ends", F.coalesce("ends", F.lit(_NOTHING))).select(
        "node", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved", "ends"), "skeleton")


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's comma-joined ids from chunks in order."""
    node, state, out = None, None, []
    for batch in batches:
        for number, text in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
            if number == node:
                state.update(b"," + text.encode())
                continue
            if state is not None:
                out.append((node, state.hexdigest()))
            node, state = number, hashlib.sha256(text.encode())
    if state is not None:
        out.append((node, state.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.string()))], ["node", "ends"])


def trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the trie of the rebuilt conversations."""
    return nodes(rebuilt(checkpoint(original(conversations), "turns")), shard_turns)
