"""Conversation prefix trie: a row for each distinct beginning of a conversation, by shards of sorted paths.

A conversation's path is the sequence of digests of its turns. Conversations are range-partitioned in order of
(path, conv_id), so the members of a node, and of its whole subtree, are neighbours. A node whose members lie in more
than one shard is the beginning of a splitter path, since a splitter lies between two of its members. So the trie of
splitter paths, cut where a path is shared by the shards on both its sides, holds all nodes that no shard can finish:
the skeleton. What a shard needs of it are two depths: down to which its first path is shared with earlier shards, and
its last path with later ones. These are broadcast, two integers a shard.

A shard walks its sorted paths once with a stack and finishes all other nodes. For skeleton nodes it leaves partial
aggregates, which are combined by reduction. They add up because each node is counted where it comes first: a child, or
a member less one, in the first shard that has the node. Only whether a skeleton node is childless is known after the
reduction; such a node adds a leaf to itself and to the nodes above it, found by the shard in which it comes first.

Texts never move: a turn is its digest (md5 of role and text) and its length. Bounds: a task holds the paths and nodes
of one shard, and a conversation's path (32 characters a turn) is one row; ids of conversations that end in a skeleton
node move in pieces of ``PIECE`` ids and are hashed as a stream, in order. A conversation's turns must fit a task as
digests, its texts need not.

Nulls: null turns come first, null role or text is empty; rows without conv_id take no part. Turns with equal numbers
are ordered by role, then by digest; repeated rows are turns of their own. Empty texts count 0 bytes, texts of any
length are digested in place. No conversations, no nodes: an empty table gives an empty result. Extra columns, of any
name, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import written

#: Characters of a turn's digest in a path.
WIDTH = 32
#: A rebuilt conversation takes its first turns, fewer than ``HEADS``, from the first of its ``FAMILY``.
HEADS, FAMILY = 9, 5
#: Conversations of a shard, and the most shards.
SHARD, MOST_SHARDS = 20_000, 1 << 16
#: Ids of one piece of a skeleton node's list.
PIECE = 4096
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def own_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): for each conversation its turns in order, as digest and UTF-8 length."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", turn.alias("turn"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("turn")), lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) with the first h turns of each conversation taken from the first of its family of five;
    h is the unsigned crc32 of the decimal conv_id, modulo 9."""
    own = written(own_turns(conversations), "trie-own")
    heads = own.select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    keyed = own.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.expr("slice(turns, 1, 0)"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return keyed.join(heads, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, sizes) of (conv_id, turns)."""
    return conversations.select("conv_id", F.array_join(F.col("turns.digest"), "").alias("path"), F.col("turns.bytes").alias("sizes"))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, depth): turns that a shard's first path has in common with the last path before it."""
    for batch in batches:
        depths = []
        for a, b in zip(batch.column("before").to_pylist(), batch.column("first").to_pylist()):
            depths.append(common(a, b) if a is not None else -1)
        yield pa.record_batch([batch.column("shard"), pa.array(depths, pa.int64())], ["shard", "depth"])


def common(a: str, b: str) -> int:
    """Turns that two paths have in common."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * WIDTH] == b[: middle * WIDTH]:
            low = middle
        else:
            high = middle - 1
    return low


class _Node:
    """An open node of the walk: its turn's length, whether earlier shards have it, and what is known of its subtree."""

    __slots__ = ("children", "conv", "convs", "ends", "leaves", "old", "pending", "saved", "size")

    def __init__(self, size: int, old: bool):
        self.size, self.old = size, old
        self.conv, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.pending = [], []

    def join(self, conv: int) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)


#: kind 0: a finished node, ``parent`` names a skeleton parent; 1: a skeleton node's partial; 2: a piece of its ends.
SHARD_ROWS = f"kind int, shard long, key string, parent string, last boolean, piece long, ends string, {NODE}"
_TYPES = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string(), *[pa.int64()] * 7, pa.string()]
_NAMES = [c.split(" ")[0] for c in SHARD_ROWS.split(", ")]


def digest_of(ends: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()


class _Walk:
    """One walk over a shard's sorted paths. ``left``, ``right``: turns of its first and last path that other shards have."""

    def __init__(self, shard: int, first: str, left: int, right: int):
        self.shard, self.first, self.left, self.right = shard, first, left, right
        self.path, self.stack, self.rows = "", [], []

    def add(self, path: str, sizes: list[int], conv: int) -> None:
        same = common(self.path, path) if self.stack else -1
        while len(self.stack) > same + 1:
            self._close(False)
        known = min(self.left, common(self.first, path))
        for depth in range(len(self.stack), len(sizes) + 1):
            self.stack.append(_Node(sizes[depth - 1] if depth else 0, depth <= known))
        self.path = path
        top = self.stack[-1]
        top.convs += 1
        top.join(conv)
        top.ends.append(conv)

    def end(self) -> None:
        while self.stack:
            self._close(len(self.stack) - 1 <= self.right)

    def _key(self, depth: int) -> str:
        return f"{depth}:{hashlib.md5(self.path[: depth * WIDTH].encode()).hexdigest()}"

    def _close(self, last: bool) -> None:
        """Finishes the deepest open node; its row waits in its parent, whose least member is known when that closes."""
        depth, node = len(self.stack) - 1, self.stack.pop()
        saved = node.saved + (node.convs - (not node.old)) * node.size
        if node.old or last:
            own = self._key(depth)
            self.rows.append((1, self.shard, own, self._key(depth - 1) if depth else None, last, None, None, node.conv, depth, None, node.convs, node.children, node.leaves, saved, None))
            for i in range(0, len(node.ends), PIECE):
                self.rows.append((2, self.shard, own, None, None, i // PIECE, ",".join(map(str, node.ends[i : i + PIECE])), *[None] * 8))
            self.rows.extend((0, self.shard, None, own, None, None, None, *row) for row in node.pending)
        else:
            node.leaves += not node.children
            row = [node.conv, depth, None, node.convs, node.children, node.leaves, saved, digest_of(node.ends)]
            for child in node.pending:
                child[2] = node.conv
                self.rows.append((0, self.shard, None, None, None, None, None, *child))
            if self.stack:
                self.stack[-1].pending.append(row)
            else:
                self.rows.append((0, self.shard, None, None, None, None, None, *row))
        if self.stack:
            up = self.stack[-1]
            up.convs += node.convs
            up.children += not node.old
            up.leaves += node.leaves
            up.saved += saved
            up.join(node.conv)

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def _walked(depths: dict[int, tuple[int, int]]):
    """A function over rows sorted by shard, path and conv_id: the rows of each shard's walk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for batch in batches:
            for shard, path, sizes, conv in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "sizes", "conv_id"))):
                if walk is None or walk.shard != shard:
                    if walk is not None:
                        walk.end()
                        yield walk.taken()
                    walk = _Walk(shard, path, *depths[shard])
                walk.add(path, sizes, conv)
                if len(walk.rows) >= 8192:
                    yield walk.taken()
        if walk is not None:
            walk.end()
            yield walk.taken()

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) of pieces sorted by key and place: a running hash for each key."""
    key, running = None, None
    for batch in batches:
        done = []
        for now, piece in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if now != key:
                if key is not None:
                    done.append((key, running.hexdigest()))
                key, running = now, hashlib.sha256(piece.encode())
            else:
                running.update(b"," + piece.encode())
        if done:
            yield pa.record_batch([pa.array(c) for c in zip(*done)], ["key", "ends_sha256"])
    if key is not None:
        yield pa.record_batch([pa.array([key]), pa.array([running.hexdigest()])], ["key", "ends_sha256"])


def nodes(sequences: DataFrame, shard: int = SHARD) -> DataFrame:
    """A row (NODE) for each distinct beginning of the ``turns`` of (conv_id, turns); ``shard``: conversations of a shard."""
    rows = written(paths(sequences), "trie-paths")
    count = max(1, min(MOST_SHARDS, -(-rows.count() // shard)))
    shards = written(rows.repartitionByRange(count, "path", "conv_id").withColumn("shard", F.spark_partition_id().cast("long")), "trie-shards")
    # the skeleton: the trie of splitter paths, as the depth of each down to which both its neighbours have it
    edges = shards.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    edges = edges.select("shard", "first", F.lag("last").over(Window.orderBy("shard")).alias("before"))  # one row a shard
    left = {r.shard: r.depth for r in edges.mapInArrow(_shared, "shard long, depth long").collect()}
    order = sorted(left)
    depths = {s: (left[s], left[after] if after is not None else -1) for s, after in zip(order, [*order[1:], None])}

    sorted_paths = shards.repartition(count, "shard").sortWithinPartitions("shard", "path", "conv_id")
    found = written(sorted_paths.mapInArrow(_walked(depths), SHARD_ROWS), "trie-nodes")
    partial = found.where("kind = 1")
    totals = partial.groupBy("key").agg(F.sum("n_children").alias("n_children"), F.min("shard").alias("shard"), F.first("depth").alias("depth"))
    childless = totals.where("n_children = 0").select("shard", F.col("depth").alias("leaf_depth"))  # at most one a shard
    leaf = F.when(F.col("last") & (F.col("depth") <= F.col("leaf_depth")), 1).otherwise(0)
    sums = {c: F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")}
    reduced = partial.join(childless, "shard", "left").withColumn("n_leaves", F.col("n_leaves") + leaf).groupBy("key")
    reduced = reduced.agg(F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), *sums.values())
    pieces = found.where("kind = 2").select("key", "shard", "piece", "ends")
    hashes = pieces.repartition("key").sortWithinPartitions("key", "shard", "piece").mapInArrow(_hashed, "key string, ends_sha256 string")
    skeleton = reduced.join(hashes, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(digest_of([]))))
    skeleton = written(skeleton, "trie-skeleton")

    columns = [c.split(" ")[0] for c in NODE.split(", ")]
    upper = skeleton.select(F.col("key").alias("parent"), F.col("conv_id").alias("upper_conv"))
    below = found.where("kind = 0 AND parent IS NOT NULL").select("parent", *columns).unionByName(skeleton.select("parent", *(c if c != "parent_conv_id" else F.lit(None).cast("long").alias(c) for c in columns)))
    below = below.join(upper, "parent", "left").withColumn("parent_conv_id", F.col("upper_conv"))
    return found.where("kind = 0 AND parent IS NULL").select(columns).unionByName(below.select(columns))


def prefix_trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """The trie's nodes (NODE) of all rebuilt conversations."""
    return nodes(rebuilt(conversations), shard)
