"""Prefix trie of conversations, built from range-partitioned paths with a skeleton of splitters.

A conversation becomes a path: 16 bytes of SHA-256 per turn, so that conversations with a common beginning have
paths with a common beginning.  Texts stay behind; a turn keeps its digest and its length.

1. Paths are dealt by ranges of (path, conversation) and sorted: a shard holds a run of the sorted order, and equal
   paths may be cut between shards, so that a conversation that very many share is no hot group.
2. The splitters, the last path of a shard and the first of the next, form a trie: the skeleton.  It is broadcast
   by what codes it beside the sorted paths, the depth to which neighbours at a cut agree: two integers a shard.
   A node is in the skeleton if a cut passes through it.
3. Every shard walks its run once with a stack.  Nodes outside the skeleton lie in one shard and are finished there.
   Of a skeleton node each shard gives what it saw.
4. Partial skeleton nodes are added up by node.  All parts are plain sums or minima: a child is counted in the shard
   where it begins, a childless node where it ends, and the one member that costs nothing where the node begins.
   Members that end at a skeleton node are written in short pieces and hashed in their order, piece by piece.

A shard holds its own run only; a walk holds one path and, until their parent ends, the children of open nodes.
A conversation's path is one value of a row (20 bytes a turn), which bounds a conversation to some 80 million turns.

Edge cases: a null role or text is empty; null turns come first; turns that tie follow by role, then by digest, and
repeated rows are turns of their own.  Rows without a conversation id belong to no conversation.  A conversation
may be left without turns; it is a member of the root that ends there.  Texts of any length are digested whole.  An
empty table has no node.  Further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examloom.functions.storage import checkpointed, scratch_folder

WIDTH = 16
#: Characters of a piece of the members that end at a skeleton node.
PIECE = 4096

_TURNS = "array<struct<digest:binary,size:bigint>>"
_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
#: kind: node (finished), below (finished, parent in the skeleton), part (of a skeleton node), ends (a piece)
_SEEN = f"kind string, shard int, {_NODE}, node binary, parent binary, piece int, ends string"
_FIELDS = [f.split()[0] for f in _SEEN.split(", ")]
_TYPES = [{"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[f.split()[1]] for f in _SEEN.split(", ")]


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, each as digest and code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    framed = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.unhex(F.sha2(framed, 256)), 1, WIDTH)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.struct("turn", role.alias("role"), digest.alias("digest"), F.length(text).cast("bigint").alias("size")).alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def rebuilt(conversations: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """Every conversation with its first turns taken from conversation c - c % every: crc32(c) % (most + 1) of them."""
    turns = turns_of(conversations)
    first = F.col("conv_id") - F.col("conv_id") % every
    heads = turns.where(F.col("conv_id") == first).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    both = turns.withColumn("base", first).join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast(_TURNS)), F.lit(1), h)
    own = F.when(F.size("turns") > h, F.slice("turns", h + 1, F.size("turns"))).otherwise(F.array().cast(_TURNS))
    return both.select("conv_id", F.concat(head, own).alias("turns"))


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(np.argmax(differ)) // WIDTH


def _agreement(batches):
    for batch in batches:
        out = [-1 if a is None or b is None else _common(a, b) for a, b in zip(batch.column("ahead").to_pylist(), batch.column("first").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(out, pa.int32())], ["shard", "agree"])


def skeleton(paths: DataFrame) -> DataFrame:
    """shard, before, after: to which depth the run agrees with the run ahead and the run behind (-1: none there).

    One row per shard that holds rows, so its size is that of the partitioning, not of the data.
    """
    ends = checkpointed(paths.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last")))
    order = Window.orderBy("shard")  # shards only
    near = ends.select("shard", F.lag("shard").over(order).alias("near"))
    pairs = ends.select("shard", "first").join(near, "shard").join(ends.select(F.col("shard").alias("near"), F.col("last").alias("ahead")), "near", "left")
    agree = checkpointed(pairs.select("shard", "first", "ahead").mapInArrow(_agreement, "shard int, agree int"))
    return agree.select("shard", F.col("agree").alias("before"), F.coalesce(F.lead("agree").over(order), F.lit(-1)).alias("after"))


class _Open:
    """A node on the stack of a walk."""

    __slots__ = ("depth", "size", "goes_on", "conv", "convs", "children", "inner", "leaves", "saved", "ends", "waiting")

    def __init__(self, depth: int, size: int, goes_on: bool):
        self.depth, self.size, self.goes_on = depth, size, goes_on
        self.conv, self.inner = None, False
        self.convs = self.children = self.leaves = self.saved = 0
        self.ends: list[str] = []
        self.waiting: list[tuple] = []  # finished children, until the smallest member of this node is known


def _names(path: bytes, depth: int) -> list[bytes]:
    """Digests of the beginnings of a path, from the root to ``depth``."""
    running = hashlib.sha256()
    out = [running.digest()[:WIDTH]]
    for d in range(depth):
        running.update(path[d * WIDTH : (d + 1) * WIDTH])
        out.append(running.digest()[:WIDTH])
    return out


def _pieces(ends: list[str]) -> list[str]:
    out, size, some = [], 0, []
    for end in ends:
        if size + len(end) >= PIECE and some:
            out.append(",".join(some))
            size, some = 0, []
        some.append(end)
        size += len(end) + 1
    return [*out, ",".join(some)] if some else out


class _Walk:
    """One shard: rows in order of (path, conv_id) in, finished nodes and parts of skeleton nodes out."""

    def __init__(self, shard: int, before: int, after: int, first: bytes):
        self.shard, self.after = shard, after
        self.first_names = _names(first, max(before, 0))
        self.stack = [_Open(0, 0, before >= 0)]
        self.before, self.path = before, None
        self.out: list[tuple] = []

    def row(self, conv: int, path: bytes, sizes: np.ndarray) -> None:
        """A conversation; its path agrees with the one ahead as far as the stack stays."""
        alike = 0 if self.path is None else _common(self.path, path)
        while len(self.stack) - 1 > alike:
            self.close()
        for d in range(len(self.stack), len(path) // WIDTH + 1):
            goes_on = self.path is None and d <= self.before
            self.stack[-1].inner = True
            self.stack[-1].children += not goes_on
            self.stack.append(_Open(d, int(sizes[d - 1]), goes_on))
        node = self.stack[-1]
        node.convs += 1
        node.conv = conv if node.conv is None else min(node.conv, conv)
        node.ends.append(str(conv))
        self.path = path

    def close(self, names: list[bytes] | None = None) -> None:
        """Take the deepest node off the stack; with ``names`` the next shard goes on with it."""
        node = self.stack.pop()
        node.leaves += names is None and not node.inner  # members that end here come ahead of all children
        node.saved += node.size * (node.convs - (not node.goes_on))
        if self.stack:
            above = self.stack[-1]
            above.convs += node.convs
            above.leaves += node.leaves
            above.saved += node.saved
            above.conv = node.conv if above.conv is None else min(above.conv, node.conv)
        sums = (node.convs, node.children, node.leaves, node.saved)
        if names or node.goes_on or not node.depth:
            names = names or self.first_names
            name, parent = names[node.depth], names[node.depth - 1] if node.depth else None
            self.out.append(("part", node.conv, node.depth, None, *sums, None, name, parent, None, None))
            self.out += [("ends", None, node.depth, *[None] * 6, name, None, k, text) for k, text in enumerate(_pieces(node.ends))]
            self.out += [("below", *w[:2], None, *w[2:], None, name, None, None) for w in node.waiting]
        else:
            above.waiting.append((node.conv, node.depth, *sums, hashlib.sha256(",".join(node.ends).encode()).hexdigest()))
            self.out += [("node", *w[:2], node.conv, *w[2:], None, None, None, None) for w in node.waiting]

    def finish(self) -> None:
        """The run ends; what the next run goes on with stays open."""
        names = _names(self.path, max(self.after, 0))
        while self.stack:
            self.close(names if self.stack[-1].depth <= self.after else None)

    def flush(self) -> pa.RecordBatch:
        columns = list(zip(*self.out)) if self.out else [()] * (len(_FIELDS) - 1)
        rows, self.out = len(self.out), []
        columns.insert(1, (self.shard,) * rows)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _FIELDS)


def _walks(batches):
    walk = None
    for batch in batches:
        sizes = batch.column("sizes")
        for k in range(len(batch)):
            path = batch.column("path")[k].as_buffer().to_pybytes()
            if walk is None:
                walk = _Walk(*(batch.column(c)[k].as_py() for c in ("shard", "before", "after")), path)
            walk.row(batch.column("conv_id")[k].as_py(), path, sizes[k].values.to_numpy(zero_copy_only=False))
            if len(walk.out) >= 4096:
                yield walk.flush()
    if walk is not None:
        walk.finish()
        yield walk.flush()


def _hashed(batches):
    """node and the digest of its pieces, which come in order."""
    node, running, got = None, None, []
    for batch in batches:
        for name, text in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
            if name != node:
                if node is not None:
                    got.append((node, running.hexdigest()))
                node, running = name, hashlib.sha256()
            else:
                running.update(b",")
            running.update(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.string())], ["node", "sha"])
        got = []
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([running.hexdigest()], pa.string())], ["node", "sha"])


def _flat(batches):
    """Turns as one binary path; all digests are equally wide, so that their buffer is the path."""
    for batch in batches:
        digests = batch.column("digests")
        offsets = digests.offsets.to_numpy().astype(np.int64)
        inside = digests.flatten()
        raw = b"".join(inside.to_pylist())
        cuts = pa.py_buffer(((offsets - offsets[0]) * WIDTH).astype(np.int32).tobytes())
        paths = pa.Array.from_buffers(pa.binary(), len(batch), [None, cuts, pa.py_buffer(raw)])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), paths, batch.column("sizes")], ["conv_id", "path", "sizes"])


def trie(paths: DataFrame) -> DataFrame:
    """All nodes of the trie over ``paths`` (conv_id, and turns as array of digest and size)."""
    spark = paths.sparkSession
    place = scratch_folder(spark, "trie")
    flat = paths.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.size").alias("sizes"))
    flat.mapInArrow(_flat, "conv_id bigint, path binary, sizes array<bigint>").write.parquet(f"{place}/paths")
    order = ["path", "conv_id"]
    dealt = spark.read.parquet(f"{place}/paths").repartitionByRange(*order).sortWithinPartitions(*order)
    runs = checkpointed(dealt.withColumn("shard", F.spark_partition_id()))
    runs.join(F.broadcast(skeleton(runs)), "shard").mapInArrow(_walks, _SEEN).write.parquet(f"{place}/seen")
    seen = spark.read.parquet(f"{place}/seen")

    total = lambda *names: [F.sum(n).alias(n) for n in names]
    parts = seen.where("kind = 'part'").groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"),
        *total("n_convs", "n_children", "n_leaves", "saved_tokens"))
    ends = seen.where("kind = 'ends'").select("node", "shard", "piece", "ends").repartition("node").sortWithinPartitions("node", "shard", "piece")
    named = parts.join(ends.mapInArrow(_hashed, "node binary, sha string"), "node", "left")
    named.withColumn("ends_sha256", F.coalesce("sha", F.sha2(F.lit(""), 256))).drop("sha").write.parquet(f"{place}/skeleton")
    found = spark.read.parquet(f"{place}/skeleton")

    out = [f.split()[0] for f in _NODE.split(", ")]
    above = found.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = seen.where("kind = 'below'").drop("parent_conv_id").join(above, "parent")
    return seen.where("kind = 'node'").select(*out).unionByName(below.select(*out)).unionByName(found.join(above, "parent", "left").select(*out))
