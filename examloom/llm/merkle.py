"""Merkle manifest of a table: a content-addressed DAG, and proofs by descent from the root.

A manifest is a folder of tables:

* ``leaves``: group, rank inside the group, group size, digest of the row, and whatever columns are carried along;
* ``nodes``: per height the digest of every node with the digests of its children, in order;
* ``subroots`` and ``top``: the subtree of every group, and the tree over the subroots.

A row's digest covers the listed fields, each as ``-`` if null, else its UTF-8 length, ``:`` and the value.
Leaves of a group ascend by key; while a level has several nodes, every ``FANOUT`` consecutive ones become their
digest (a last run may be shorter).  Subroots, ordered by group (null first, then bytewise), give the root likewise.

A proof starts at the root.  The rank of a leaf, written to the base ``FANOUT``, says which child to take; the
record of a digest is found by a join on the digest, its other children are one segment of the proof, and the
segments are reversed at the end.  Requests that share the first digits of their ranks travel as one row, so a
level costs as many rows as it has asked-for nodes, and only the last step meets the leaves.  No group of rows is
larger than ``FANOUT``, whatever a group of leaves holds; ranks are counted by ranges.

Edge cases: nulls in any field are part of the digest; a null key comes first, a null group is a group.  Rows that
repeat a key are leaves of their own, ordered by digest.  Texts of any length are read whole.  A group of one row
is its own subroot, a single group its own root, and a proof may be empty.  An empty table has no leaves and no
root, and gives an empty result.  Only the named columns are read, so that further columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from examloom.functions.ranking import split_row_number
from examloom.functions.storage import scratch_folder

FANOUT = 8
#: Powers of the fan-out that a 64-bit count can exceed.
_POWERS = [FANOUT**k for k in range(21)]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def row_digest(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields, each with its length."""
    framed = []
    for field in fields:
        text = field.cast("string")
        framed.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*framed), 256)


def ascii_lower(text: Column) -> Column:
    """The text with A-Z, and nothing else, in lower case."""
    return F.translate(text, _UPPER, _LOWER)


def _depth(n: Column) -> Column:
    """Levels above the leaves of a tree with ``n`` leaves."""
    return F.size(F.filter(F.array(*[F.lit(p).cast("bigint") for p in _POWERS]), lambda p: p < n))


def _grow(spark: SparkSession, level: DataFrame, depth: int, folder: str) -> DataFrame:
    """Write the nodes above ``level`` (tree, idx, n, digest), one table per height; returns tree, digest of the roots."""
    roots = level.where("n = 1").select("tree", "digest")
    for height in range(1, depth + 1):
        runs = level.where("n > 1").groupBy("tree", "n", F.expr(f"idx div {FANOUT}").alias("up")).agg(
            F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"))
        nodes = runs.select(
            "tree", F.col("up").alias("idx"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), F.col("run.digest").alias("children"))
        nodes.withColumn("digest", F.sha2(F.array_join("children", ""), 256)).write.parquet(f"{folder}/height={height}")
        level = spark.read.parquet(f"{folder}/height={height}")
        roots = roots.unionByName(level.where("n = 1").select("tree", "digest"))
    return roots


@dataclass
class Manifest:
    """A written manifest; ``depth`` and ``top_depth`` are the most levels of a group and those above the groups."""

    spark: SparkSession
    folder: str
    depth: int
    top_depth: int

    def leaves(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/leaves")

    def root(self) -> DataFrame:
        """One row with the root (none for an empty table)."""
        return self.spark.read.parquet(f"{self.folder}/root")

    def _asks(self, requests: DataFrame, depth: int) -> dict[int, DataFrame]:
        """Per height the nodes that requests (tree, idx, asked) go through, with the digits asked below them."""
        place = scratch_folder(self.spark, "asks")
        digit = (F.col("idx") % FANOUT).cast("int")
        up = F.expr(f"idx div {FANOUT}").alias("idx")
        requests.groupBy("tree", up).agg(F.collect_list(F.struct(digit.alias("digit"), "asked")).alias("asks")).write.parquet(f"{place}/height=1")
        out = {1: self.spark.read.parquet(f"{place}/height=1")}
        for height in range(2, depth + 1):
            out[height - 1].groupBy("tree", up).agg(F.collect_set(digit).alias("digits")).write.parquet(f"{place}/height={height}")
            out[height] = self.spark.read.parquet(f"{place}/height={height}")
        return out

    def _records(self, name: str, height: int) -> DataFrame:
        """Digest to children; equal subtrees are one record."""
        nodes = self.spark.read.parquet(f"{self.folder}/{name}/height={height}")
        return nodes.groupBy("digest").agg(F.first("children").alias("children"))

    def _descend(self, starts: DataFrame, requests: DataFrame, depth: int, name: str, kept: list[str]) -> DataFrame:
        """From the roots in ``starts`` (tree, n, digest, path, kept) down to the requests; gives asked, digest, path, kept.

        Segments are appended on the way, so the path runs from the root to the leaf.
        """
        asks = self._asks(requests, depth)
        starts = starts.withColumn("depth", _depth(F.col("n"))).withColumn("idx", F.lit(0).cast("bigint"))
        fixed = ["tree", "idx", "digest", "path", *kept]
        below = None
        for height in range(depth, 0, -1):
            here = starts.where(F.col("depth") == height).select(*fixed)
            here = here if below is None else below.unionByName(here)
            digits = F.explode("asks").alias("ask") if height == 1 else F.explode("digits").alias("digit")
            met = here.join(self._records(name, height), "digest").join(asks[height], ["tree", "idx"])
            met = met.select(*fixed, "children", digits)
            if height == 1:
                met = met.select(*fixed, "children", "ask.digit", "ask.asked")
            left = F.array_join(F.slice("children", F.lit(1), F.col("digit")), "")
            right = F.array_join(F.slice("children", F.col("digit") + 2, F.lit(FANOUT)), "")
            below = met.select(
                "tree", (F.col("idx") * FANOUT + F.col("digit")).alias("idx"), F.element_at("children", F.col("digit") + 1).alias("digest"),
                F.concat("path", F.array(F.struct(left.alias("left"), right.alias("right")))).alias("path"), *kept, *(["asked"] if height == 1 else []))
        out = ["asked", "digest", "path", *kept]
        alone = starts.where("depth = 0").join(asks[1], ["tree", "idx"]).select(*fixed, F.explode("asks.asked").alias("asked")).select(*out)
        return alone if below is None else below.select(*out).unionByName(alone)

    def prove(self, requests: DataFrame | None = None) -> DataFrame:
        """The proof of every requested leaf (rows of ``leaves()``; default: all).

        Gives the columns of the leaves, ``subroot``, ``root``, ``path`` (segments from the leaf to the root, each
        the digests left and right of the way) and ``found``, the leaf digest at the end of the way.
        """
        requests = self.leaves() if requests is None else requests
        given = requests.columns
        groups = self.spark.read.parquet(f"{self.folder}/subroots")
        empty = F.array().cast("array<struct<left:string,right:string>>")
        top = self.root().select(F.lit("").alias("tree"), "n", F.col("root").alias("digest"), empty.alias("path"), "root")
        wanted = groups.join(requests.select("tree").distinct(), "tree", "left_semi")
        down = self._descend(
            top, wanted.select(F.lit("").alias("tree"), "idx", F.struct("tree", "n").alias("asked")), self.top_depth, "top", ["root"])
        starts = down.select("asked.tree", "asked.n", "digest", "path", "root", F.col("digest").alias("subroot"))
        asked = requests.select("tree", F.col("rank").alias("idx"), F.struct(*given).alias("asked"))
        found = self._descend(starts, asked, self.depth, "nodes", ["root", "subroot"])
        return found.select("asked.*", "subroot", "root", F.reverse("path").alias("path"), F.col("digest").alias("found"))


def write_manifest(
    docs: DataFrame, folder: str, fields: list[str], key: str, group: str, carried: dict[str, Column] | None = None
) -> Manifest:
    """Write the manifest of ``docs``; ``carried`` columns stay with the leaves and are no part of a digest."""
    spark = docs.sparkSession
    name = F.col(group).cast("string")
    # a name that is never null, with null before all others
    tree = F.when(name.isNull(), "-").otherwise(F.concat(F.lit("="), name))
    rows = docs.select(
        F.col(key).alias("key"), tree.alias("tree"), row_digest(*[F.col(f) for f in fields]).alias("leaf"),
        *[c.alias(n) for n, c in (carried or {}).items()])
    rows.write.parquet(f"{folder}/rows")  # texts are read once
    rows = spark.read.parquet(f"{folder}/rows")
    sizes = rows.groupBy("tree").agg(F.count("*").alias("n"))
    ranked = split_row_number(rows, ["tree"], ["key", "leaf"], "rank").withColumn("rank", F.col("rank") - 1)
    ranked.join(sizes, "tree").write.parquet(f"{folder}/leaves")
    leaves = spark.read.parquet(f"{folder}/leaves")
    deepest = lambda frame: frame.agg(F.max(_depth(F.col("n")))).first()[0] or 0
    depth = deepest(leaves.select("n"))
    roots = _grow(spark, leaves.select("tree", F.col("rank").alias("idx"), "n", F.col("leaf").alias("digest")), depth, f"{folder}/nodes")

    order = split_row_number(roots.withColumn("one", F.lit("")), ["one"], ["tree"], "rank")
    listed = order.select("tree", (F.col("rank") - 1).alias("idx"), "digest").join(sizes, "tree")
    listed.write.parquet(f"{folder}/subroots")
    groups = spark.read.parquet(f"{folder}/subroots")
    n = groups.count()
    level = groups.select(F.lit("").alias("tree"), "idx", F.lit(n).cast("bigint").alias("n"), "digest")
    top_depth = deepest(level.select("n").limit(1))
    root = _grow(spark, level, top_depth, f"{folder}/top")
    root.select(F.lit(n).cast("bigint").alias("n"), F.col("digest").alias("root")).write.parquet(f"{folder}/root")
    return Manifest(spark, folder, depth, top_depth)


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and the segments of its proof give."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all digests of a proof, one after another."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)
