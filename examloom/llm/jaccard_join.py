"""Near-duplicate join: Jaccard similarity of five-word shingles, with Bayesian pruning of candidates.

1. Documents with the same text are one class; it is known by a digest of the text and worked on once.
2. Every text gets a MinHash signature.  Texts that agree on a band of ``PER_BAND`` values share a bucket; the
   texts linked through buckets form candidate groups.  A pair at the threshold shares no bucket with a
   probability below 1e-4, a pair at 0.9 below 1e-11.
3. Inside a group pairs are compared on their signatures, ``STEP`` values at a time.  With a uniform prior on
   the similarity, m agreements among n values leave a posterior P(similarity >= threshold) of
   P(Binomial(n + 1, threshold) <= m).  A pair whose posterior falls below ``TOLERANCE`` is dropped.
4. What is left is verified exactly on the shingle sets.

A group is cut into blocks of about ``BLOCK`` texts, and every pair of blocks is a piece of work of its own, so a
group of any size spreads over tasks.  A piece of work returns counts and one link per text to the first text
it is connected with, never the pairs.

Edge cases: a null text is empty.  A text of fewer than five words is one shingle; a text without words is
similar to nothing but its copies.  Texts of any length are taken whole.  Null ids are kept and sort last;
repeated ids are rows of their own.  An empty table gives an empty result.  Other columns are not read by
``similar``; ``keep_one`` keeps them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examloom.functions.storage import checkpointed
from examloom.llm.bytes import mixed, pieces, shingle_hashes
from examloom.llm.components import connected

THRESHOLD = 0.8
BANDS, PER_BAND = 40, 7
SIGNATURE = BANDS * PER_BAND
STEP = 40
TOLERANCE = 1e-6
BLOCK = 256
#: Shingles of a block of texts, about; long texts make smaller blocks.
BLOCK_SHINGLES = 1_000_000

_rng = np.random.default_rng(5)
_FACTORS = _rng.integers(0, 1 << 32, SIGNATURE, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, SIGNATURE, dtype=np.uint32)


def text_key(text: Column) -> Column:
    """The class of a text: the first 16 bytes of its SHA-256."""
    return F.substring(F.unhex(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)), 1, 16)


def shingle_sets(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row."""
    hashes, rows = shingle_hashes(data, starts)
    bounds = np.searchsorted(rows, np.arange(len(starts)))
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a shingle set."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(SIGNATURE, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(out, (low[at : at + 512, None] * _FACTORS + _SHIFTS).min(axis=0), out=out)
    return out


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    """One hash per band and text."""
    parts = signatures.reshape(len(signatures), BANDS, PER_BAND).astype(np.uint64)
    total = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(PER_BAND):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return total


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, _, data, starts in pieces(batch.column("text")):
            sets = shingle_sets(data, starts)
            rows = [i for i, s in enumerate(sets) if len(s)]
            if not rows:
                continue
            bands = band_hashes(np.array([signature(sets[i]) for i in rows])).view(np.int64)
            keys = batch.column("key").take(pa.array([first + i for i in rows]))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array([len(sets[i]) for i in rows], pa.int32()), pa.array(list(bands), pa.list_(pa.int64()))], ["key", "n", "bands"])


def _with_sets(batches):
    for batch in batches:
        rest = [c for c in batch.schema.names if c != "text"]
        for first, end, data, starts in pieces(batch.column("text")):
            sets = shingle_sets(data, starts)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(first, end - first) for c in rest), pa.array([s.tobytes() for s in sets], pa.binary())], [*rest, "shingles"])


def least_agreements(threshold: float, tolerance: float) -> dict[int, int]:
    """Per number of compared values the least agreements that keep a pair."""
    out = {}
    for n in range(STEP, SIGNATURE + 1, STEP):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def surviving(signatures: np.ndarray, left: np.ndarray, right: np.ndarray, ordered: bool, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of ``left`` and ``right`` that no step of the comparison drops; ``ordered``: right after left."""
    pairs = []
    for at in range(0, len(left), 32):
        rows = left[at : at + 32]
        agree = (signatures[rows][:, None, :STEP] == signatures[right][None, :, :STEP]).sum(axis=2)
        i, j = np.nonzero(agree >= least[STEP])
        n = agree[i, j]
        i, j = rows[i], right[j]
        if ordered:
            i, j, n = i[j > i], j[j > i], n[j > i]
        for end in range(2 * STEP, SIGNATURE + 1, STEP):
            for k in range(0, len(i), 65536):  # bounded temporary arrays
                part = slice(k, k + 65536)
                n[part] += (signatures[i[part], end - STEP : end] == signatures[j[part], end - STEP : end]).sum(axis=1)
            keep = n >= least[end]
            i, j, n = i[keep], j[keep], n[keep]
        pairs.append((i, j))
    return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold, from the whole shingle sets."""
    sizes = np.array([len(s) for s in sets])
    if len(i) > 2 * len(sets):  # many pairs: all intersections from products of membership tables
        values, place = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        shared = np.bincount(place) > 1
        column = np.cumsum(shared) - 1
        owner, place = owner[shared[place]], column[place[shared[place]]]
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        common = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, int(shared.sum()), 2048):
            a, b = np.searchsorted(place, [at, at + 2048])
            table = np.zeros((len(sets), 2048), np.float32)
            table[owner[a:b], place[a:b] - at] = 1
            common += table @ table.T
        both = common[i, j].astype(np.int64)
    else:
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    return both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Per row the smallest row connected with it."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


_COMPARED = "key binary, root binary, texts bigint, docs bigint"


def _comparing(threshold: float, tolerance: float):
    least = least_agreements(threshold, tolerance)

    def work(rows: list[dict]):
        sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
        signatures = np.array([signature(s) for s in sets])
        block = np.array([r["block"] for r in rows])
        first, second = rows[0]["low"], rows[0]["high"]
        left = np.flatnonzero(block == first)
        right = left if first == second else np.flatnonzero(block == second)
        if not len(left) or not len(right):
            return None
        i, j = surviving(signatures, left, right, first == second, least)
        ok = verified(sets, i, j, threshold) if len(i) else np.zeros(0, bool)
        i, j = i[ok], j[ok]
        if not len(i):
            return None
        copies = np.array([r["copies"] for r in rows])
        texts = np.bincount(i, minlength=len(rows)) + np.bincount(j, minlength=len(rows))
        docs = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
        root, on = _roots(len(rows), i, j), np.flatnonzero(texts)
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[k]["key"] for k in on], pa.binary()), pa.array([rows[root[k]]["key"] for k in on], pa.binary()),
             pa.array(texts[on], pa.int64()), pa.array(docs[on].astype(np.int64), pa.int64())], ["key", "root", "texts", "docs"])

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and any(row[c] != held[0][c] for c in ("label", "low", "high")):
                    if (out := work(held)) is not None:
                        yield out
                    held = []
                held.append(row)
        if held and (out := work(held)) is not None:
            yield out

    return run


def classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """Documents as (doc_id, key), and per key: class_id, n_text_links, linked docs, copies, kept_id, kept_key."""
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    copies = keyed.groupBy("key").agg(F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id")).alias("first"))
    banded = keyed.select("key", "text").mapInArrow(_band_rows, "key binary, n int, bands array<bigint>")
    buckets = checkpointed(banded.select("key", "n", F.explode("bands").alias("band")).groupBy("band", "key").agg(F.first("n").alias("n")))
    leaders = buckets.groupBy("band").agg(F.min("key").alias("leader"), F.max("key").alias("last")).where("leader < last")
    # at most BANDS leaders per text; its smallest leader stands for it, and ties the others together
    led = checkpointed(buckets.join(leaders, "band").groupBy("key").agg(
        F.min("leader").alias("least"), F.collect_set("leader").alias("leaders"), F.first("n").alias("n")))
    ties = led.select(F.explode("leaders").alias("a"), F.col("least").alias("b")).distinct()
    groups = connected(ties.union(led.select("key", "least")))
    members = groups.join(led.select(F.col("key").alias("node"), "n"), "node", "left")
    sizes = members.groupBy("label").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = members.join(sizes, "label").select(F.col("node").alias("key"), "label", "blocks")
    members = members.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    texts = keyed.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    rows = members.join(texts, "key").mapInArrow(_with_sets, "key binary, label binary, blocks int, block int, copies bigint, shingles binary")
    spread = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "key", "label", "block", "copies", "shingles", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    work = ["label", "low", "high"]
    compared = checkpointed(spread.repartition(*work).sortWithinPartitions(*work).mapInArrow(_comparing(threshold, tolerance), _COMPARED))
    linked = compared.groupBy("key").agg(F.sum("texts").alias("n_text_links"), F.sum("docs").alias("docs"))
    similar_groups = connected(compared.select(F.col("key").alias("a"), F.col("root").alias("b")))
    per_key = copies.join(linked, "key", "left").join(similar_groups.withColumnRenamed("node", "key"), "key", "left")
    per_key = checkpointed(per_key.select(
        "key", "copies", "first", F.coalesce("n_text_links", F.lit(0).cast("bigint")).alias("n_text_links"),
        F.coalesce("docs", F.lit(0).cast("bigint")).alias("docs"), F.coalesce("label", "key").alias("label")))
    kept = per_key.groupBy("label").agg(F.min(F.struct("first.n", "first.doc_id", "key")).alias("kept"))
    return keyed.select("doc_id", "key"), per_key.join(kept, "label").select(
        "key", F.col("kept.doc_id").alias("class_id"), "n_text_links", "docs", "copies", F.col("kept.key").alias("kept_key"))


def similar(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, class_id, n_links, n_text_links for every document.

    ``class_id`` is the smallest id connected with the document by links or copies; ``n_links`` counts the other
    documents at or above the threshold, copies included, ``n_text_links`` the other texts.
    """
    rows, found = classes(docs, threshold, tolerance)
    return rows.join(found, "key").select(
        "doc_id", "class_id", (F.col("docs") + F.col("copies") - 1).alias("n_links"), "n_text_links")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """All columns of ``docs``; of every class the document with the smallest id stays, once."""
    _, found = classes(docs, threshold, tolerance)
    kept = found.where("key = kept_key").select(F.col("kept_key").alias("_key"), F.col("class_id").alias("_kept"))
    keyed = docs.withColumn("_key", text_key(F.col("text")))
    same = (keyed["_key"] == kept["_key"]) & keyed["doc_id"].eqNullSafe(kept["_kept"])
    return keyed.join(kept, same).drop(kept["_key"]).dropDuplicates(["_key", "doc_id"]).select(*docs.columns)
