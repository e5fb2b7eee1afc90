"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Main path in DataFrame functions only.

1. Windows.  Every five-word stretch of a document is looked up among those of the benchmark.  A hit at word p
   of the document and q of an item proposes the window of the item's size that starts at p - q.  A window at
   the threshold shares at least one stretch with its item, so none is missed.
2. Fingerprints.  Windows and items get a 64-bit SimHash of their words.  It is cut into ``RADIUS`` + 1 blocks;
   two fingerprints within the radius agree on one block at least, so joining windows and items of one size on
   (size, block, value) finds every pair within the radius.
3. Verification.  The similarity is the weighted Jaccard index of the five-word shingles, weighted by their
   number of occurrences; pairs below the threshold go.

Words are runs of characters other than ASCII white space, in lower case.  The benchmark's stretches are sent to
the tasks in blocks of about ``BLOCK`` each, so a broadcast never grows with the benchmark; documents are never
shuffled to be searched, only those that hold a hit meet their windows again.

Edge cases: null and empty texts and items have no words and match nothing.  Items of fewer than five words are
looked up whole.  Texts of any length are searched whole.  A window that would reach over an end of the document
is cut there.  Null ids are kept; rows that repeat an id and a text give one result.  Items that share an id (or have
none) are compared one by one, and the best counts; texts with the same words are one.  Empty tables give an empty
result.  Other columns are not read; ``clean`` keeps those of the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examloom.functions.storage import checkpointed
from examloom.functions.text import let

SHINGLE = 5
RADIUS = 15
BITS = 64
THRESHOLD = 0.8
#: Benchmark stretches in one broadcast: 8 bytes each, about 40 MB as a hash table.
BLOCK = 1_000_000


def words(text: Column) -> Column:
    """Lower-case runs of characters other than ASCII white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _stretches(tokens: Column, size: int) -> Column:
    """Structs of ``size`` words, one for every place."""
    places = F.greatest(F.size(tokens) - (size - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(tokens, k + 1, places) for k in range(size)])


def _stretch_hash(row: str, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.col(f"{row}.{k}") for k in range(size)])


def _placed(frame: DataFrame, keys: list[str], size: int) -> DataFrame:
    """keys, pos and hash of every stretch; frame has keys and text."""
    rows = frame.select(*keys, F.posexplode(let(words(F.col("text")), lambda w: _stretches(w, size))).alias("pos", "z"))
    return rows.select(*keys, "pos", _stretch_hash("z", size).alias("hash"))


def fingerprint(tokens: Column) -> Column:
    """SimHash: bit b is set when more words have it set in their hash than not."""
    hashes = F.transform(tokens, lambda w: F.xxhash64(w))

    def bits(hs):
        def bit(b):
            votes = F.aggregate(hs, F.lit(0), lambda a, h: a + F.call_function("getbit", h, b).cast("int"))
            return F.when(votes * 2 > F.size(hs), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))

        return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), bit), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))

    return let(hashes, bits)


def hamming_blocks(print_: Column) -> Column:
    """(block, value) for the ``RADIUS`` + 1 blocks of a fingerprint, which cover all bits."""
    n = RADIUS + 1
    cuts = [BITS * k // n for k in range(n + 1)]
    return F.array(*[
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(print_, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value"))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:]))])


def _shingles(tokens: Column) -> Column:
    """Hashes of the five-word shingles; fewer words are one shingle."""
    zipped = F.transform(_stretches(tokens, SHINGLE), lambda z: F.xxhash64(F.lit(SHINGLE), *[z[str(k)] for k in range(SHINGLE)]))
    return F.when(F.size(tokens) < SHINGLE, F.array(F.xxhash64(tokens))).otherwise(zipped)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, similarity and start_word of the best window, for every document and item that match."""
    items = benchmark.select("item_id", "text", words(F.col("text")).alias("w")).where("size(w) > 0")
    # one id may have several texts; each is an item of its own until the best is taken
    items = items.withColumn("i_t", F.xxhash64("w")).dropDuplicates(["item_id", "i_t"])
    items = checkpointed(items.select("item_id", "i_t", "text", "w", F.size("w").alias("n"), fingerprint(F.col("w")).alias("print")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), "text").where("text is not null")
    short = [r[0] for r in items.where(f"n < {SHINGLE}").select("n").distinct().orderBy("n").collect()]  # at most four sizes
    found = None
    for size in [*short, SHINGLE]:
        own = items.where(f"n = {size}" if size < SHINGLE else f"n >= {SHINGLE}")
        places = checkpointed(_placed(own, ["item_id", "n"], size).withColumnRenamed("pos", "item_pos"))
        wanted = places.select("hash").distinct()
        blocks = max(1, -(-wanted.count() // BLOCK))
        for block in range(blocks):
            part = wanted.where(F.pmod("hash", F.lit(blocks)) == block)
            hits = _placed(rows, ["doc_id", "t"], size).join(F.broadcast(part), "hash", "left_semi")  # about BLOCK values
            windows = hits.join(places, "hash").select("doc_id", "t", "n", F.greatest(F.col("pos") - F.col("item_pos"), F.lit(0)).alias("start"))
            found = windows if found is None else found.union(windows)
    windows = checkpointed(found.distinct())
    per_doc = windows.groupBy("doc_id", "t").agg(F.collect_list(F.struct("start", "n")).alias("windows"))
    per_doc = per_doc.withColumnsRenamed({"doc_id": "w_id", "t": "w_t"})
    met = rows.join(per_doc, rows["doc_id"].eqNullSafe(per_doc["w_id"]) & (rows["t"] == per_doc["w_t"]))
    cut = met.select("doc_id", "t", F.explode(let(words(F.col("text")), lambda w: F.transform(
        "windows", lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"), F.slice(w, x["start"] + 1, x["n"]).alias("w"))))).alias("x"))
    cut = checkpointed(cut.select("doc_id", "t", "x.start", "x.n", "x.w").dropDuplicates(["doc_id", "t", "start", "n"]).select(
        "*", fingerprint(F.col("w")).alias("print")))
    window_blocks = cut.select("doc_id", "t", "start", "n", "print", F.inline(hamming_blocks(F.col("print"))))
    item_blocks = items.select("item_id", "i_t", "n", F.col("print").alias("item_print"), F.inline(hamming_blocks(F.col("print"))))
    near = window_blocks.join(item_blocks, ["n", "block", "value"]).where(
        F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS).select("doc_id", "t", "start", "n", "item_id", "i_t").distinct()
    # exact multiset similarity, as counts per (pair, shingle)
    pair = ["doc_id", "t", "start", "n", "item_id", "i_t"]
    same = cut.select(F.col("doc_id").alias("c_id"), F.col("t").alias("c_t"), F.col("start").alias("c_start"), F.col("n").alias("c_n"), "w")
    left = near.join(same, near["doc_id"].eqNullSafe(same["c_id"]) & (near["t"] == same["c_t"]) & (near["start"] == same["c_start"]) & (near["n"] == same["c_n"]))
    of_window = left.select(*pair, F.explode(_shingles(F.col("w"))).alias("s"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    own = items.select(F.col("item_id").alias("i_id"), F.col("w").alias("i_w"), F.col("i_t").alias("i_d"))
    right = near.join(own, near["item_id"].eqNullSafe(own["i_id"]) & (near["i_t"] == own["i_d"]))
    of_item = right.select(*pair, F.explode(_shingles(F.col("i_w"))).alias("s"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    counts = of_window.union(of_item).groupBy(*pair, "s").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    judged = counts.groupBy(*pair).agg((F.sum(F.least("a", "b")) / F.sum(F.greatest("a", "b"))).alias("similarity")).where(F.col("similarity") >= threshold)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s")))
    return judged.groupBy("doc_id", "item_id").agg(best.alias("best")).select(
        "doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.s")).alias("start_word"))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without a match, all their columns; rows that share an id share its fate."""
    bad = contaminated(docs, benchmark, threshold).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti")
