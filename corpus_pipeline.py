"""The corpus pipeline: documents in, token ids out, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns the columns of
``documents``; the last one returns token ids instead of texts.  Null and repeated ids, null and empty texts,
empty tables and further columns go through every stage as its operator says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examloom.functions.storage import scratch_folder
from examloom.llm import bpe, decontaminate, jaccard_join, quality_classifier, secrets

#: Documents with a lower score go.
LEAST_SCORE = 0.3
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    scored = quality_classifier.scored(docs, _table(spark, sf_dir, "labels"))
    return scored.where(F.col("quality_score") >= LEAST_SCORE).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes."""
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text (unsigned 32-bit little-endian), their number, and the digest of what they decode to."""
    found = bpe.round_trip(docs, bpe.read_vocabulary(VOCABULARY))
    return found.withColumn("n_tokens", (F.length("ids") / 4).cast("bigint")).withColumn(
        "decoded_sha256", F.sha2(F.encode("decoded", "UTF-8"), 256)).drop("decoded")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("BPE encoding and decoding", tokens),
]

#: No SQL expresses the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        place = scratch_folder(spark, f"pipeline-{k}")
        out.write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
