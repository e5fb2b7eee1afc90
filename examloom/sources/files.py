"""Inventories of stored files and images."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def size_text(size) -> Column:
    """Bytes as B, KB, MB or GB with one decimal, ties to the even digit."""
    kb = 1024.0
    return (
        F.when(size < kb, F.format_string("%d B", size))
        .when(size < kb**2, F.format_string("%.1f KB", F.bround(size / kb, 1)))
        .when(size < kb**3, F.format_string("%.1f MB", F.bround(size / kb**2, 1)))
        .otherwise(F.format_string("%.1f GB", F.bround(size / kb**3, 1)))
    )


def write_files(files: DataFrame, root: str) -> int:
    """Store ``content`` (binary) of every row as the file ``path`` under ``root``, a folder that executors share.

    Tasks write their own rows; one that is repeated writes the same files again.  Of rows with one path any may
    stay.  Returns how many rows were written.
    """
    def store(batches):
        from pyarrow import fs

        if root.startswith("/"):
            system, base = fs.LocalFileSystem(), root
        else:
            system, base = fs.FileSystem.from_uri(root.replace("file:/", "file:///", 1) if root.startswith("file:/") and not root.startswith("file://") else root)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                place = f"{base.rstrip('/')}/{path}"
                system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(place) as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])

    rows = files.select("path", "content").mapInArrow(store, "n bigint")
    return rows.agg({"n": "sum"}).first()[0] or 0


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Files under subject/grade folders, newest first.  Contents are not read."""
    path = F.try_url_decode(F.col("path"))
    return (
        _files(spark, root)
        .select(
            F.regexp_extract(path, r"/([^/]+)/[^/]+/[^/]+$", 1).alias("subject"),
            F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1).alias("grade"),
            F.regexp_extract(path, r"/([^/]+)$", 1).alias("filename"),
            F.col("length").alias("size"),
            size_text(F.col("length")).alias("size_text"),
            F.col("modificationTime").alias("modified_at"),
        )
        .filter(~F.col("filename").contains(".meta.json"))
        .orderBy(F.col("modified_at").desc(), "subject", "grade", "filename")
    )


def file_stats(files: DataFrame) -> DataFrame:
    """Count and bytes per subject, per grade, per both, and in total."""
    grouped = files.groupingSets(
        [["subject", "grade"], ["subject"], ["grade"], []], "subject", "grade"
    ).agg(F.grouping_id().alias("_gid"), F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    level = F.element_at(F.array(*[F.lit(x) for x in ("folder", "subject", "grade", "total")]), (F.col("_gid") + 1).cast("int"))
    return grouped.select(level.alias("level"), "subject", "grade", "files", "bytes", size_text(F.col("bytes")).alias("size_text"))


def file_tree(files: DataFrame) -> DataFrame:
    """Tree lines: a subject, its grades, their files, in order of ``path``."""
    nodes = F.array(
        F.struct(F.lit(0).alias("depth"), F.col("subject").alias("path"), F.col("subject").alias("name")),
        F.struct(F.lit(1).alias("depth"), F.concat_ws("/", "subject", "grade").alias("path"), F.col("grade").alias("name")),
        F.struct(F.lit(2).alias("depth"), F.concat_ws("/", "subject", "grade", "filename").alias("path"), F.col("filename").alias("name")),
    )
    rows = files.select("size", F.explode(nodes).alias("n"))
    return rows.groupBy("n.path", "n.depth", "n.name").agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes")
    ).orderBy("path")


def image_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Images per extension: files, bytes, and how many only repeat another file's content."""
    images = _files(spark, root).select(
        F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("extension"), F.col("length").alias("size"),
        F.md5("content").alias("hash"),
    )
    by_hash = images.groupBy("extension", "hash").agg(F.count("*").alias("_n"), F.sum("size").alias("_bytes"))
    return by_hash.groupBy("extension").agg(
        F.sum("_n").alias("files"), F.sum("_bytes").alias("bytes"), F.sum(F.col("_n") - 1).alias("repeated")
    )


def image_duplicates(spark: SparkSession, root: str) -> DataFrame:
    """Contents stored more than once."""
    return (
        _files(spark, root).select(F.md5("content").alias("hash"), "path", "length")
        .groupBy("hash").agg(F.count("*").alias("copies"), F.min("path").alias("first_path"), F.max("length").alias("size"))
        .filter(F.col("copies") > 1)
    )
