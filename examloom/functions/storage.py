"""Folders that every executor sees, and cutting lineage in them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or one set on the context, or else one beside the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = configured or spark.sparkContext.getCheckpointDir()
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch").rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise to reliable storage and forget how the rows came about."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate files, next to the checkpoints of the cluster."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a scratch folder and read again: worked out once, and of known size to the planner."""
    place = scratch_folder(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place)
