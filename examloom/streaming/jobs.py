"""The two jobs that also run on streams, with the batch code inside."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from examloom.functions.text import strip
from examloom.operators.ingest import DIGEST, content_digests, with_defaults


_SEEN = "_seen"
#: Earlier than any batch.
HELD = -1
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_ingest(
    rows: DataFrame, bank_path: str, checkpoint: str, defaults: dict | None = None, bank: DataFrame | None = None
) -> StreamingQuery:
    """Append new questions of a stream to a bank kept by batch.

    What has been seen is keyed state: per content digest the first row and the batches that saw the digest first
    and last, in the state store of the stream.  A batch looks up its own digests only, however large the bank is,
    and copies meet in the map tasks first.  A row is new if no batch but this one saw its digest; within a batch
    the smallest ``seq`` wins.  The questions of ``bank``, held before the stream began, enter the state as digests
    with the first batch; they are written once beside the bank and not read again.  A batch replaces
    ``batch=<id>``, so that one repeated after a failure leaves the bank as it was.

    Null and blank contents are passed over; rows without ``seq`` come last.
    """
    spark = rows.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # state on disk, not in memory
    kept = rows.withColumn("content", strip(F.col("content"))).where("content <> ''")
    columns = kept.columns
    # the time of a batch is one value for all its rows, and the same when it is repeated
    kept = kept.withColumn(DIGEST, F.unhex(F.sha2("content", 256))).withColumn(_SEEN, F.unix_micros(F.current_timestamp()))
    if bank is not None:
        kept = kept.unionByName(_held(spark, bank, f"{bank_path}/_known", checkpoint), allowMissingColumns=True)
    order = F.struct(_SEEN, F.col("seq").isNull(), "seq")
    state = kept.groupBy(DIGEST).agg(
        F.min_by(F.struct(*columns), order).alias("_row"), F.min(_SEEN).alias("_first"), F.max(_SEEN).alias("_last"))

    def save(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.where((F.col("_first") == F.col("_last")) & (F.col("_first") > HELD)).select("_row.*", DIGEST)
        with_defaults(fresh, defaults).write.mode("overwrite").parquet(f"{bank_path}/batch={batch_id}")

    return _started(state, save, checkpoint, "update")


def _held(spark: SparkSession, bank: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Digests of the bank as a stream of one batch; they are written unless the stream has begun before."""
    try:
        spark.read.text(f"{checkpoint}/metadata").schema
    except AnalysisException:
        content_digests(bank).distinct().write.mode("overwrite").parquet(path)
    return spark.readStream.schema(f"{DIGEST} binary").parquet(path).withColumn(_SEEN, F.lit(HELD))


def _started(rows: DataFrame, save, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return (
        rows.writeStream.foreachBatch(save)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_daily_activity(rows: DataFrame, path: str, checkpoint: str, created: str = "created_at") -> StreamingQuery:
    """Rows per day, added up batch by batch; late rows count for their day like others.

    A batch saves its own totals as ``batch=<id>`` and replaces them when it is repeated; ``daily_totals`` adds
    them up.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        totals = batch.groupBy(F.to_date(created).alias("day")).agg(F.count("*").alias("total"))
        totals.filter(F.col("day").isNotNull()).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _started(rows, save, checkpoint)


def daily_totals(spark: SparkSession, path: str) -> DataFrame:
    """Rows per day over all batches so far."""
    saved = spark.read.schema("day date, total long, batch int").parquet(path)
    return saved.groupBy("day").agg(F.sum("total").alias("total"))
