"""Streams give what the batch gives."""

from pyspark.sql import functions as F

from examloom.operators.bank import daily_activity
from examloom.operators.ingest import ingest_dedup
from examloom.plans import QUERIES
from examloom.plans import bindings as b
from examloom.plans.registry import Tables
from examloom.streaming.jobs import daily_totals, stream_daily_activity, stream_ingest

FOLDER = "/root/testdata/sf0.001"


def stored(spark, tmp_path, parts=5):
    rows = b.bank(Tables(spark, FOLDER)).select(F.col("id").alias("seq"), "content", F.col("created_at").cast("timestamp").alias("created_at"))
    for i in range(parts):
        low, high = i * 6, (i + 1) * 6
        day = F.dayofmonth("created_at") - 1
        rows.filter((day >= low) & (day < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return rows


def test_ingest_stream_equals_batch(spark, tmp_path):
    rows = stored(spark, tmp_path)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "bank")
    stream_ingest(source, out, str(tmp_path / "state")).awaitTermination()
    saved = spark.read.parquet(out)
    batch = ingest_dedup(rows, spark.createDataFrame([], "content string"))[0]
    assert sorted(r[0] for r in saved.select("content").collect()) == sorted(r[0] for r in batch.select("content").collect())
    assert saved.select("batch").distinct().count() == 5
    # The same files again with a new state: nothing is new but the batches are the same ones.
    again = ingest_dedup(rows, saved)[0]
    assert again.count() == 0


def test_streams_over_a_folder_of_parts_equal_those_over_one_file(spark, tmp_path):
    """A table may be a folder: its parts do not bear the name of the table."""
    tables = Tables(spark, FOLDER)
    tables.documents.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    tables.labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name in ("stream_ingest", "stream_daily_activity"):
        whole = sorted(map(tuple, QUERIES[name](spark, FOLDER).collect()))
        assert whole and sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == whole


def test_ingest_stream_honours_an_existing_bank(spark, tmp_path):
    rows = stored(spark, tmp_path)
    bank = rows.filter("seq % 3 = 0").select("content")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_ingest(source, str(tmp_path / "bank"), str(tmp_path / "state"), bank=bank).awaitTermination()
    saved = spark.read.parquet(str(tmp_path / "bank"))
    want = ingest_dedup(rows, bank)[0]
    assert sorted(r[0] for r in saved.select("content").collect()) == sorted(r[0] for r in want.select("content").collect())


def test_a_batch_reads_its_own_rows_only(spark, tmp_path):
    """Three runs of one stream: the bank is read with the first batch, and later batches touch their own digests."""
    bank = spark.range(20_000).select(F.concat(F.lit("held "), F.col("id")).alias("content"))
    rows = []
    for run in range(3):
        new = [(run * 10 + 2, f" held {run} ", None), (run * 10 + 1, f"new {run}", "x"), (run * 10, f"new {run}", ""), (run * 10 + 3, "new 0", ""), (run * 10 + 4, "  ", ""), (run * 10 + 5, None, "")]
        rows += new
        spark.createDataFrame(new, "seq long, content string, subject string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("seq long, content string, subject string").parquet(str(tmp_path / "in"))
        running = stream_ingest(source, str(tmp_path / "bank"), str(tmp_path / "state"), bank=bank)
        running.awaitTermination()
        told = [p for p in running.recentProgress if p["numInputRows"]]
        assert sum(p["numInputRows"] for p in told) == (20_006 if run == 0 else 6)
        assert sum(o["numRowsUpdated"] for p in told for o in p["stateOperators"]) <= (20_002 if run == 0 else 3)
    saved = {(r["seq"], r["content"], r["subject"]) for r in spark.read.parquet(str(tmp_path / "bank")).collect()}
    assert saved == {(0, "new 0", "general"), (10, "new 1", "general"), (20, "new 2", "general")}
    want = ingest_dedup(spark.createDataFrame(rows, "seq long, content string, subject string"), bank)[0]
    assert {r["content"] for r in want.collect()} == {c for _, c, _ in saved}


def test_daily_stream_equals_batch(spark, tmp_path):
    rows = stored(spark, tmp_path)
    late = spark.createDataFrame([(10**9, "late", "2024-03-01 00:00:00"), (10**9 + 1, "old", "2024-01-02 00:00:00")], "seq long, content string, t string")
    late = late.select("seq", "content", F.to_timestamp("t").alias("created_at"))
    for more in (None, late.filter("seq = 1000000000"), late.filter("seq > 1000000000")):
        if more is not None:
            more.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            rows = rows.unionByName(more)
        source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        stream_daily_activity(source, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        got = {r["day"]: r["total"] for r in daily_totals(spark, str(tmp_path / "out")).collect()}
        want = {r["day"]: r["total"] for r in daily_activity(rows, "2024-03-02 00:00:00", days=100).collect()}
        assert got == want
