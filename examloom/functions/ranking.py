"""Ranking and numbering that stay balanced when one key is very large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examloom.functions.storage import checkpointed

SALTS = 64


def top_n(df: DataFrame, keys: list, order: list, n: int, out: str = "rn") -> DataFrame:
    """First ``n`` rows of each key, in two levels.

    Keys are first cut in salted parts by a hash of the row, and the first ``n`` of the parts are ranked
    again, so a key with most of the rows is ranked by many tasks.  The bound is a literal: Spark drops rows
    beyond it before the shuffle as well (WindowGroupLimit), equal rows included.
    """
    bound = F.lit(int(n))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
    firsts = salted.withColumn(out, F.row_number().over(part)).filter(F.col(out) <= bound).drop("_salt", out)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return firsts.withColumn(out, rank).filter(F.col(out) <= bound)


def split_row_number(df: DataFrame, keys: list[str], order: list, out: str = "rn") -> DataFrame:
    """``row_number`` per key, for keys of any size."""
    return split_running_sum(df, keys, order, F.lit(1), out)


def split_running_sum(df: DataFrame, keys: list[str], order: list, value: Column, out: str) -> DataFrame:
    """Running sum of ``value`` per key, the row itself included.

    Rows are cut into ranges of (key, order), so a large key lies in many ranges and a small one in one.  Sums
    run inside a range; what a key has in the ranges before is added from a table of one row per key and range.
    Null keys are a key like others.
    """
    rows = _ranged(df, keys, order)
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_key", "_range").agg(F.sum(value).alias("_sum")).select(
        "_key", "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    along = Window.partitionBy("_key", "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("_inside", F.sum(value).over(along)).join(offsets, ["_key", "_range"])
    return summed.withColumn(out, (F.col("_inside") + F.col("_offset")).cast("long")).drop("_key", "_range", "_inside", "_offset")


def with_neighbours(df: DataFrame, keys: list[str], pos: str, after: Column, before: Column) -> DataFrame:
    """Add ``_next`` and ``_prev``: ``after`` of the row that follows by ``pos``, ``before`` of the one ahead.

    Both are never null in a row.  Rows are cut into ranges as above; the first and last rows of a key in a
    range are handed over through a small table.
    """
    rows = _ranged(df.withColumn("_after", after).withColumn("_before", before), keys, [pos])
    along = Window.partitionBy("_key").orderBy("_range")
    handed = rows.groupBy("_key", "_range").agg(
        F.min_by("_after", pos).alias("_first"), F.max_by("_before", pos).alias("_last")
    ).select("_key", "_range", F.lead("_first").over(along).alias("_beyond"), F.lag("_last").over(along).alias("_ahead"))
    inside = Window.partitionBy("_key", "_range").orderBy(pos)
    near = rows.withColumn("_next", F.lead("_after").over(inside)).withColumn("_prev", F.lag("_before").over(inside))
    out = near.join(handed, ["_key", "_range"]).withColumn("_next", F.coalesce("_next", "_beyond")).withColumn(
        "_prev", F.coalesce("_prev", "_ahead"))
    return out.drop("_key", "_range", "_after", "_before", "_beyond", "_ahead")


def _ranged(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows with their key as one value and the number of their range, stored once so that numbers stay."""
    keyed = df.withColumn("_key", F.struct(*keys))
    return checkpointed(keyed.repartitionByRange("_key", *order).withColumn("_range", F.spark_partition_id()))
