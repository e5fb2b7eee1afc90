"""Named queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
#: Rows of a narrow table that one task turns into texts or pages; fewer are not worth a shuffle.
ROWS_PER_TASK = 5_000


class Tables:
    """The given tables of one scale folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables hold UTC times

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A narrow table whose rows are made into texts or pages: dealt to tasks by key, its first column.

        A million rows of some bytes lie in one file of one row group, and so in one task, but each makes work of
        milliseconds.  Only the narrow rows travel.
        """
        table = getattr(self, name)
        tasks = -(-table.count() // ROWS_PER_TASK)
        return table.repartition(tasks, table.columns[0]) if tasks > 1 else table

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(text, **frames)


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables`, with its SQL twin if it has one."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add
