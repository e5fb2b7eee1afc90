"""Session settings for tests, benchmarks and stand-alone use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: str = "8", app: str = "examloom") -> SparkSession:
    """A local session; on a cluster the session comes from spark-submit."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", os.environ.get("EXAMLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
