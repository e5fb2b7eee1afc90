"""Small tables written in the program."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows as a literal of the plan.

    Its size is known to the planner, so joins with it are broadcast by the
    ordinary size check; a table made from local rows has no known size and
    would be shuffled together with the other side.
    """
    kind = T.StructType.fromDDL(schema)
    text = json.dumps([_plain(dict(zip(kind.names, row)), kind) for row in rows])
    listed = F.from_json(F.lit(text), f"array<{kind.simpleString()}>")
    return spark.sql("SELECT 1 AS one").select(F.explode(listed).alias("r")).select("r.*")


def _plain(value, kind):
    """Tuples inside as JSON objects."""
    if isinstance(kind, T.StructType) and value is not None:
        items = value if isinstance(value, dict) else dict(zip(kind.names, value))
        return {f.name: _plain(items[f.name], f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType) and value is not None:
        return [_plain(v, kind.elementType) for v in value]
    return value
