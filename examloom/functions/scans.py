"""What an ordered walk over an array knows after each element."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from examloom.functions.text import let

_CHUNK = 256


def running(values: Column, start: Column, step, kind: str) -> Column:
    """The states after each element: ``step(state, element)`` from ``start``, which is of type ``kind``.

    The walk runs in chunks, so that keeping its states copies no more than a chunk's worth of them per element.
    An empty array gives an empty array, a null one null.
    """
    def inside(state, chunk):
        seen = F.array().cast(f"array<{kind}>")
        return F.aggregate(
            chunk, F.struct(state.alias("now"), seen.alias("seen")),
            lambda a, x: let(step(a["now"], x), lambda s: F.struct(s.alias("now"), F.array_append(a["seen"], s).alias("seen"))))

    def along(v):
        last = F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / _CHUNK).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(v, i * _CHUNK + 1, _CHUNK))
        done = F.array().cast(f"array<array<{kind}>>")
        return F.aggregate(
            chunks, F.struct(start.alias("now"), done.alias("done")),
            lambda a, c: let(inside(a["now"], c), lambda r: F.struct(
                r["now"].alias("now"), F.array_append(a["done"], r["seen"]).alias("done"))),
            lambda a: F.flatten(a["done"]))

    return let(values, lambda v: F.when(v.isNotNull(), along(v)))
