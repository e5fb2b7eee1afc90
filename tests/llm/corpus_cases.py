"""Documents with every awkward case, shared by the tests of the corpus operators."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SYLLABLES = "an be co di er fi ga ho in ja ke lo mi no or pa qu re si tu".split()

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("key", T.StringType()), T.StructField("n", T.LongType()), T.StructField("score", T.DoubleType()),
    T.StructField("ids", T.StringType()), T.StructField("bucket", T.LongType()), T.StructField("quality_score", T.DoubleType()),
    T.StructField("_key", T.StringType()), T.StructField("_bad", T.LongType()),
])


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


def frame(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, lang, source) with clashing further columns."""
    out = []
    for row in rows:
        i, text, lang, source = (*row, "en", "src0")[:4] if len(row) == 2 else row
        out.append((i, text, lang, source, None if text is None else len(text), "k", 1, 0.5, "x", 3, 0.1, "y", 4))
    return spark.createDataFrame(out, DOCS)


def awkward():
    """Nulls, empty, blank, short, very long, non-ASCII, ties, repeated rows and ids."""
    long = prose(1, 60_000)
    return [
        (1, prose(2, 120)), (2, prose(2, 120)), (3, prose(2, 119) + " tail"), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "one two"),
        (9, long), (10, long[1000:] + " end"), (None, prose(3, 80)), (None, prose(3, 80)), (11, "é ñ 漢字 " * 40), (12, "aaaa " * 300),
        (13, prose(4, 70)), (13, prose(4, 70)), (13, prose(5, 70)), (14, "x" * 5000), (15, prose(6, 40) + "\n" + prose(6, 40)),
        (16, prose(7, 90), None, None), (17, prose(8, 90), "de", None),
    ]
