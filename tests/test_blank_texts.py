"""Documents without text, at the queries that once lost them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from examloom.operators import documents
from examloom.plans import ORACLES, QUERIES
from examloom.sources import banks

TEXTS = [None, "", "   ", " \n\t\n", "\xa0one\n", "one\ntwo", "two "]
# Lines that are only a label, alone and as neighbours.
LABELS = ["-\nb)\nb)\nb)", "x\nA.\nA.", "A.\nA.\nA.\nA.", "C.\nA.\nA.\ny\ny", "x\nA.\nB.\nB.\nB. z", "x\nA. y\nA.\nA.\nA.\nend\nend", "x\r\nA.\r\nA.\r\nA."]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents with blank texts and null languages."""
    place = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, None if i % 5 == 4 else "en", "s", len(t or "")) for i, t in enumerate(TEXTS * 2, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.coalesce(1).write.parquet(f"{place}/documents.parquet")
    return place


@pytest.fixture(scope="module")
def labels_folder(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("labels"))
    spark.createDataFrame(list(enumerate(LABELS)), "doc_id long, text string").coalesce(1).write.parquet(f"{place}/documents.parquet")
    return place


def pairs(spark, folder, name):
    """Rows of a query and of its twin."""
    frame = QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(frame.columns)} FROM ({ORACLES[name]})").fetchall()
    return sorted(map(repr, map(tuple, frame.collect()))), sorted(map(repr, want))


def test_read_bank_json_keeps_blank_texts(spark, folder):
    got, want = pairs(spark, folder, "read_bank_json")
    assert len(got) == 2 * len(TEXTS) and got == want


@pytest.mark.parametrize("name", ["read_bank_json", "write_bank_json"])
def test_bank_json_of_a_very_long_text(spark, tmp_path, name):
    length = 20_000_001  # one more than Spark reads by default
    spark.range(1).select(
        F.lit(1).cast("long").alias("doc_id"), F.repeat(F.lit("x"), length).alias("text"), F.lit("en").alias("lang"),
        F.lit("s").alias("source"), F.lit(length).cast("long").alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES[name](spark, str(tmp_path)).select(F.length("content").alias("n"), "subject").collect()
    assert [tuple(r) for r in rows] == [(length, "en")]


@pytest.mark.parametrize("multiline", [True, False])
def test_whole_export(spark, tmp_path, multiline):
    lines = ['{"content": null, "subject": null, "topic": "a"}', '{"content": "", "topic": "b"}',
             '{"content": " \\u00a0q\\n", "subject": "s", "topic": "c"}', '{"content": "r", "options": 5, "topic": "d"}']
    text = "[" + ",".join(lines) + "]" if multiline else "\n".join([*lines, '{"content": "cut off', "not json"])
    (tmp_path / "f.json").write_text(text)
    rows = {r["topic"]: (r["content"], r["subject"]) for r in banks.read_bank_json(spark, str(tmp_path), multiline, whole=True).collect()}
    assert rows == {"a": (None, None), "b": ("", None), "c": ("\xa0q", "s"), "d": ("r", None)}
    rows = {r["topic"]: (r["content"], r["subject"]) for r in banks.read_bank_json(spark, str(tmp_path), multiline).collect()}
    assert rows == {"c": ("q", "s"), "d": ("r", "unknown")}


def test_split_questions_keeps_blank_texts(spark, folder):
    got, want = pairs(spark, folder, "split_questions")
    assert len(got) == 2 * len(TEXTS) and got == want


def test_whole_documents_only_when_asked(spark):
    df = spark.createDataFrame([(1, None), (2, " \n"), (3, "What? Why?")], "doc_id int, text string")
    asked = [(3, 0, "What?"), (3, 1, "Why?")]
    assert sorted(map(tuple, documents.split_questions(df).collect())) == asked
    got = sorted(map(tuple, documents.split_questions(df, whole=True).collect()))
    assert got == [(1, 0, None), (2, 0, ""), *asked]


def test_split_questions_of_lines_that_are_labels(spark, labels_folder):
    got, want = pairs(spark, labels_folder, "split_questions")
    assert len(got) == len(LABELS) and got == want
