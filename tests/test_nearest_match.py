"""Numbers meet answers by cells, in a join that is not broadcast."""

from pyspark.sql import functions as F

from examloom.operators import sheets
from examloom.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_spans_are_not_broadcast(spark):
    assert "BroadcastHashJoin" not in QUERIES["nearest_right_match"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_answers_are_met_across_the_edges_of_cells(spark):
    """Every place of a number in a cell, with an answer just inside or just outside its reach."""
    spans, want = [], {}
    for doc, (x, y, right, down) in enumerate((x, y, r, d) for x in (0, 49, 51, 99) for y in (-1, 0, 7, 24, 31) for r in (1, 49, 50) for d in (-8, -7, 0, 7, 8)):
        spans += [(doc, i, "1", -200.0 + 10 * i, 500.0) for i in range(6)]
        spans += [(doc, 6, "2", float(x), float(y)), (doc, 7, "C", float(x + right), float(y + down))]
        want[doc] = "C" if right < 50 and -8 < down < 8 else None
    frame = spark.createDataFrame(spans, "doc_id int, seq int, text string, x double, y double")
    got = {r["doc_id"]: r["letter"] for r in sheets.nearest_right_match(frame).where("q = 2").collect()}
    assert got == {d: c for d, c in want.items() if c}
    whole = frame.withColumn("x", F.col("x").cast("decimal(9,2)")).withColumn("y", F.col("y").cast("decimal(9,2)"))
    assert {r["doc_id"]: r["letter"] for r in sheets.nearest_right_match(whole).where("q = 2").collect()} == got
