"""Work that is heavy per row of a narrow table is shared between tasks, and what is made from such rows is not broadcast."""

import pytest
from pyspark.sql import functions as F

from examloom.plans import QUERIES, registry
from examloom.sources import banks

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", [
    "html_questions_quiz", "html_questions_header_list", "html_questions_boxes", "html_questions_nested", "passage_nested", "numbered_line_tables",
    "numbered_line_parse", "math_text", "normalize_feeds", "split_answer_sections"])
def test_rows_of_one_file_are_dealt_to_tasks(spark, monkeypatch, name):
    whole = rows_of(QUERIES[name](spark, FOLDER))
    monkeypatch.setattr(registry, "ROWS_PER_TASK", 50)
    dealt = QUERIES[name](spark, FOLDER)
    assert "REPARTITION_BY_NUM" in plan_of(dealt)
    assert rows_of(dealt) == whole


@pytest.mark.parametrize("name", ["numbered_line_tables", "passage_nested"])
def test_what_is_made_from_narrow_rows_is_not_broadcast(spark, name):
    assert "BroadcastHashJoin" not in plan_of(QUERIES[name](spark, FOLDER))


@pytest.mark.parametrize("fmt", ["csv", "txt"])
def test_formulas_are_worked_out_once_after_the_order(spark, tmp_path, monkeypatch, fmt):
    seen = []
    real = banks.math_text
    monkeypatch.setattr(banks, "math_text", lambda df, column: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, column))
    banks.write_question_text(spark.range(5).select((5 - F.col("id")).alias("id"), F.concat(F.lit("$x^2$ "), "id").alias("content")), str(tmp_path / "out"), fmt)
    assert "Sort [id" in seen[0] if fmt == "txt" else "Join" in seen[0]
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(lines) == (["x² 0", "x² 1", "x² 2", "x² 3", "x² 4"] if fmt == "txt" else ["1,x² 4", "2,x² 3", "3,x² 2", "4,x² 1", "5,x² 0", "id,question"])


def test_the_order_of_variants_travels_as_bytes(spark):
    """The digest that orders an exam is 16 bytes in the range shuffle, not 32 digits."""
    from examloom.operators import assemble

    seen = []
    real = assemble.split_row_number
    assemble.split_row_number = lambda df, *rest: seen.append(dict(df.dtypes)["_luck"]) or real(df, *rest)
    try:
        QUERIES["exam_variants"](spark, FOLDER)
    finally:
        assemble.split_row_number = real
    assert seen == ["binary"]
