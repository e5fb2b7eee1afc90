"""Shapes of physical plans."""

from pathlib import Path

import pytest

from examloom.operators import bank as ops
from examloom.plans import QUERIES
from examloom.plans import bindings as b
from examloom.plans.registry import Tables

FOLDER = "/root/testdata/sf0.001"
WITH_PYTHON = {"near_dup_merge"}
WRITES_FIRST = {
    "write_slice",
    "read_bank_json", "write_bank_json", "read_moodle_xml", "write_moodle_xml", "read_qti_xml", "write_qti_xml",
    "write_question_text", "write_question_text_plain", "read_text_corpus", "image_duplicates", "image_inventory", "file_inventory", "file_stats", "file_tree", "stream_ingest",
    "stream_daily_activity", "link_frontier",
}
ROW_LOCAL = [
    "split_questions", "parse_mcq_block", "clean_generated", "split_answer_sections", "json_questions", "option_split",
    "question_header_parse", "numbered_line_parse", "passage_questions", "cell_questions", "answer_key_text", "labelled_fields",
    "level_detect", "outline_fill", "chapter_periods", "shape_vote", "html_questions", "html_questions_nested", "page_links", "cau_segments", "cau_segments_page",
    "embedded_answers", "document_links", "image_flags", "route_by_domain", "subject_by_slug", "grade_from_url",
    "language_flags", "normalize_keys", "rule_variants", "math_text", "shape_tags", "shuffle_options", "normalize_feeds",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES_FIRST))
def test_no_nested_loops_and_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in WITH_PYTHON:
        assert "Python" not in plan and "InPandas" not in plan and "ArrowEval" not in plan


@pytest.mark.parametrize("name", ROW_LOCAL)
def test_row_local_jobs_do_not_shuffle(spark, name):
    assert "Exchange" not in plan_of(QUERIES[name](spark, FOLDER))


def test_scans_are_pruned(spark):
    plan = plan_of(ops.facet_counts(b.bank(Tables(spark, FOLDER))))
    scan = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scan) == 1 and "text:string" not in scan[0]
    plan = plan_of(ops.bank_availability(b.bank(Tables(spark, FOLDER)), "en"))
    assert "EqualTo(lang,en)" in plan


def test_picks_rank_ids_only(spark):
    plan = plan_of(QUERIES["matrix_pick"](spark, FOLDER))
    assert plan.count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("name", ["exam_variants", "number_sort", "position_marks", "section_renumber", "bilingual_merge", "pick_answer_key", "curriculum_context", "score_summary"])
def test_no_table_meets_in_one_task(spark, name):
    """Only sums of few rows may; none of these has any."""
    assert "SinglePartition" not in plan_of(QUERIES[name](spark, FOLDER))


def test_no_local_state_in_the_library():
    import examloom

    for path in Path(examloom.__file__).parent.rglob("*.py"):
        text = path.read_text()
        assert "mkdtemp" not in text and "tempfile" not in text and ".localCheckpoint(" not in text, path
