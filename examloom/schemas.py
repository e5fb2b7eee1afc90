"""Tables of a question bank as Spark schemas, and bringing text columns into them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examloom.functions.text import answer_letter, answer_text

QUESTIONS = (
    "id bigint, content string, options array<string>, answer string, explanation string, subject string, topic string, "
    "grade string, question_type string, difficulty string, difficulty_score double, image_url string, "
    "tags array<string>, source string, created_at timestamp, updated_at timestamp, quality_score double, "
    "quality_issues array<struct<type:string,severity:string,description:string,suggestion:string>>, times_used int"
)
EXAMS = (
    "exam_id bigint, title string, description string, subject string, grade string, total_questions int, "
    "duration_minutes int, created_at timestamp, updated_at timestamp"
)
EXAM_QUESTIONS = "exam_id bigint, question_id bigint, order int, points double"
EXAM_VARIANTS = (
    "exam_id bigint, variant_code string, question_order array<bigint>, "
    "answer_mapping map<string,struct<original:string,shuffled:string,shuffled_options:array<string>>>, "
    "created_at timestamp"
)
USAGE_HISTORY = (
    "timestamp string, history_type string, filename string, count int, difficulty string, questions array<string>"
)
CURRICULUM = (
    "id bigint, subject string, grade int, chapter string, topic string, lesson string, knowledge string, skills string, "
    "competencies string, periods int, source_url string, source_document string"
)

# Columns kept as JSON text in exports of the bank.
JSON_COLUMNS = {
    "options": "array<string>",
    "tags": "array<string>",
    "quality_issues": "array<struct<type:string,severity:string,description:string,suggestion:string>>",
    "question_order": "array<bigint>",
    "answer_mapping": "map<string,struct<original:string,shuffled:string,shuffled_options:array<string>>>",
    "questions_json": "array<string>",
}


def parse_json_columns(df: DataFrame) -> DataFrame:
    """Turn JSON kept as text into arrays and maps; broken text becomes null."""
    kinds = dict(df.dtypes)
    return df.select(*[
        F.from_json(c, JSON_COLUMNS[c]).alias(c) if c in JSON_COLUMNS and kinds[c] == "string" else F.col(c)
        for c in df.columns
    ])


def canonical_answers(bank: DataFrame) -> DataFrame:
    """Add ``answer_letter`` and ``answer_text``, whichever way the answer was written."""
    return bank.withColumn("answer_letter", answer_letter("answer", "options")).withColumn(
        "answer_text", answer_text("answer", "options")
    )
