"""Curriculum tables: filters, counts, reloads, flattening and rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examloom.functions.text import has_text
from examloom.operators.bank import contains_ci


def _slice(cur: DataFrame, subject=None, grade=None) -> DataFrame:
    if subject:
        cur = cur.filter(F.col("subject") == subject)
    if grade:
        cur = cur.filter(F.col("grade") == grade)
    return cur


def curriculum_filter(
    cur: DataFrame, subject=None, grade=None, chapter=None, skip: int = 0, limit: int = 100
) -> DataFrame:
    """One page of rows of a subject, grade and chapter (substring), by grade, chapter and id."""
    rows = _slice(cur, subject, grade)
    if chapter:
        rows = rows.filter(contains_ci("chapter", chapter))
    return rows.orderBy("grade", "chapter", "id").offset(skip).limit(limit)


def curriculum_search(cur: DataFrame, keyword: str, subject=None, grade=None) -> DataFrame:
    """Rows with the keyword in topic, lesson or knowledge."""
    hit = contains_ci("topic", keyword) | contains_ci("lesson", keyword) | contains_ci("knowledge", keyword)
    return _slice(cur, subject, grade).filter(hit)


def curriculum_distinct(cur: DataFrame, column: str, subject: str, grade: int) -> DataFrame:
    """Distinct non-empty topics or chapters of a subject and grade."""
    return _slice(cur, subject, grade).filter(has_text(F.col(column))).select(column).distinct()


def curriculum_stats(cur: DataFrame) -> DataFrame:
    """Rows per subject and grade, with a total per subject."""
    grouped = cur.rollup("subject", "grade").agg(
        F.grouping_id().alias("_gid"), F.count("*").alias("total")
    )
    level = F.when(F.col("_gid") == 0, "grade").otherwise("subject")
    return grouped.filter(F.col("_gid") < 3).select(level.alias("level"), "subject", "grade", "total")


def replace_slice(cur: DataFrame, new_rows: DataFrame, subject: str) -> DataFrame:
    """The table after a reload of one subject: its old rows go, the new ones come."""
    kept = cur.filter(~F.coalesce(F.col("subject") == subject, F.lit(False)))
    return kept.unionByName(new_rows.filter(F.col("subject") == subject), allowMissingColumns=True)


def write_slice(new_rows: DataFrame, path: str) -> None:
    """Reload subjects in a table partitioned by subject; other subjects are not touched."""
    (
        new_rows.repartition("subject", "grade")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("subject")
        .parquet(path)
    )


SOURCE_SCHEMA = (
    "subject string, name string, grades map<int,array<struct<chapter:string,knowledge:string,skills:string,"
    "topics:array<struct<topic:string,periods:int,lessons:array<string>>>>>>"
)


def curriculum_flatten(src_a: DataFrame, src_b: DataFrame) -> DataFrame:
    """Two nested sources to one row per lesson; grades of the second replace those of the first.

    Periods are split evenly among lessons, the remainder is lost.
    """
    def grades(df):
        return df.select("subject", F.explode("grades").alias("grade", "chapters"))

    a, b = grades(src_a), grades(src_b)
    merged = a.join(b.select("subject", "grade").distinct(), ["subject", "grade"], "left_anti").unionByName(b)
    chapters = merged.select("subject", "grade", F.explode("chapters").alias("c"))
    topics = chapters.select(
        "subject", "grade", F.col("c.chapter").alias("chapter"), F.col("c.knowledge").alias("knowledge"),
        F.col("c.skills").alias("skills"), F.explode("c.topics").alias("t"),
    )
    share = F.floor(F.coalesce(F.col("t.periods"), F.lit(0)) / F.size("t.lessons")).cast("int")
    return topics.filter(F.size("t.lessons") > 0).select(
        "subject", "grade", "chapter", F.col("t.topic").alias("topic"), F.explode("t.lessons").alias("lesson"),
        "knowledge", "skills", share.alias("periods"),
    )


def curriculum_context(cur: DataFrame, subject: str, grade: int, max_items: int | None = None) -> DataFrame:
    """The rows of a subject and grade as text, one row per item; the first item of a chapter carries its heading.

    (chapter, id) is the order of the whole text.  ``max_items`` keeps the first ones only.
    """
    rows = _slice(cur, subject, grade)
    if max_items is not None:
        rows = rows.orderBy("chapter", "id").limit(max_items)
    firsts = rows.filter(has_text(F.col("chapter"))).groupBy("chapter").agg(F.min("id").alias("_first"))

    def part(column, prefix):
        return F.when(has_text(F.col(column)), F.concat(F.lit(prefix), F.col(column)))

    lines = F.array_compact(F.array(
        F.when(F.col("id") == F.col("_first"), F.concat(F.lit("\n## "), "chapter")),
        part("topic", "- **Chủ đề:** "),
        part("lesson", "  - Bài: "),
        part("knowledge", "  - Kiến thức: "),
        *([part("skills", "  - Kỹ năng: ")] if "skills" in cur.columns else []),
    ))
    return rows.join(firsts, "chapter", "left").select("chapter", "id", F.array_join(lines, "\n").alias("content"))
