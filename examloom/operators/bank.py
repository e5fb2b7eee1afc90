"""Filters, updates, counts and dashboards over a question bank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examloom.functions.text import has_text, is_blank

DIFFICULTIES = ("easy", "medium", "hard")
NO_TOPIC = "(chưa phân loại)"


def contains_ci(col: str, needle: str) -> Column:
    """Case-insensitive substring test; ``%`` and ``_`` in the needle are plain."""
    escaped = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return F.col(col).ilike(f"%{escaped}%")


def bank_predicate(
    subject=None, grade=None, topic=None, difficulty=None, question_type=None, search=None
) -> Column | None:
    """AND of the filters that were given; None when there are none."""
    wanted = {
        "subject": subject,
        "grade": grade,
        "topic": topic,
        "difficulty": difficulty,
        "question_type": question_type,
    }
    out = None
    for column, value in wanted.items():
        if value:
            test = F.col(column) == value
            out = test if out is None else out & test
    if search:
        test = contains_ci("content", search)
        out = test if out is None else out & test
    return out


def bank_filter(bank: DataFrame, *, id=None, skip: int = 0, limit: int = 100, **filters) -> DataFrame:
    """One page of the filtered bank, newest first.  ``id`` short-cuts to one row."""
    if id is not None:
        return bank.filter(F.col("id") == id)
    test = bank_predicate(**filters)
    rows = bank if test is None else bank.filter(test)
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).offset(skip).limit(limit)


def bank_filter_count(bank: DataFrame, **filters) -> DataFrame:
    """Number of rows the filters keep."""
    test = bank_predicate(**filters)
    return (bank if test is None else bank.filter(test)).agg(F.count("*").alias("total"))


def bank_delete(bank: DataFrame, source_like: str | None = None, **filters):
    """Rows kept after a delete, and the number deleted; no filter deletes all."""
    test = bank_predicate(**filters)
    if source_like:
        pattern = F.col("source").like(source_like)
        test = pattern if test is None else test & pattern
    doomed = F.lit(True) if test is None else F.coalesce(test, F.lit(False))
    return bank.filter(~doomed), bank.agg(F.count_if(doomed).alias("deleted"))


def bank_patch(bank: DataFrame, patches: DataFrame, key: str = "id") -> DataFrame:
    """Partial update: non-null patch fields win.  Of several patches for one key the smallest row counts."""
    fields = [c for c in patches.columns if c != key]
    patches = patches.groupBy(key).agg(F.min(F.struct(*fields)).alias("_patch")).select(key, "_patch.*")
    renamed = patches.select(
        F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in fields]
    )
    joined = bank.join(renamed, F.col(key) == F.col("_key"), "left")
    return joined.select(
        *[
            F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c)
            for c in bank.columns
        ]
    )


def usage_increment(bank: DataFrame, picks: DataFrame, key: str = "id") -> DataFrame:
    """Add one to ``times_used`` of every picked row, however often it was picked."""
    picked = picks.select(F.col(key).alias("_picked")).distinct()
    joined = bank.join(picked, F.col(key) == F.col("_picked"), "left")
    used = F.coalesce(F.col("times_used"), F.lit(0)) + F.when(
        F.col("_picked").isNotNull(), 1
    ).otherwise(0)
    return joined.withColumn("times_used", used.cast("int")).drop("_picked")


def subject_difficulty_stats(bank: DataFrame, difficulties=DIFFICULTIES) -> DataFrame:
    """Counts per subject with one column per difficulty and the total."""
    return bank.groupBy("subject").agg(
        *[F.count_if(F.col("difficulty") == d).alias(d) for d in difficulties],
        F.count("*").alias("total"),
    )


def bank_overview(bank: DataFrame) -> DataFrame:
    """Totals of the dashboard in one pass."""
    counts = bank.agg(
        F.count("*").alias("total"),
        F.count_if(has_text(F.col("answer"))).alias("with_answer"),
        F.count_if(has_text(F.col("explanation"))).alias("with_explanation"),
        F.count_if(has_text(F.col("image_url"))).alias("with_image"),
        F.count_if(F.col("times_used") > 0).alias("total_used"),
    )
    rate = F.when(
        F.col("total") > 0, F.bround(F.col("with_answer") / F.col("total") * 100, 1)
    ).otherwise(0.0)
    return counts.withColumn("without_answer", F.col("total") - F.col("with_answer")).withColumn(
        "answer_rate", rate
    )


def facet_counts(bank: DataFrame) -> DataFrame:
    """Counts by subject, difficulty, grade and type from one scan.

    ``has_answer`` counts every non-null answer, the empty one too; the dashboard
    total in :func:`bank_overview` does not.  The empty grade is left out.
    """
    facets = ["subject", "difficulty", "grade", "question_type"]
    grouped = bank.groupingSets([[f] for f in facets], *facets).agg(
        F.grouping_id().alias("_gid"),
        F.count("*").alias("total"),
        F.count("answer").alias("has_answer"),
        F.coalesce(F.sum("times_used"), F.lit(0)).alias("sum_used"),
    )
    # grouping_id has one bit per column, the first column highest; 0 = grouped by.
    full = (1 << len(facets)) - 1
    facet, value = None, None
    for i, name in enumerate(facets):
        here = F.col("_gid") == full - (1 << (len(facets) - 1 - i))
        facet = F.when(here, name) if facet is None else facet.when(here, name)
        value = F.when(here, F.col(name)) if value is None else value.when(here, F.col(name))
    out = grouped.select(
        facet.alias("facet"), value.alias("value"), "total", "has_answer", "sum_used"
    )
    return out.filter((F.col("facet") != "grade") | has_text(F.col("value")))


def top_sources(bank: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent sources; ties by name."""
    return (
        bank.filter(has_text(F.col("source")))
        .groupBy("source")
        .agg(F.count("*").alias("total"))
        .orderBy(F.col("total").desc(), "source")
        .limit(n)
    )


def daily_activity(bank: DataFrame, as_of, days: int = 14, created: str = "created_at") -> DataFrame:
    """Rows per calendar day since ``days`` days before ``as_of``."""
    start = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return (
        bank.filter(F.col(created).cast("timestamp_ntz") >= start)
        .groupBy(F.to_date(created).alias("day"))
        .agg(F.count("*").alias("total"))
    )


def bank_availability(
    bank: DataFrame, subject: str, question_type: str = "mcq", grade: str | None = None
) -> DataFrame:
    """Answerable rows per topic and difficulty, and totals per difficulty.

    Rows of the totals have a null topic and ``level`` "difficulty".
    """
    test = (F.col("subject") == subject) & (F.col("question_type") == question_type)
    if grade:
        test = test & (F.col("grade") == grade)
    rows = bank.filter(test & has_text(F.col("answer"))).select(
        F.when(has_text(F.col("topic")), F.col("topic")).otherwise(NO_TOPIC).alias("topic"),
        F.coalesce("difficulty", F.lit("medium")).alias("difficulty"),
        "times_used",
    )
    grouped = rows.groupingSets(
        [["topic", "difficulty"], ["difficulty"]], "topic", "difficulty"
    ).agg(
        F.grouping("topic").alias("_total"),
        F.count("*").alias("total"),
        F.bround(F.coalesce(F.avg("times_used"), F.lit(0.0)), 1).alias("avg_used"),
    )
    level = F.when(F.col("_total") == 1, "difficulty").otherwise("topic")
    return grouped.select(level.alias("level"), "topic", "difficulty", "total", "avg_used")


def missing_answers(bank: DataFrame, subject: str | None = None) -> DataFrame:
    """Rows without an answer per subject; the row with a null subject is the total.

    A ``subject`` limits the total only, as the breakdown always covers the bank.
    """
    missing = bank.filter(is_blank(F.col("answer")))
    in_total = F.lit(True) if subject is None else F.col("subject") == subject
    grouped = missing.rollup("subject").agg(
        F.grouping("subject").alias("_total"),
        F.count("*").alias("_all"),
        F.count_if(in_total).alias("_in"),
    )
    level = F.when(F.col("_total") == 1, "total").otherwise("subject")
    return grouped.select(
        level.alias("level"),
        "subject",
        F.when(F.col("_total") == 1, F.col("_in")).otherwise(F.col("_all")).alias("missing"),
    )


def missing_answer_samples(bank: DataFrame, subject: str | None = None, limit: int = 100) -> DataFrame:
    """The first rows without an answer by id, long contents shown shortened."""
    test = is_blank(F.col("answer"))
    if subject:
        test = test & (F.col("subject") == subject)
    shown = F.when(
        F.length("content") > 200, F.concat(F.substring("content", 1, 200), F.lit("..."))
    ).otherwise(F.col("content"))
    return (
        bank.filter(test)
        .orderBy("id")
        .limit(limit)
        .select("id", shown.alias("content"), "subject", "source")
    )
