"""Responses against answer keys: status, scores, summaries, wide results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examloom.functions.ranking import top_n
from examloom.functions.small import literal_table

TEMPLATE_SCHEMA = (
    "template string, questions int, scheme string, base double, correct double, "
    "wrong double, blank double, count_best int, "
    "tiers array<struct<start:int,end:int,correct:double,wrong:double>>"
)


def _tiered(name: str, size: int, base: int) -> tuple:
    step = size // 3
    tiers = [
        (i * step + 1, (i + 1) * step, float(points), -1.0) for i, points in enumerate((3, 4, 5))
    ]
    return (name, size, "tiered", float(base), None, None, 0.0, None, tiers)


# Contest templates (questions, scheme, points).
TEMPLATES = [
    _tiered("IKSC_PRE_ECOLIER", 24, 24),
    _tiered("IKSC_ECOLIER", 24, 24),
    _tiered("IKSC_BENJAMIN", 30, 30),
    _tiered("IKSC_CADET", 30, 30),
    _tiered("IKSC_JUNIOR", 30, 30),
    _tiered("IKSC_STUDENT", 30, 30),
    ("IKLC_PRE_ECOLIER", 25, "flat", 0.0, 2.0, 0.0, 0.0, None, None),
    ("IKLC_ECOLIER", 30, "flat", 0.0, 2.0, 0.0, 0.0, None, None),
    ("IKLC_BENJAMIN", 50, "best_of", 10.0, 1.0, -0.5, 0.0, 40, None),
    ("IKLC_CADET", 50, "best_of", 10.0, 1.0, -0.5, 0.0, 40, None),
    ("IKLC_JUNIOR", 50, "best_of", 10.0, 1.0, -0.5, 0.0, 40, None),
    ("IKLC_STUDENT", 50, "best_of", 10.0, 1.0, -0.5, 0.0, 40, None),
]


def templates_df(spark) -> DataFrame:
    """The contest templates as a small table."""
    return literal_table(spark, TEMPLATES, TEMPLATE_SCHEMA)


def mark_status(student: Column, correct: Column) -> Column:
    """Status of a mark that was found on the sheet."""
    return (
        F.when(student.isNull(), "blank")
        .when(student == "MULTI", "invalid")
        .when(F.upper(student) == F.upper(correct), "correct")
        .otherwise("wrong")
    )


def grade_responses(responses: DataFrame, key: DataFrame, templates: DataFrame) -> DataFrame:
    """One row per sheet and position of its template, with the status of the mark.

    ``responses(sheet_id, template, q, student)``, ``key(template, q, correct)``.
    A position without a response is ``not_found``; responses beyond the
    template are ignored.  Marks are first reduced to one per sheet and
    position (the smallest; a real mark before an empty one), which runs before
    the shuffle as well, so the map built per sheet never exceeds the template.  Of several key entries for one
    position the smallest counts.
    """
    small = templates.select("template", "questions")
    once = key.select("template", F.col("q").cast("int").alias("q"), "correct").groupBy("template", "q").agg(
        F.min("correct").alias("correct"))
    answers = once.join(small, "template").filter(F.col("q").between(1, F.col("questions"))).groupBy("template").agg(
        F.map_from_entries(F.collect_list(F.struct("q", "correct"))).alias("_key"))
    spec = small.join(answers, "template", "left")

    on_sheet = responses.join(small, "template").select(
        "sheet_id", "template",
        F.when(F.col("q").between(1, F.col("questions")), F.col("q").cast("int")).alias("q"),
        "student",
    )
    marks = on_sheet.groupBy("sheet_id", "template", "q").agg(F.min("student").alias("student"))
    sheets = marks.groupBy("sheet_id", "template").agg(
        F.map_from_entries(
            F.collect_list(F.when(F.col("q").isNotNull(), F.struct("q", "student")))
        ).alias("_marks")
    )
    rows = sheets.join(spec, "template").select(
        "sheet_id", "template", "_marks", "_key",
        F.explode(F.sequence(F.lit(1), F.col("questions"))).alias("q"),
    )
    found = F.map_contains_key("_marks", F.col("q"))
    student = F.try_element_at("_marks", F.col("q"))
    correct = F.try_element_at("_key", F.col("q"))
    return rows.select(
        "sheet_id", "template", "q", student.alias("student"), correct.alias("correct"),
        F.when(~found, "not_found").otherwise(mark_status(student, correct)).alias("status"),
    )


def grade_mixed(
    responses: DataFrame, fills: DataFrame, key: DataFrame, templates: DataFrame, text_slots: int
) -> DataFrame:
    """Sheets whose first positions are choices and the others short texts.

    ``templates(template, choices, questions)``; ``fills(sheet_id, template, cx,
    cy, text)``.  Texts are paired with the positions after ``choices`` from
    top to bottom and left to right; more texts than positions are ignored.
    ``text_slots`` is the largest number of text positions of any template and
    is checked against them: it lets every map task keep only that many texts
    of a sheet.  Without a key the status is ``unknown``.
    """
    size = F.col("questions") - F.col("choices")
    slots = templates.select(
        "template", "choices",
        F.when(size > text_slots, F.raise_error(F.lit("text_slots is below the size of a template")))
        .otherwise(F.col("questions")).cast("int").alias("questions"),
    )
    choice_spec = templates.select("template", F.col("choices").alias("questions"))
    picked = grade_responses(responses, key, choice_spec).withColumn("kind", F.lit("choice"))

    ranked = top_n(
        fills.filter(F.trim("text") != ""), ["sheet_id", "template"], ["cy", "cx", "text"], text_slots, "_rn"
    )
    texts = (
        ranked.join(slots, "template")
        .filter(F.col("_rn") <= size)
        .select("sheet_id", "template", (F.col("choices") + F.col("_rn")).alias("q"), "text")
    )
    places = (
        responses.select("sheet_id", "template")
        .unionByName(fills.select("sheet_id", "template"))
        .distinct()
        .join(slots, "template")
        .filter(F.col("questions") > F.col("choices"))
        .select("sheet_id", "template",
                F.explode(F.sequence(F.col("choices") + 1, F.col("questions"))).alias("q"))
    )
    written = (
        places.join(texts, ["sheet_id", "template", "q"], "left")
        .join(key.select("template", F.col("q").cast("int").alias("q"), "correct"), ["template", "q"], "left")
        .select(
            "sheet_id", "template", "q", F.col("text").alias("student"), "correct",
            _text_status(F.col("text"), F.col("correct")).alias("status"),
            F.lit("text").alias("kind"),
        )
    )
    unknown = F.when(
        F.col("correct").isNull() & F.col("status").isin("wrong"), "unknown"
    ).otherwise(F.col("status"))
    return picked.withColumn("status", unknown).unionByName(written)


def _text_status(text: Column, correct: Column) -> Column:
    return (
        F.when(text.isNull(), "blank")
        .when(correct.isNull(), "unknown")
        .when(F.upper(F.trim(text)) == F.upper(F.trim(correct)), "correct")
        .otherwise("wrong")
    )


def _is_correct() -> Column:
    return F.col("status") == "correct"


def _is_wrong() -> Column:
    return F.col("status").isin("wrong", "invalid")


def _is_blank() -> Column:
    return F.col("status").isin("blank", "not_found")


def _tallies() -> list[Column]:
    return [
        F.count_if(_is_correct()).alias("n_correct"),
        F.count_if(_is_wrong()).alias("n_wrong"),
        F.count_if(_is_blank()).alias("n_blank"),
        F.count("*").alias("n_total"),
    ]


_RESULT = ["sheet_id", "template", "score", "n_correct", "n_wrong", "n_blank", "n_total"]


def _tier_points() -> Column:
    """Points of a question by the first tier whose range holds it; 1 and 0 without one."""
    tier = F.try_element_at(
        F.filter("tiers", lambda t: F.col("q").between(t["start"], t["end"])), F.lit(1)
    )
    return (
        F.when(_is_correct(), F.coalesce(tier["correct"], F.lit(1.0)))
        .when(_is_wrong(), F.coalesce(tier["wrong"], F.lit(0.0)))
        .otherwise(0.0)
    )


def _flat_points() -> Column:
    """correct * a + wrong * b + blank * c."""
    return (
        F.col("n_correct") * F.coalesce("correct", F.lit(1.0))
        + F.col("n_wrong") * F.coalesce("wrong", F.lit(0.0))
        + F.col("n_blank") * F.coalesce("blank", F.lit(0.0))
    )


def _best_points() -> Column:
    """The best N question scores.

    A question scores one of three values, so the N best follow from the three
    counts; nothing is collected or ranked.
    """
    piles = F.sort_array(
        F.array(
            F.struct(F.coalesce("correct", F.lit(1.0)).alias("points"), F.col("n_correct").alias("n")),
            F.struct(F.lit(0.0).alias("points"), F.col("n_blank").alias("n")),
            F.struct(F.coalesce("wrong", F.lit(-0.5)).alias("points"), F.col("n_wrong").alias("n")),
        ),
        asc=False,
    )
    best = F.coalesce("count_best", F.lit(40)).cast("long")
    start = F.struct(best.alias("left"), F.lit(0.0).alias("sum"))

    def take(acc, pile):
        n = F.least(acc["left"], pile["n"])
        return F.struct((acc["left"] - n).alias("left"), (acc["sum"] + n * pile["points"]).alias("sum"))

    return F.aggregate(piles, start, take, lambda acc: acc["sum"])


def score_sheets(graded: DataFrame, templates: DataFrame) -> DataFrame:
    """Every sheet by the scheme of its template, in one aggregation: base + points.

    flat: points per status · tiered: points by the range that holds the question · best_of: the best N questions.
    """
    spec = templates.filter(F.col("scheme").isin("flat", "tiered", "best_of"))
    tiers = spec.filter(F.col("scheme") == "tiered").select("template", "tiers")
    by_tier = F.when(F.col("tiers").isNotNull(), _tier_points()).otherwise(0.0)
    sheets = graded.join(tiers, "template", "left").withColumn("_points", by_tier).groupBy(
        "sheet_id", "template").agg(*_tallies(), F.sum("_points").alias("_points"))
    points = (
        F.when(F.col("scheme") == "flat", _flat_points())
        .when(F.col("scheme") == "best_of", _best_points())
        .otherwise(F.col("_points"))
    )
    scored = sheets.join(spec.drop("tiers", "questions"), "template")
    return scored.withColumn("score", F.bround(F.coalesce("base", F.lit(0.0)) + points, 2)).select(*_RESULT)


def score_flat(graded: DataFrame, templates: DataFrame) -> DataFrame:
    """Sheets of the flat templates."""
    return score_sheets(graded, templates.filter(F.col("scheme") == "flat"))


def score_tiered(graded: DataFrame, templates: DataFrame) -> DataFrame:
    """Sheets of the tiered templates."""
    return score_sheets(graded, templates.filter(F.col("scheme") == "tiered"))


def score_best_of(graded: DataFrame, templates: DataFrame) -> DataFrame:
    """Sheets of the best-of templates."""
    return score_sheets(graded, templates.filter(F.col("scheme") == "best_of"))


def score_summary(sheets: DataFrame) -> DataFrame:
    """Sheets, graded, errors, mean, best and worst score per template and overall.

    A sheet with a null score is an error.  Zeros when nothing was graded.
    """
    grouped = sheets.rollup("template").agg(
        F.grouping("template").alias("_all"),
        F.count("*").alias("sheets"),
        F.count("score").alias("graded"),
        F.bround(F.coalesce(F.avg("score"), F.lit(0.0)), 2).alias("average"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("highest"),
        F.coalesce(F.min("score"), F.lit(0.0)).alias("lowest"),
    )
    level = F.when(F.col("_all") == 1, "all").otherwise("template")
    return grouped.select(
        level.alias("level"), "template", "sheets", "graded",
        (F.col("sheets") - F.col("graded")).alias("errors"), "average", "highest", "lowest",
    )


def results_wide(graded: DataFrame, sheets: DataFrame, key: DataFrame, n: int) -> DataFrame:
    """One row per sheet with its marks Q1..Qn, and one answer-key row per template."""
    # A graded sheet has one row per position of its template, so the map is small.
    maps = graded.groupBy("sheet_id", "template").agg(
        F.map_from_entries(F.collect_list(F.struct("q", "student"))).alias("_m")
    )
    marks = maps.select(
        "sheet_id", "template", *[F.try_element_at("_m", F.lit(i)).alias(f"Q{i}") for i in range(1, n + 1)]
    )
    scores = sheets.select("sheet_id", "template", "score", "n_correct", "n_wrong", "n_blank")
    rows = scores.join(marks, ["sheet_id", "template"]).withColumn("row_kind", F.lit("sheet"))
    keys = (
        key.groupBy("template")
        .agg(*[F.max(F.when(F.col("q") == i, F.col("correct"))).alias(f"Q{i}") for i in range(1, n + 1)])
        .withColumn("row_kind", F.lit("answer_key"))
    )
    return rows.unionByName(keys, allowMissingColumns=True)


def practice_result(responses: DataFrame, key: DataFrame, pass_mark: int = 50) -> DataFrame:
    """Correct, wrong and skipped per learner, whole percent and pass flag.

    ``responses(user, q, student)`` has one row per asked question.  Halves
    round up.
    """
    joined = responses.join(key.select("q", "correct"), "q", "left")
    right = F.col("student") == F.col("correct")
    skipped = F.coalesce(F.col("student") == "", F.lit(True))
    tallied = joined.groupBy("user").agg(
        F.count_if(~skipped & F.coalesce(right, F.lit(False))).alias("n_correct"),
        F.count_if(~skipped & ~F.coalesce(right, F.lit(False))).alias("n_wrong"),
        F.count_if(skipped).alias("n_skipped"),
        F.count("*").alias("n_total"),
    )
    percent = F.floor(F.col("n_correct") / F.col("n_total") * 100 + 0.5).cast("int")
    return tallied.withColumn("percent", percent).withColumn("passed", percent >= pass_mark)
