"""Stored trivia payloads of four layouts as one question schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examloom.functions.text import has_text, letter_at, unescape_html

# Subjects of feed categories, and difficulties.
OPENTDB_CATEGORIES = {
    "17": "science", "18": "informatics", "19": "math", "22": "geography", "23": "history", "9": "general", "27": "biology",
}
TRIVIA_CATEGORIES = {
    "science": "science", "science_and_nature": "science", "general_knowledge": "general", "geography": "geography",
    "history": "history", "arts_and_literature": "literature", "music": "music", "film_and_tv": "entertainment",
    "sport_and_leisure": "sports", "food_and_drink": "general", "society_and_culture": "general",
}
NINJA_CATEGORIES = {
    "artliterature": "literature", "language": "literature", "sciencenature": "science", "general": "general",
    "fooddrink": "general", "peopleplaces": "geography", "geography": "geography", "historyholidays": "history",
    "entertainment": "entertainment", "toysgames": "entertainment", "music": "music", "mathematics": "math",
    "religionmythology": "history", "sportsleisure": "sports",
}
DIFFICULTIES = {"easy": "easy", "medium": "medium", "hard": "hard"}
QUIZ_DIFFICULTIES = {"Easy": "easy", "Medium": "medium", "Hard": "hard"}

_NO_OPTIONS = "array<string>"


def _mapped(col: Column, table: dict[str, str], default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.coalesce(col, F.lit(""))), F.lit(default))


def _row(question, options, answer, subject, difficulty, source, question_type="mcq") -> list[Column]:
    return [
        question.alias("question"), options.alias("options"), answer.alias("answer"), subject.alias("subject"),
        difficulty.alias("difficulty"), F.lit(question_type).alias("question_type"), F.lit(source).alias("source"),
        F.lit("international").alias("grade"),
    ]


def _opentdb(df: DataFrame) -> DataFrame:
    item = "struct<question:string,correct_answer:string,incorrect_answers:array<string>,difficulty:string>"
    rows = df.select("category", F.explode(F.from_json("payload", f"results array<{item}>")["results"]).alias("i"))
    right = unescape_html(F.coalesce(F.col("i.correct_answer"), F.lit("")))
    wrong = F.transform("i.incorrect_answers", unescape_html)
    options = F.array_sort(F.concat(F.coalesce(wrong, F.array().cast(_NO_OPTIONS)), F.array(right)))
    return rows.select(*_row(
        unescape_html(F.coalesce(F.col("i.question"), F.lit(""))), options, letter_at(F.array_position(options, right)),
        _mapped(F.col("category").cast("string"), OPENTDB_CATEGORIES, "general"),
        _mapped(F.col("i.difficulty"), DIFFICULTIES, "medium"), "opentdb.com",
    ))


def _trivia(df: DataFrame) -> DataFrame:
    item = ("struct<question:struct<text:string>,correctAnswer:string,incorrectAnswers:array<string>,"
            "category:string,difficulty:string>")
    rows = df.select(F.explode(F.from_json("payload", f"array<{item}>")).alias("i"))
    right = F.coalesce(F.col("i.correctAnswer"), F.lit(""))
    options = F.array_sort(F.concat(F.coalesce(F.col("i.incorrectAnswers"), F.array().cast(_NO_OPTIONS)), F.array(right)))
    return rows.select(*_row(
        F.coalesce(F.col("i.question.text"), F.lit("")), options, letter_at(F.array_position(options, right)),
        _mapped(F.coalesce(F.col("i.category"), F.lit("general_knowledge")), TRIVIA_CATEGORIES, "general"),
        _mapped(F.col("i.difficulty"), DIFFICULTIES, "medium"), "the-trivia-api.com",
    ))


_LETTERS = "abcdef"


def _quizapi(df: DataFrame) -> DataFrame:
    """Answers as a list of objects, or as ``answer_a`` … ``answer_f`` with flags."""
    item = "struct<text:string,question:string,difficulty:string,answers:string,correct_answers:string>"
    rows = df.select(F.explode(F.from_json("payload", f"array<{item}>")).alias("i"))
    listed = F.from_json("i.answers", "array<struct<text:string,isCorrect:boolean>>")
    named = F.from_json("i.answers", "map<string,string>")
    flags = F.from_json("i.correct_answers", "map<string,string>")
    rows = rows.withColumn("_l", F.when(F.col("i.answers").startswith("["), listed)).withColumn(
        "_m", F.when(F.col("i.answers").startswith("{"), named)
    ).withColumn("_f", flags)
    from_list = F.transform("_l", lambda a: F.struct(F.coalesce(a["text"], F.lit("")).alias("t"), F.coalesce(a["isCorrect"], F.lit(False)).alias("ok")))
    from_map = F.filter(
        F.array(*[
            F.struct(F.try_element_at("_m", F.lit(f"answer_{c}")).alias("t"),
                     F.coalesce(F.try_element_at("_f", F.lit(f"answer_{c}_correct")) == "true", F.lit(False)).alias("ok"))
            for c in _LETTERS
        ]),
        lambda a: has_text(a["t"]),
    )
    rows = rows.withColumn("_a", F.when(F.col("_m").isNotNull(), from_map).otherwise(from_list)).filter(F.size("_a") > 0)
    # The last answer marked as right counts; the first one when none is.
    rights = F.filter(F.transform("_a", lambda a, i: F.when(a["ok"], i)), lambda i: i.isNotNull())
    right = F.coalesce(F.try_element_at(rights, F.lit(-1)), F.lit(0))
    question = F.when(has_text(F.col("i.text")), F.col("i.text")).otherwise(F.coalesce(F.col("i.question"), F.lit("")))
    return rows.select(*_row(
        question, F.transform("_a", lambda a: a["t"]), letter_at(right + 1), F.lit("informatics"),
        _mapped(F.col("i.difficulty"), QUIZ_DIFFICULTIES, "medium"), "quizapi.io",
    ))


def _ninjas(df: DataFrame) -> DataFrame:
    """Open questions, as a list of one or a bare object."""
    item = "struct<question:string,answer:string,category:string>"
    listed = F.try_element_at(F.from_json("payload", f"array<{item}>"), F.lit(1))
    rows = df.select(listed.alias("i"))
    category = F.when(has_text(F.col("i.category")), F.lower("i.category")).otherwise("general")
    return rows.select(*_row(
        F.coalesce(F.col("i.question"), F.lit("")), F.array().cast(_NO_OPTIONS), F.coalesce(F.col("i.answer"), F.lit("")),
        _mapped(category, NINJA_CATEGORIES, "general"), F.lit("medium"), "api-ninjas.com", "short_answer",
    ))


_LAYOUTS = {"opentdb": _opentdb, "trivia": _trivia, "quizapi": _quizapi, "ninjas": _ninjas}


def normalize_feeds(raw: dict[str, DataFrame]) -> DataFrame:
    """Union of the given feeds; each has a ``payload`` column (opentdb also ``category``)."""
    out = None
    for name, df in raw.items():
        part = _LAYOUTS[name](df)
        out = part if out is None else out.unionByName(part)
    return out
