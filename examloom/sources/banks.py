"""Question banks as JSON, Moodle XML, QTI XML, plain text and CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from examloom.functions.ranking import split_row_number
from examloom.functions.storage import checkpointed
from examloom.functions.text import has_text, let, squeeze, strip
from examloom.operators.bank import bank_predicate
from examloom.operators.curation import math_text
from examloom.operators.documents import text_questions

_FIELDS = (
    "content:string,question:string,options:array<string>,answer:string,explanation:string,subject:string,"
    "topic:string,grade:string,question_type:string,type:string,difficulty:string,tags:array<string>"
)
_COLUMNS = ["content", "options", "answer", "explanation", "subject", "topic", "grade", "question_type", "difficulty", "tags"]
# Spark takes a record with a string of more than 20 million characters for a broken one unless told otherwise.
JSON_OPTIONS = {"maxStringLen": str(2**31 - 1), "columnNameOfCorruptRecord": "_broken"}


def read_bank_json(spark: SparkSession, path: str, multiline: bool = True, whole: bool = False) -> DataFrame:
    """Questions of JSON files: a bare list, or an object with a ``questions`` list.

    Files are read in ranges, so one huge list is shared between tasks.  ``multiline=False`` reads one question
    per line, which needs no shuffle.  Questions without content are left out and a missing subject is "unknown".
    ``whole=True`` reads an export back with all its rows: null and empty contents and null subjects stay as they
    are, and contents lose only blanks, tabs and line breaks at their ends.  A record that cannot be read gives no row.
    """
    names = [f.split(":")[0] for f in _FIELDS.replace("array<string>", "array").split(",")]
    if multiline:
        schema = _FIELDS.replace(":", " ") + ", _broken string"
        rows = list_records(spark, path).select(F.from_json("record", schema, JSON_OPTIONS).alias("q")).select("q.*")
    else:
        schema = ", ".join(
            f"{n} {'array<string>' if n in ('options', 'tags') else 'string'}" for n in names
        ) + f", questions array<struct<{_FIELDS}>>, _broken string"
        raw = spark.read.options(**JSON_OPTIONS).schema(schema).json(path)
        rows = raw.select("_broken", F.explode(F.coalesce("questions", F.array(F.struct(*names)))).alias("q")).select("_broken", "q.*")
    content = F.coalesce("content", "question")
    content = F.btrim(content, F.lit(" \n\t\r")) if whole else strip(content)
    kept = has_text(content) | F.col("_broken").isNull() if whole else has_text(content)
    return rows.filter(kept).select(
        content.alias("content"),
        F.when(F.size("options") > 0, F.col("options")).alias("options"),
        F.coalesce("answer", F.lit("")).alias("answer"),
        F.coalesce("explanation", F.lit("")).alias("explanation"),
        (F.col("subject") if whole else F.coalesce("subject", F.lit("unknown"))).alias("subject"),
        F.coalesce("topic", F.lit("")).alias("topic"),
        F.coalesce("grade", F.lit("")).alias("grade"),
        F.coalesce("question_type", "type", F.lit("mcq")).alias("question_type"),
        F.coalesce("difficulty", F.lit("medium")).alias("difficulty"),
        F.when(F.size("tags") > 0, F.col("tags")).alias("tags"),
        F.lit("import_json").alias("source"),
    )


def list_records(spark: SparkSession, path: str, member: str = "questions") -> DataFrame:
    """file, place and text of every object of the JSON lists in files: a bare list, or the list ``member`` of an object.

    A file whose object has no such list gives its outermost objects.  Files are cut at every ``}``, in ranges of
    bytes.  Whether a piece begins inside a string, and how deep, follows from the pieces before it: each range
    reports what it does to both, the reports are added up per file, and then each range places its own pieces.
    An object ends where the depth of the list is reached again; its pieces are put together by their places.
    A range is one sorted group, as large as ``spark.sql.files.maxPartitionBytes`` allows.
    """
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    pieces = spark.read.option("lineSep", "}").text(path).select(
        file.alias("file"), start.alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"))
    # Without escapes, quotes are the ends of strings: every second part between them lies outside.
    parts = F.split(F.regexp_replace("piece", r"(?s)\\.", ""), '"', -1)
    outside = lambda odd: F.array_join(F.filter(parts, lambda x, i: i % 2 == odd), "")
    pieces = pieces.select(
        "*", (F.size(parts) - 1).alias("quotes"),
        *[F.regexp_replace(outside(odd), r"[^\[\]{]", "").alias(f"marks{odd}") for odd in (0, 1)])
    change = lambda marks: F.length(F.translate(marks, "]", "")) - F.length(F.translate(marks, "[{", ""))

    within = Window.partitionBy("file", "start").orderBy("at")
    inside = F.sum("quotes").over(within.rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.withColumn("odd", F.coalesce(inside, F.lit(0)) % 2)
    # depth after a piece and its brace, for a range that begins outside a string (0) or in one (1)
    for k in (0, 1):
        flipped = (F.col("odd") + k) % 2
        marks = F.when(flipped == 0, F.col("marks0")).otherwise(F.col("marks1"))
        closes = ((flipped + F.col("quotes")) % 2 == 0).cast("int")
        pieces = pieces.withColumn(f"m{k}", marks).withColumn(f"closes{k}", closes)
        pieces = pieces.withColumn(f"d{k}", F.sum(change(F.col(f"m{k}")) - F.col(f"closes{k}")).over(within))
    pieces = checkpointed(pieces.select(
        "file", "start", "at", "piece", "quotes", "odd", "m0", "m1", "closes0", "closes1", "d0", "d1"))

    along = Window.partitionBy("file").orderBy("start")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    ranges = pieces.groupBy("file", "start").agg(
        F.sum("quotes").alias("quotes"), F.max_by("d0", "at").alias("d0"), F.max_by("d1", "at").alias("d1"))
    ranges = ranges.withColumn("in", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    ranges = ranges.withColumn("base", F.coalesce(F.sum(F.when(F.col("in") == 0, F.col("d0")).otherwise(F.col("d1"))).over(before), F.lit(0)))

    either = lambda name: F.when(F.col("in") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    placed = pieces.join(ranges.select("file", "start", "in", "base"), ["file", "start"]).select(
        "file", "start", "at", "piece", either("m").alias("marks"), (either("closes") == 1).alias("closes"),
        (F.col("base") + either("d")).alias("depth"), ((F.col("odd") + F.col("in")) % 2).alias("quoted"))
    began = F.col("depth") + F.col("closes").cast("int") - change(F.col("marks"))
    lead = F.regexp_extract("piece", rf'(?s)^(.*?"{member}"\s*:\s*\[)', 1)
    lead_parts = F.split(F.regexp_replace(lead, r"(?s)\\.", ""), '"', -1)
    lead_marks = F.regexp_replace(F.array_join(F.filter(lead_parts, lambda x, i: i % 2 == F.col("quoted")), ""), r"[^\[\]{]", "")
    opens = (lead != "") & (F.col("began") + change(lead_marks) == 2)
    # the lowest depth in a piece, or in what follows the opening of the list
    lowest = F.aggregate(
        F.split(F.when(F.col("opens"), F.substring("marks", F.length(lead_marks) + 1, F.length("marks"))).otherwise(F.col("marks")), ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("low")),
        lambda a, c: let(a["now"] + F.when(c == "]", -1).when(c == "", 0).otherwise(1), lambda n: F.struct(
            n.alias("now"), F.least(n, a["low"]).alias("low"))), lambda a: a["low"])
    placed = placed.withColumn("began", began)
    placed = placed.withColumn("opens", opens).withColumn("low", F.when(F.col("opens"), 2 + lowest).when(F.col("began") <= 2, F.col("began") + lowest))

    spot = F.struct("start", "at")
    kinds = placed.groupBy("file").agg(
        F.ltrim(F.min_by("piece", spot)).startswith("[").alias("list"), F.min(F.when(F.col("opens"), spot)).alias("opened"))
    # the list ends in the first piece that falls below it
    ends = placed.join(kinds.select("file", "opened"), "file").where((spot >= F.col("opened")) & (F.col("low") < 2))
    ends = ends.groupBy("file").agg(F.min(spot).alias("ended"))
    kinds = kinds.join(ends, "file", "left").withColumn(
        "level", F.when(F.col("list"), 1).when(F.col("opened").isNotNull(), 2).otherwise(0))
    inner = (F.col("level") < 2) | ((spot >= F.col("opened")) & (F.col("ended").isNull() | (spot < F.col("ended"))))
    kept = placed.join(kinds, "file").where(inner).select(
        "file", "start", "at", "level",
        F.when((F.col("level") == 2) & F.col("opens") & (spot == F.col("opened")), F.substring("piece", F.length(lead) + 1, F.length("piece")))
        .otherwise(F.col("piece")).alias("piece"),
        (F.col("closes") & (F.col("depth") == F.col("level"))).cast("int").alias("last"))
    # objects are numbered by the ends before them
    ended = kept.groupBy("file", "start").agg(F.sum("last").alias("n"))
    ended = ended.select("file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("done"))
    earlier = F.coalesce(F.sum("last").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = kept.withColumn("earlier", earlier).join(ended, ["file", "start"]).withColumn("place", F.col("done") + F.col("earlier"))
    whole = numbered.groupBy("file", "place").agg(
        F.array_sort(F.collect_list(F.struct("start", "at", "piece"))).alias("p"), F.max("last").alias("whole"))
    text = F.concat(F.array_join(F.transform("p", lambda x: x["piece"]), "}"), F.lit("}"))
    return whole.where("whole = 1").select("file", "place", F.regexp_replace(text, r"^[^{]*", "").alias("record"))


def _selected(bank: DataFrame, limit: int | None, filters: dict) -> DataFrame:
    """Filtered rows, newest first; at most ``limit`` when given."""
    test = bank_predicate(**filters)
    rows = bank if test is None else bank.filter(test)
    rows = rows.orderBy(F.col("created_at").desc(), F.col("id").desc())
    return rows if limit is None else rows.limit(limit)


def write_bank_json(bank: DataFrame, path: str, limit: int | None = None, **filters) -> None:
    """One JSON object per row, newest first; missing lists become empty."""
    none = F.array().cast("array<string>")
    columns = [
        F.coalesce(F.col(c), none).alias(c) if c in ("options", "tags") and c in bank.columns
        else (none.alias(c) if c in ("options", "tags") else (F.col(c) if c in bank.columns else F.lit(None).cast("string").alias(c)))
        for c in _COLUMNS
    ]
    _selected(bank, limit, filters).select(*columns).write.option("ignoreNullFields", False).json(path)


# Question types of the exchange format.
MOODLE_TYPES = {
    "multichoice": "mcq", "truefalse": "mcq", "shortanswer": "blank", "essay": "essay", "matching": "matching", "numerical": "blank",
}
_MOODLE_SCHEMA = (
    "_type string, name struct<text:string>, questiontext struct<_format:string,text:string>, "
    "answer array<struct<_fraction:string,text:string>>, generalfeedback struct<_format:string,text:string>"
)


def read_moodle_xml(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a Moodle quiz; categories and empty texts are left out.

    The text falls back to the name.  The last answer with a positive fraction is the right one.
    """
    raw = spark.read.format("xml").option("rowTag", "question").schema(_MOODLE_SCHEMA).load(path)
    kind = F.coalesce("_type", F.lit("multichoice"))
    text = F.when(has_text(F.col("questiontext.text")), F.col("questiontext.text")).otherwise(F.col("name.text"))
    filled = F.filter("answer", lambda a: has_text(a["text"]))
    options = F.transform(filled, lambda a: a["text"])
    right = F.filter(filled, lambda a: F.coalesce(a["_fraction"].try_cast("double"), F.lit(0.0)) > 0)
    mapped = F.element_at(F.create_map(*[F.lit(x) for kv in MOODLE_TYPES.items() for x in kv]), kind)
    return raw.filter((kind != "category") & has_text(text)).select(
        text.alias("content"),
        F.when(F.size(options) > 0, options).alias("options"),
        F.coalesce(F.try_element_at(right, F.lit(-1))["text"], F.lit("")).alias("answer"),
        F.lit("imported").alias("subject"),
        F.coalesce(mapped, F.lit("mcq")).alias("question_type"),
        F.lit("medium").alias("difficulty"),
        F.lit("import_moodle").alias("source"),
    )


def write_moodle_xml(bank: DataFrame, path: str, limit: int | None = None, **filters) -> None:
    """One ``<question>`` per row; fraction 100 for the option equal to the answer."""
    rows = _selected(bank, limit, filters)
    fraction = lambda o: F.when(o == F.col("answer"), "100").otherwise("0")
    feedback = (
        F.when(has_text(F.col("explanation")), F.struct(F.lit("html").alias("_format"), F.col("explanation").alias("text")))
        if "explanation" in bank.columns
        else F.lit(None).cast("struct<_format:string,text:string>")
    )
    rows.select(
        F.when(F.col("question_type") == "mcq", "multichoice").otherwise("shortanswer").alias("_type"),
        F.struct(F.substring("content", 1, 100).alias("text")).alias("name"),
        F.struct(F.lit("html").alias("_format"), F.col("content").alias("text")).alias("questiontext"),
        F.transform("options", lambda o: F.struct(fraction(o).alias("_fraction"), o.alias("text"))).alias("answer"),
        feedback.alias("generalfeedback"),
    ).write.format("xml").option("rootTag", "quiz").option("rowTag", "question").save(path)


_QTI_SCHEMA = (
    "_identifier string, _title string, responseDeclaration struct<correctResponse:struct<value:string>>, "
    "itemBody struct<p:array<string>,choiceInteraction:struct<simpleChoice:array<struct<_VALUE:string,_identifier:string>>>>"
)


def read_qti_xml(spark: SparkSession, path: str, with_choices: bool = True) -> DataFrame:
    """QTI 2.1 items: the whole body text, choices, and the choice named as correct.

    The body text includes its choices; ``with_choices=False`` keeps the paragraphs only.
    """
    raw = spark.read.format("xml").option("rowTag", "assessmentItem").schema(_QTI_SCHEMA).load(path)
    choices = F.coalesce(
        F.col("itemBody.choiceInteraction.simpleChoice"), F.array().cast("array<struct<_VALUE:string,_identifier:string>>")
    )
    options = F.filter(F.transform(choices, lambda c: squeeze(c["_VALUE"])), lambda x: x != "")
    right = F.filter(choices, lambda c: c["_identifier"] == F.col("responseDeclaration.correctResponse.value"))
    parts = F.coalesce(F.col("itemBody.p"), F.array().cast("array<string>"))
    body = squeeze(F.array_join(F.concat(parts, options) if with_choices else parts, " "))
    content = F.when(body != "", body).otherwise(squeeze(F.coalesce("_title", F.lit(""))))
    return raw.filter(F.col("itemBody").isNotNull() & (content != "")).select(
        content.alias("content"),
        F.when(F.size(options) > 0, options).alias("options"),
        F.coalesce(squeeze(F.try_element_at(right, F.lit(1))["_VALUE"]), F.lit("")).alias("answer"),
        F.lit("imported").alias("subject"),
        F.lit("mcq").alias("question_type"),
        F.lit("medium").alias("difficulty"),
        F.lit("import_qti").alias("source"),
    )


def _numbered(rows: DataFrame, order: list) -> DataFrame:
    """Add ``n`` 1..N over a whole table without bringing it to one task."""
    return split_row_number(rows.withColumn("_all", F.lit(1)), ["_all"], order, "n").drop("_all")


def write_qti_xml(bank: DataFrame, path: str, limit: int | None = None, **filters) -> None:
    """QTI items numbered from 1; the first choice is right when the answer is not among the options."""
    test = bank_predicate(**filters)
    rows = bank if test is None else bank.filter(test)
    order = [F.col("created_at").desc(), F.col("id").desc()]
    if limit is not None:
        rows = rows.orderBy(*order).limit(limit)
    numbered = _numbered(rows.select("id", "created_at", "content", "options", "answer"), order)
    place = F.array_position("options", F.col("answer"))
    right = F.greatest(place - 1, F.lit(0))
    correct = F.when(
        (F.size("options") > 0) & has_text(F.col("answer")),
        F.struct(F.concat(F.lit("choice_"), right).alias("value")),
    )
    choices = F.transform(
        "options", lambda o, i: F.struct(o.alias("_VALUE"), F.concat(F.lit("choice_"), i).alias("_identifier"))
    )
    interaction = F.when(
        F.size("options") > 0,
        F.struct(F.lit("RESPONSE").alias("_responseIdentifier"), F.lit("false").alias("_shuffle"),
                 F.lit("1").alias("_maxChoices"), choices.alias("simpleChoice")),
    )
    numbered.select(
        F.concat(F.lit("item_"), "n").alias("_identifier"),
        F.substring("content", 1, 50).alias("_title"),
        F.struct(
            F.lit("RESPONSE").alias("_identifier"), F.lit("single").alias("_cardinality"),
            F.lit("identifier").alias("_baseType"), correct.alias("correctResponse"),
        ).alias("responseDeclaration"),
        F.struct(F.array("content").alias("p"), interaction.alias("choiceInteraction")).alias("itemBody"),
    ).write.format("xml").option("rootTag", "assessmentTest").option("rowTag", "assessmentItem").save(path)


def write_question_text(bank: DataFrame, path: str, fmt: str = "csv") -> None:
    """Questions with formulas as plain text: one per line, or CSV with numbers from 1 by ``id``.

    Rows are put in order first, so that taking samples for the ranges does not work formulas out.
    """
    rows = bank.select("id", "content")
    ordered = _numbered(rows, ["id"]).select(F.col("n").alias("id"), "content") if fmt == "csv" else rows.orderBy("id")
    plain = math_text(ordered, "content").select("id", F.col("plain_text").alias("question"))
    if fmt == "csv":
        plain.write.option("header", True).option(
            "escape", '"'
        ).option("quoteAll", False).csv(path)
    else:
        plain.select("question").write.text(path)


def read_text_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Questions of the ``.txt`` and ``.md`` files under subject folders."""
    files = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md}")
        .text(root, wholetext=True).select(F.col("_metadata.file_path").alias("_path"), F.col("value").alias("_text"))
    )
    path = F.try_url_decode(F.col("_path"))
    return files.select(
        F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1).alias("subject"),
        F.regexp_extract(path, r"/([^/]+)$", 1).alias("file"),
        F.posexplode(text_questions(F.col("_text"))).alias("pos", "question"),
    )
