"""Building exams from a bank: matrix picks, shuffling, variants, exam tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examloom.functions.ranking import split_row_number, top_n
from examloom.functions.small import literal_table
from examloom.functions.text import answer_letter, has_text, let, letter_at, seeded
from examloom.operators.bank import DIFFICULTIES

CELL_SCHEMA = (
    "cell int, topic string, topic_label string, difficulty string, requested int"
)


def matrix_cells(spark, matrix: list[dict]) -> DataFrame:
    """Cells of an exam matrix in filling order; cells asking for nothing are left out.

    A matrix is a form filled in by hand, so it is a plain list.
    """
    cells = _cell_rows(matrix)
    return literal_table(spark, cells, CELL_SCHEMA)


def _cell_rows(matrix: list[dict]) -> list[tuple]:
    cells = []
    for row in matrix:
        topic = row.get("topic") or None
        label = row.get("topic_label", row.get("topic", ""))
        for difficulty in DIFFICULTIES:
            n = int(row.get(difficulty, 0) or 0)
            if n > 0:
                cells.append((len(cells) + 1, topic, label, difficulty, n))
    return cells


def matrix_pick(
    bank: DataFrame,
    matrix: list[dict],
    subject: str,
    question_type: str | None = "mcq",
    grade: str | None = None,
    seed="0",
    oversample: int = 3,
) -> DataFrame:
    """Pick answerable rows for every cell: least used first, random among equals.

    Each cell takes its ``requested * oversample`` least-used rows and keeps a
    random ``requested`` of them.  No row is picked twice.  An earlier cell can
    take at most what it asks for, so the first ``requested * oversample`` +
    (everything asked before) rows of a cell decide the pick.  Each map task
    keeps no more than that, and the sequential choice between overlapping
    cells sees only these few rows.
    """
    cells = _cell_rows(matrix)
    spark = bank.sparkSession
    if not cells:
        return bank.limit(0).select(
            F.lit(0).alias("cell"), F.lit(0).cast("long").alias("place"), *bank.columns
        )
    test = (F.col("subject") == subject) & has_text(F.col("answer"))
    if question_type:
        test = test & (F.col("question_type") == question_type)
    if grade:
        test = test & (F.col("grade") == grade)

    asked_before, need = 0, []
    for cell, topic, _label, difficulty, n in cells:
        need.append((cell, topic, difficulty, n, n * oversample + asked_before))
        asked_before += n
    spec = literal_table(
        spark, need, "cell int, _topic string, _difficulty string, _n int, _keep int"
    )
    fits = (F.col("difficulty") == F.col("_difficulty")) & (
        F.col("_topic").isNull() | (F.col("topic") == F.col("_topic"))
    )
    # Rank on ids alone; the full rows are fetched for the winners only.
    slim = bank.filter(test).select("id", "topic", "difficulty", "times_used")
    candidates = (
        slim.join(spec, fits)  # a literal of the plan, as long as the matrix
        .withColumn("_luck", seeded(seed, F.col("id")))
        .withColumn("_draw", seeded(f"{seed}/", F.col("id")))
    )
    order = [F.col("times_used").asc_nulls_first(), "_luck", "id"]
    ranked = top_n(candidates, ["cell"], order, max(k for *_, k in need), "_rank").filter(
        F.col("_rank") <= F.col("_keep")
    )
    if _disjoint(cells):
        chosen = ranked.filter(F.col("_rank") <= F.col("_n") * oversample)
        draw = ["_rank"] if oversample == 1 else ["_draw", "id"]
        picked = chosen.withColumn(
            "place", F.row_number().over(Window.partitionBy("cell").orderBy(*draw)).cast("long")
        ).filter(F.col("place") <= F.col("_n"))
        picks = picked.select("cell", "place", F.col("id").alias("_id"))
    else:
        picks = _filled_in_turn(ranked, oversample)
    # The same filters again, so that the scan for the full rows is pruned as well.
    rows = bank.filter(test).join(picks, F.col("id") == F.col("_id"))
    return rows.select("cell", "place", *bank.columns)


def _disjoint(cells: list[tuple]) -> bool:
    """True when no row can fit two cells."""
    for difficulty in DIFFICULTIES:
        topics = [c[1] for c in cells if c[3] == difficulty]
        if len(topics) != len(set(topics)) or (None in topics and len(topics) > 1):
            return False
    return True


def _filled_in_turn(ranked: DataFrame, oversample: int) -> DataFrame:
    """Fill overlapping cells one after the other: a fold over the cells that carries the ids taken so far.

    The candidates of all cells meet in one row; they are no more than the matrix bounds.
    """
    rows = F.sort_array(F.collect_list(F.struct("_rank", "id", "_draw", "_n")))
    cells = ranked.groupBy("cell").agg(rows.alias("rows")).agg(F.sort_array(F.collect_list(F.struct("cell", "rows"))).alias("cells"))
    kind = ranked.schema["id"].dataType.simpleString()
    start = F.struct(
        F.array().cast(f"array<{kind}>").alias("taken"), F.array().cast(f"array<struct<cell:int,place:bigint,_id:{kind}>>").alias("picks"))

    def filled(acc, c):
        n = F.get(c["rows"], 0)["_n"]
        free = F.slice(F.filter(c["rows"], lambda r: ~F.array_contains(acc["taken"], r["id"])), F.lit(1), n * oversample)
        if oversample > 1:
            free = F.sort_array(F.transform(free, lambda r: F.struct(r["_draw"].alias("_draw"), r["id"].alias("id"))))
        ids = F.transform(F.slice(free, F.lit(1), n), lambda r: r["id"])
        return let(ids, lambda xs: F.struct(F.concat(acc["taken"], xs).alias("taken"), F.concat(acc["picks"], F.transform(
            xs, lambda x, i: F.struct(c["cell"].alias("cell"), (i + 1).cast("bigint").alias("place"), x.alias("_id")))).alias("picks")))

    picks = F.aggregate("cells", start, filled, lambda acc: acc["picks"])
    return cells.select(F.explode_outer(picks).alias("p")).where("p is not null").select("p.*")


def shuffle_options(
    picks: DataFrame, seed="0", id_col="id", options_col="options", answer_col="answer"
) -> DataFrame:
    """Permute the options; a letter answer moves along with its option."""
    keyed = picks.withColumn("_letter", answer_letter(answer_col)).withColumn(
        "_shuffled", shuffled_options(seed, F.col(id_col), F.col(options_col))
    )
    right = F.try_element_at(F.col(options_col), F.ascii("_letter") - F.lit(64))
    moved = letter_at(F.array_position("_shuffled", right))
    answer = F.when(has_text(right), moved).otherwise(F.col(answer_col))
    return (
        keyed.withColumn(answer_col, answer)
        .withColumn(options_col, F.col("_shuffled"))
        .drop("_letter", "_shuffled")
    )


def shuffled_options(seed, id_col: Column, options: Column) -> Column:
    """Options in the order of a seeded digest of (id, place)."""
    tagged = F.transform(
        options,
        lambda o, i: F.struct(
            seeded(seed, id_col, F.lit("|"), i).alias("k"), i.alias("i"), o.alias("o")
        ),
    )
    return F.transform(F.array_sort(tagged), lambda s: s["o"])


def pick_report(cells: DataFrame, picks: DataFrame) -> DataFrame:
    """Requested against picked per cell, with the shortfall in words."""
    got = picks.groupBy("cell").agg(F.count("*").alias("_got"))
    joined = cells.join(got, "cell", "left")
    picked = F.coalesce(F.col("_got"), F.lit(0))
    short = F.concat(
        F.col("topic_label"), F.lit("/"), F.col("difficulty"), F.lit(": cần "),
        F.col("requested"), F.lit(", có "), picked,
    )
    return joined.select(
        "cell", "topic", "topic_label", "difficulty", "requested",
        picked.alias("picked"),
        F.when(picked < F.col("requested"), short).alias("shortfall"),
    )


def pick_totals(report: DataFrame) -> DataFrame:
    """Totals of a report."""
    return report.agg(
        F.coalesce(F.sum("requested"), F.lit(0)).alias("total_requested"),
        F.coalesce(F.sum("picked"), F.lit(0)).alias("total_picked"),
        F.count("shortfall").alias("shortfalls"),
    )


def pick_answer_key(picks: DataFrame) -> DataFrame:
    """The picks of one exam, numbered through all cells, as ``n. answer`` lines."""
    line = F.when(
        has_text(F.col("answer")), F.concat(F.col("q_num").cast("string"), F.lit(". "), F.col("answer"))
    )
    numbered = split_row_number(picks.withColumn("_all", F.lit(1)), ["_all"], ["cell", "place"], "q_num")
    return numbered.withColumn("q_num", F.col("q_num").cast("int")).select("q_num", "cell", "id", "answer", line.alias("line"))


def exam_variants(
    exam_questions: DataFrame, bank: DataFrame, codes: list[str], seed="0"
) -> DataFrame:
    """Shuffled versions of every exam, one row per exam, code and question.

    ``position`` is the place in the new order.  ``original``, ``shuffled`` and
    ``shuffled_options`` are set when the question has two options or more and
    its answer is among them.  The long form keeps an exam of any size off a
    single task.
    """
    rows = exam_questions.select("exam_id", "question_id", "order").withColumn(
        "variant_code", F.explode(F.array(*[F.lit(c) for c in codes]))
    )
    rows = rows.withColumn(
        "_luck",  # bytes sort as their digits do, and are half as long
        F.unhex(seeded(seed, F.col("exam_id"), F.lit("|"), F.col("variant_code"), F.lit("|"),
                       F.col("question_id"), F.lit("|"), F.col("order"))),
    )
    placed = split_row_number(
        rows, ["exam_id", "variant_code"], ["_luck", "question_id", "order"], "position"
    ).drop("_luck")
    q = bank.select(F.col("id").alias("_id"), "options", "answer")
    joined = placed.join(q, F.col("question_id") == F.col("_id"), "left")
    usable = (F.size("options") >= 2) & F.array_contains("options", F.col("answer"))
    joined = joined.withColumn(
        "shuffled_options",
        F.when(
            usable,
            shuffled_options(
                seed, F.concat(F.col("variant_code"), F.lit("|"), F.col("question_id")), F.col("options")
            ),
        ),
    )
    original = F.when(usable, letter_at(F.array_position("options", F.col("answer"))))
    shuffled = F.when(usable, letter_at(F.array_position("shuffled_options", F.col("answer"))))
    return joined.select(
        "exam_id", "variant_code", "position", "question_id",
        original.alias("original"), shuffled.alias("shuffled"), "shuffled_options",
    )


def exam_list(
    exams: DataFrame, variants: DataFrame, subject: str | None = None, skip: int = 0, limit: int = 100
) -> DataFrame:
    """Exams of a subject, newest first, with the number of variants."""
    rows = exams if not subject else exams.filter(F.col("subject") == subject)
    page = rows.orderBy(F.col("created_at").desc(), F.col("exam_id").desc()).offset(skip).limit(limit)
    shown = F.broadcast(page.select("exam_id"))  # one page
    made = variants.join(shown, "exam_id", "left_semi").groupBy("exam_id").agg(F.count("*").alias("_made"))
    return (
        page.join(made, "exam_id", "left")
        .withColumn("variant_count", F.coalesce("_made", F.lit(0)))
        .drop("_made")
    )


def exam_expand(
    exams: DataFrame, exam_questions: DataFrame, bank: DataFrame, variants: DataFrame
) -> DataFrame:
    """Every question of every exam with its exam, its place and its content.

    One row per exam question, never one nested row per exam, so that a very
    long exam stays spread over tasks.
    """
    made = variants.groupBy("exam_id").agg(F.count("*").alias("_made"))
    heads = exams.join(made, "exam_id", "left").withColumn(
        "variant_count", F.coalesce("_made", F.lit(0))
    ).drop("_made")
    q = bank.withColumnRenamed("id", "question_id")
    clash = [c for c in q.columns if c in heads.columns]
    for c in clash:
        q = q.withColumnRenamed(c, f"question_{c}")
    return exam_questions.join(q, "question_id").join(heads, "exam_id")


def exam_append(
    exam_questions: DataFrame, additions: DataFrame, removals: DataFrame | None = None
) -> DataFrame:
    """Append ordered ids after the last place of their exam; drop removed ones first.

    ``additions`` has (exam_id, question_ids array); an array is one row.  Several arrays for one exam follow
    one another in the order of their values.
    """
    kept = exam_questions
    if removals is not None:
        kept = kept.join(removals.select("exam_id", "question_id").distinct(),
                         ["exam_id", "question_id"], "left_anti")
    last = kept.groupBy("exam_id").agg(F.max("order").alias("_last"))
    several = Window.partitionBy("exam_id").orderBy("question_ids").rowsBetween(Window.unboundedPreceding, -1)
    held = additions.select("exam_id", "question_ids").withColumn(
        "_before", F.coalesce(F.sum(F.size("question_ids")).over(several), F.lit(0)))
    fresh = (
        held.join(last, "exam_id", "left")
        .select("exam_id", (F.coalesce("_last", F.lit(0)) + F.col("_before")).alias("_last"),
                F.posexplode("question_ids").alias("_i", "question_id"))
        .select("exam_id", "question_id",
                (F.col("_last") + F.col("_i") + 1).cast("int").alias("order"),
                F.lit(1.0).alias("points"))
    )
    return kept.select("exam_id", "question_id", "order", "points").unionByName(fresh)


def exam_totals(exam_questions: DataFrame) -> DataFrame:
    """Number of questions per exam."""
    return exam_questions.groupBy("exam_id").agg(F.count("*").alias("total_questions"))


def sample_mix(
    pool_a: DataFrame, pool_b: DataFrame, n: int, ratio: float, seed="0", id_col: str = "id"
) -> DataFrame:
    """A sample of ``n`` rows: ``round(n * ratio)`` of pool a (halves to even), the others of pool b.

    A pool smaller than its share is repeated from the start.
    """
    n_a = round(n * ratio)
    return _draw(pool_a, n_a, f"{seed}a", id_col).unionByName(
        _draw(pool_b, n - n_a, f"{seed}b", id_col)
    )


def _draw(pool: DataFrame, n: int, seed: str, id_col: str) -> DataFrame:
    columns = pool.columns
    lucky = pool.withColumn("_all", F.lit(1)).withColumn("_luck", seeded(seed, F.col(id_col)))
    ranked = split_row_number(lucky, ["_all"], ["_luck", id_col], "_rn").filter(F.col("_rn") <= n)
    size = ranked.groupBy("_all").agg(F.count("*").alias("_size"))
    # A short pool is repeated until n places are filled.
    rounds = F.sequence(F.lit(0), F.floor((F.lit(n) - F.col("_rn")) / F.col("_size")).cast("int"))
    return ranked.join(size, "_all").withColumn("copy", F.explode(rounds)).select("copy", *columns)


def quiz_sample(
    bank: DataFrame, section: str | None = None, n: int | None = None, seed="0",
    section_col: str = "topic",
) -> DataFrame:
    """All questions, those of one section, or a random ``n`` of them."""
    rows = bank if section is None else bank.filter(F.col(section_col) == section)
    if n is None:
        return rows
    return rows.orderBy(seeded(seed, F.col("id")), "id").limit(n)
