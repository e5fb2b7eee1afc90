"""Queries over the bank, exam assembly and grading."""

from __future__ import annotations

from pyspark.sql import functions as F

from examloom import schemas
from examloom.operators import assemble, bank as ops, grading
from examloom.plans import bindings as b
from examloom.plans.registry import query

WITH = "WITH " + b.BANK_SQL


def slim(df):
    """Bank columns that compare well."""
    return df.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd")).drop("options")


SLIM = "* EXCLUDE (created_at, options), strftime(created_at, '%Y-%m-%d') AS created_at"


@query("bank_overview", WITH + """
SELECT count(*) AS total, count(*) FILTER (answer <> '') AS with_answer,
  count(*) FILTER (explanation <> '') AS with_explanation, count(*) FILTER (image_url <> '') AS with_image,
  count(*) FILTER (times_used > 0) AS total_used, count(*) - count(*) FILTER (answer <> '') AS without_answer,
  round_even(count(*) FILTER (answer <> '') / count(*) * 100, 1) AS answer_rate FROM bank""")
def bank_overview(t):
    return ops.bank_overview(b.bank(t))


@query("facet_counts", WITH + """
SELECT 'subject' AS facet, subject AS value, count(*) AS total, count(answer) AS has_answer, sum(times_used)::BIGINT AS sum_used FROM bank GROUP BY subject
UNION ALL SELECT 'difficulty', difficulty, count(*), count(answer), sum(times_used)::BIGINT FROM bank GROUP BY difficulty
UNION ALL SELECT 'grade', grade, count(*), count(answer), sum(times_used)::BIGINT FROM bank WHERE grade <> '' GROUP BY grade
UNION ALL SELECT 'question_type', question_type, count(*), count(answer), sum(times_used)::BIGINT FROM bank GROUP BY question_type""")
def facet_counts(t):
    return ops.facet_counts(b.bank(t))


@query("subject_difficulty_stats", WITH + """
SELECT subject, count(*) FILTER (difficulty = 'easy') AS easy, count(*) FILTER (difficulty = 'medium') AS medium,
  count(*) FILTER (difficulty = 'hard') AS hard, count(*) AS total FROM bank GROUP BY subject""")
def subject_difficulty_stats(t):
    return ops.subject_difficulty_stats(b.bank(t))


@query("top_sources", WITH + """
SELECT source, count(*) AS total FROM bank WHERE source <> '' GROUP BY source ORDER BY total DESC, source LIMIT 10""")
def top_sources(t):
    return ops.top_sources(b.bank(t))


@query("daily_activity", WITH + f"""
SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS total FROM bank
WHERE created_at >= TIMESTAMP '{b.AS_OF}' - INTERVAL 14 DAY GROUP BY 1""")
def daily_activity(t):
    return ops.daily_activity(b.bank(t), b.AS_OF).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("bank_availability", WITH + """
, rows AS (SELECT coalesce(nullif(topic, ''), '(chưa phân loại)') AS topic, difficulty, times_used FROM bank
  WHERE subject = 'en' AND question_type = 'mcq' AND answer <> '')
SELECT 'topic' AS level, topic, difficulty, count(*) AS total, round_even(avg(times_used), 1) AS avg_used FROM rows GROUP BY topic, difficulty
UNION ALL SELECT 'difficulty', NULL, difficulty, count(*), round_even(avg(times_used), 1) FROM rows GROUP BY difficulty""")
def bank_availability(t):
    return ops.bank_availability(b.bank(t), "en")


@query("bank_filter", WITH + f"""
SELECT {SLIM} FROM bank WHERE subject = 'en' AND difficulty = 'medium' AND question_type = 'mcq' AND content ILIKE '%THE%'
ORDER BY bank.created_at DESC, id DESC LIMIT 100 OFFSET 20""")
def bank_filter(t):
    return slim(ops.bank_filter(
        b.bank(t), subject="en", difficulty="medium", question_type="mcq", search="THE", skip=20, limit=100))


@query("bank_filter_count", WITH + """
SELECT count(*) AS total FROM bank WHERE subject = 'fr' AND topic = 't1' AND content ILIKE '%que%'""")
def bank_filter_count(t):
    return ops.bank_filter_count(b.bank(t), subject="fr", topic="t1", search="que")


@query("missing_answers", WITH + """
SELECT 'subject' AS level, subject, count(*) AS missing FROM bank WHERE coalesce(answer, '') = '' GROUP BY subject
UNION ALL SELECT 'total', NULL, count(*) FROM bank WHERE coalesce(answer, '') = ''""")
def missing_answers(t):
    return ops.missing_answers(b.bank(t))


@query("missing_answer_samples", WITH + """
SELECT id, CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END AS content, subject, source
FROM bank WHERE coalesce(answer, '') = '' AND subject = 'de' ORDER BY id LIMIT 100""")
def missing_answer_samples(t):
    return ops.missing_answer_samples(b.bank(t), subject="de")


DELETED = "topic = 't2' AND difficulty = 'easy' AND source LIKE 'src1%'"


@query("bank_delete", WITH + f"SELECT {SLIM} FROM bank WHERE NOT coalesce({DELETED}, false)")
def bank_delete(t):
    return slim(ops.bank_delete(b.bank(t), source_like="src1%", topic="t2", difficulty="easy")[0])


@query("bank_delete_count", WITH + f"SELECT count(*) AS deleted FROM bank WHERE {DELETED}")
def bank_delete_count(t):
    return ops.bank_delete(b.bank(t), source_like="src1%", topic="t2", difficulty="easy")[1]


@query("bank_patch", WITH + f"""
SELECT {SLIM.replace('(created_at, options)', '(created_at, options, difficulty, answer)')},
  CASE WHEN quality = 0 THEN 'hard' ELSE difficulty END AS difficulty, CASE WHEN toxic = 1 THEN 'E' ELSE answer END AS answer
FROM bank LEFT JOIN (SELECT doc_id, quality, toxic FROM labels) ON doc_id = id""".replace(
    "SELECT *", "SELECT bank.*"))
def bank_patch(t):
    patches = t.labels.select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, "hard").alias("difficulty"),
        F.when(F.col("toxic") == 1, "E").alias("answer"))
    return slim(ops.bank_patch(b.bank(t), patches))


@query("usage_increment", WITH + """
SELECT id, CAST(times_used + CASE WHEN id IN (SELECT doc_id FROM labels) THEN 1 ELSE 0 END AS INT) AS times_used FROM bank""")
def usage_increment(t):
    picks = t.labels.select(F.col("doc_id").alias("id"))
    return ops.usage_increment(b.bank(t), picks.unionByName(picks)).select("id", "times_used")


@query("canonical_answers", "WITH " + b.EXAMS_SQL + """
SELECT id, CASE WHEN id % 2 = 0 THEN 'B' WHEN list_contains(options, answer) THEN chr(64 + list_position(options, answer)::INT) END AS answer_letter,
  CASE WHEN id % 2 = 0 THEN options[2] ELSE answer END AS answer_text FROM questions""")
def canonical_answers(t):
    """Options and answers as an export keeps them: JSON text, letters next to texts."""
    rows = b.questions(t).select(
        "id", F.to_json("options").alias("options"), F.when(F.col("id") % 2 == 0, "b").otherwise(F.col("answer")).alias("answer"))
    return schemas.canonical_answers(schemas.parse_json_columns(rows)).select("id", "answer_letter", "answer_text")


MATRIX = [
    {"topic": f"t{i}", "topic_label": f"Topic {i}", "easy": 2, "medium": 3, "hard": 40} for i in range(5)
]
OVERLAPPING = [
    {"topic": "t1", "topic_label": "One", "easy": 3, "medium": 2, "hard": 1},
    {"topic": "", "topic_label": "Any", "easy": 4, "medium": 2, "hard": 5},
    {"topic": "t1", "topic_label": "One again", "easy": 2, "medium": 0, "hard": 1},
]
PICKS_SQL = WITH + """
, cells AS (SELECT CAST(row_number() OVER (ORDER BY i, j) AS INT) AS cell, concat('t', i::VARCHAR) AS topic,
    concat('Topic ', i::VARCHAR) AS topic_label, difficulty, CAST(n AS INT) AS requested
  FROM generate_series(0, 4) g(i), (VALUES (1, 'easy', 2), (2, 'medium', 3), (3, 'hard', 40)) v(j, difficulty, n)),
picks AS (SELECT cell, topic, topic_label, difficulty, requested, bank.id, bank.answer, bank.options,
    row_number() OVER (PARTITION BY cell ORDER BY times_used, md5('7' || bank.id), bank.id) AS place
  FROM bank JOIN cells USING (topic, difficulty)
  WHERE subject = 'en' AND question_type = 'mcq' AND answer <> '' QUALIFY place <= requested)
"""


def picks(t):
    return assemble.matrix_pick(b.bank(t), MATRIX, "en", seed=7, oversample=1)


@query("matrix_pick", PICKS_SQL + "SELECT cell, place, id, answer FROM picks")
def matrix_pick(t):
    return picks(t).select("cell", "place", "id", "answer")


def overlapping_sql(seed: str = "7", oversample: int = 3) -> str:
    """One step per cell, each without the rows of the steps before."""
    steps, cell = [], 0
    for row in OVERLAPPING:
        for level in ("easy", "medium", "hard"):
            if row[level] == 0:
                continue
            cell += 1
            topic = f" AND topic = '{row['topic']}'" if row["topic"] else ""
            free = "".join(f" AND id NOT IN (SELECT id FROM c{i})" for i in range(1, cell))
            steps.append(f"""c{cell} AS (SELECT {cell} AS cell, row_number() OVER (ORDER BY md5('{seed}/' || id), id) AS place, * FROM (
  SELECT id, topic, difficulty, times_used FROM bank WHERE subject = 'en' AND question_type = 'mcq' AND answer <> ''
    AND difficulty = '{level}'{topic}{free} ORDER BY times_used, md5('{seed}' || id), id LIMIT {row[level] * oversample}) QUALIFY place <= {row[level]})""")
    union = " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(1, cell + 1))
    return WITH + ", " + ", ".join(steps) + " " + union


@query("matrix_pick_overlapping", overlapping_sql())
def matrix_pick_overlapping(t):
    return assemble.matrix_pick(b.bank(t), OVERLAPPING, "en", seed=7).select(
        "cell", "place", "id", "topic", "difficulty", "times_used")


@query("shuffle_options", WITH + """
, s AS (SELECT id, answer, options, list_transform(list_sort(list_transform(options,
      lambda o, i: {'k': md5('3' || id || '|' || (i - 1)), 'i': i, 'o': o})), lambda x: x.o) AS shuffled FROM bank)
SELECT id, CASE WHEN answer BETWEEN 'A' AND 'D' AND answer <> '' THEN chr(64 + list_position(shuffled, options[ascii(answer) - 64])::INT) ELSE answer END AS answer,
  array_to_string(shuffled, '/') AS options FROM s""")
def shuffle_options(t):
    out = assemble.shuffle_options(b.bank(t), seed=3)
    return out.select("id", "answer", F.array_join("options", "/").alias("options"))


@query("pick_report", PICKS_SQL + """
SELECT cell, topic, topic_label, difficulty, requested, count(id) AS picked,
  CASE WHEN count(id) < requested THEN concat(topic_label, '/', difficulty, ': cần ', requested, ', có ', count(id)) END AS shortfall
FROM cells LEFT JOIN (SELECT cell, id FROM picks) USING (cell) GROUP BY cell, topic, topic_label, difficulty, requested""")
def pick_report(t):
    return assemble.pick_report(assemble.matrix_cells(t.spark, MATRIX), picks(t))


@query("pick_totals", PICKS_SQL + """
, report AS (SELECT cell, requested, count(id) AS picked FROM cells LEFT JOIN (SELECT cell, id FROM picks) USING (cell) GROUP BY ALL)
SELECT sum(requested)::BIGINT AS total_requested, sum(picked)::BIGINT AS total_picked, count(*) FILTER (picked < requested) AS shortfalls FROM report""")
def pick_totals(t):
    return assemble.pick_totals(pick_report(t))


@query("pick_answer_key", PICKS_SQL + """
SELECT q_num::INT AS q_num, cell, id, answer, concat(q_num, '. ', answer) AS line FROM (
  SELECT *, row_number() OVER (ORDER BY cell, place) AS q_num FROM picks)""")
def pick_answer_key(t):
    return assemble.pick_answer_key(picks(t))


EXAMS = "WITH " + b.EXAMS_SQL


@query("exam_variants", EXAMS + """
, rows AS (SELECT exam_id, question_id, "order", code AS variant_code,
    md5('5' || exam_id || '|' || code || '|' || question_id || '|' || "order") AS k FROM exam_questions, (VALUES ('A'), ('B')) v(code)),
placed AS (SELECT *, row_number() OVER (PARTITION BY exam_id, variant_code ORDER BY k, question_id, "order") AS position FROM rows),
s AS (SELECT placed.*, options, answer, list_transform(list_sort(list_transform(options,
      lambda o, i: {'k': md5('5' || variant_code || '|' || question_id || '|' || (i - 1)), 'i': i, 'o': o})), lambda x: x.o) AS shuffled
  FROM placed JOIN questions ON id = question_id)
SELECT exam_id, variant_code, position, question_id,
  CASE WHEN list_contains(options, answer) THEN chr(64 + list_position(options, answer)::INT) END AS original,
  CASE WHEN list_contains(options, answer) THEN chr(64 + list_position(shuffled, answer)::INT) END AS shuffled,
  CASE WHEN list_contains(options, answer) THEN array_to_string(shuffled, '/') END AS shuffled_options FROM s""")
def exam_variants(t):
    out = assemble.exam_variants(b.exam_questions(t), b.questions(t), ["A", "B"], seed=5)
    return out.withColumn("shuffled_options", F.array_join("shuffled_options", "/"))


@query("exam_list", EXAMS + """
SELECT exam_id, subject, title, strftime(created_at, '%Y-%m-%d') AS created_at, count(variant_code) AS variant_count
FROM exams LEFT JOIN variants USING (exam_id) WHERE subject = '2-HIGH' GROUP BY exam_id, subject, title, exams.created_at ORDER BY exams.created_at DESC, exam_id DESC LIMIT 50 OFFSET 10""")
def exam_list(t):
    out = assemble.exam_list(b.exams(t), b.variants(t), subject="2-HIGH", skip=10, limit=50)
    return out.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd"))


@query("exam_expand", EXAMS + """
, made AS (SELECT exam_id, count(*) AS n FROM variants GROUP BY exam_id)
SELECT e.exam_id, title, e.subject, strftime(e.created_at, '%Y-%m-%d') AS created_at, x."order", x.points, question_id,
  content, q.subject AS question_subject, difficulty, answer, coalesce(n, 0) AS variant_count
FROM exam_questions x JOIN exams e USING (exam_id) JOIN questions q ON q.id = question_id LEFT JOIN made USING (exam_id)""")
def exam_expand(t):
    out = assemble.exam_expand(b.exams(t), b.exam_questions(t), b.questions(t).drop("options"), b.variants(t))
    return out.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd"))


@query("exam_append", EXAMS + """
, kept AS (SELECT * FROM exam_questions WHERE question_id NOT IN (SELECT p_partkey FROM part WHERE p_size = 1)),
last AS (SELECT exam_id, max("order") AS last FROM kept GROUP BY exam_id)
SELECT exam_id, question_id, "order", points FROM kept
UNION ALL SELECT o_orderkey, unnest([o_custkey, o_custkey + 1]), CAST(coalesce(last, 0) + unnest([1, 2]) AS INT), 1.0
FROM orders LEFT JOIN last ON exam_id = o_orderkey""")
def exam_append(t):
    additions = t.orders.select(
        F.col("o_orderkey").alias("exam_id"),
        F.array(F.col("o_custkey"), F.col("o_custkey") + 1).alias("question_ids"))
    small = t.part.filter(F.col("p_size") == 1).select(F.col("p_partkey").alias("question_id"))
    removals = b.exam_questions(t).join(small, "question_id", "left_semi")
    return assemble.exam_append(b.exam_questions(t), additions, removals)


@query("exam_totals", EXAMS + "SELECT exam_id, count(*) AS total_questions FROM exam_questions GROUP BY exam_id")
def exam_totals(t):
    return assemble.exam_totals(b.exam_questions(t))


@query("sample_mix", """
WITH a AS (SELECT n_nationkey::BIGINT AS id, n_name AS name, row_number() OVER (ORDER BY md5('9a' || n_nationkey), n_nationkey) AS rn FROM nation),
b AS (SELECT s_suppkey AS id, s_name AS name, row_number() OVER (ORDER BY md5('9b' || s_suppkey), s_suppkey) AS rn FROM supplier),
i AS (SELECT g AS i FROM generate_series(0, 69) s(g)), j AS (SELECT g AS i FROM generate_series(0, 29) s(g))
SELECT CAST(i // (SELECT count(*) FROM a) AS INT) AS copy, id, name FROM i JOIN a ON rn = 1 + i % (SELECT count(*) FROM a)
UNION ALL SELECT CAST(i // (SELECT count(*) FROM b) AS INT), id, name FROM j JOIN b ON rn = 1 + i % (SELECT count(*) FROM b)""")
def sample_mix(t):
    small = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    large = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return assemble.sample_mix(small, large, 100, 0.7, seed=9)


@query("quiz_sample", WITH + "SELECT id, topic FROM bank WHERE topic = 't3' ORDER BY md5('1' || id), id LIMIT 20")
def quiz_sample(t):
    return assemble.quiz_sample(b.bank(t), "t3", 20, seed=1).select("id", "topic")


GRADE = "WITH " + b.RESPONSES_SQL


def graded(t):
    return grading.grade_responses(b.responses(t), b.answer_key(t), grading.templates_df(t.spark))


@query("grade_responses", GRADE + "SELECT * FROM graded")
def grade_responses(t):
    return graded(t)


@query("score_flat", GRADE + "SELECT * FROM flat")
def score_flat(t):
    return grading.score_flat(graded(t), grading.templates_df(t.spark))


@query("score_tiered", GRADE + "SELECT * FROM tiered")
def score_tiered(t):
    return grading.score_tiered(graded(t), grading.templates_df(t.spark))


@query("score_best_of", GRADE + "SELECT * FROM best_of")
def score_best_of(t):
    return grading.score_best_of(graded(t), grading.templates_df(t.spark))


@query("score_summary", GRADE + """
SELECT 'template' AS level, template, count(*) AS sheets, count(*) AS graded, 0::BIGINT AS errors, round_even(avg(score), 2) AS average,
  max(score) AS highest, min(score) AS lowest FROM sheets GROUP BY template
UNION ALL SELECT 'all', NULL, count(*), count(*), 0, round_even(avg(score), 2), max(score), min(score) FROM sheets""")
def score_summary(t):
    return grading.score_summary(grading.score_sheets(graded(t), grading.templates_df(t.spark)))


@query("results_wide", GRADE + """
SELECT 'sheet' AS row_kind, sheet_id, template, score, n_correct, n_wrong, n_blank, """ + ", ".join(
    f"(SELECT student FROM graded g WHERE g.sheet_id = s.sheet_id AND q = {i}) AS \"Q{i}\"" for i in range(1, 51)) + """
FROM sheets s UNION ALL SELECT 'answer_key', NULL, template, NULL, NULL, NULL, NULL, """ + ", ".join(
    f"max(CASE WHEN q = {i} THEN correct END)" for i in range(1, 51)) + " FROM key GROUP BY template")
def results_wide(t):
    rows = graded(t)
    sheets = grading.score_sheets(rows, grading.templates_df(t.spark))
    return grading.results_wide(rows, sheets, b.answer_key(t), 50)


@query("practice_result", GRADE + """
, r AS (SELECT sheet_id AS "user", q, mark, substr('ABCD', CAST(1 + q % 4 AS INT), 1) AS correct FROM responses),
s AS (SELECT "user", count(*) FILTER (mark = correct) AS n_correct, count(*) FILTER (mark <> '' AND mark <> correct) AS n_wrong,
  count(*) FILTER (mark = '') AS n_skipped, count(*) AS n_total FROM r GROUP BY "user")
SELECT *, CAST(floor(n_correct / n_total * 100 + 0.5) AS INT) AS percent, floor(n_correct / n_total * 100 + 0.5) >= 50 AS passed FROM s""")
def practice_result(t):
    rows = b.responses(t).withColumnRenamed("sheet_id", "user")
    key = rows.select("q").distinct().withColumn(
        "correct", F.substring(F.lit("ABCD"), F.col("q") % 4 + 1, F.lit(1)))
    return grading.practice_result(rows, key)


@query("grade_mixed", GRADE + """
, choice AS (SELECT sheet_id, template, q, student, correct, status, 'choice' AS kind FROM graded
  WHERE q <= CASE template WHEN 'IKSC_BENJAMIN' THEN 20 WHEN 'IKLC_PRE_ECOLIER' THEN 15 ELSE 40 END),
fills AS (SELECT user_id AS sheet_id, event_type AS text, row_number() OVER (PARTITION BY user_id ORDER BY event_id, "value", event_type) AS rn FROM events),
texts AS (SELECT k.template, k.q, s.sheet_id, f.text AS student, k.correct,
  CASE WHEN f.text IS NULL THEN 'blank' WHEN upper(f.text) = k.correct THEN 'correct' ELSE 'wrong' END AS status, 'text' AS kind
  FROM (SELECT template, q, CASE q % 2 WHEN 0 THEN 'VIEW' ELSE 'CLICK' END AS correct, row_number() OVER (PARTITION BY template ORDER BY q) AS slot
        FROM key WHERE q > CASE template WHEN 'IKSC_BENJAMIN' THEN 20 WHEN 'IKLC_PRE_ECOLIER' THEN 15 ELSE 40 END) k
  JOIN (SELECT DISTINCT sheet_id, template FROM responses) s USING (template)
  LEFT JOIN fills f ON f.sheet_id = s.sheet_id AND f.rn = k.slot)
SELECT sheet_id, template, q, student, correct, status, kind FROM choice
UNION ALL SELECT sheet_id, template, q, student, correct, status, kind FROM texts""")
def grade_mixed(t):
    rows = b.responses(t)
    spec = grading.templates_df(t.spark).filter(F.col("template").isin(b.USED_TEMPLATES)).select(
        "template", (F.col("questions") - 10).alias("choices"), "questions")
    key = b.answer_key(t).join(spec, "template").select(
        "template", "q",
        F.when(F.col("q") <= F.col("choices"), F.col("correct"))
        .when(F.col("q") % 2 == 0, "View").otherwise("Click").alias("correct"))
    fills = t.events.select(
        F.col("user_id").alias("sheet_id"),
        F.element_at(F.array(*[F.lit(x) for x in b.USED_TEMPLATES]), (F.col("user_id") % 3 + 1).cast("int")).alias("template"),
        F.col("event_id").alias("cy"), F.col("value").alias("cx"), F.col("event_type").alias("text"))
    out = grading.grade_mixed(rows, fills, key, spec, text_slots=10)
    return out.withColumn("correct", F.when(F.col("kind") == "text", F.upper("correct")).otherwise(F.col("correct")))
