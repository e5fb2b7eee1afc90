"""How the given tables stand in for the tables of a question bank.

Every binding has a Spark form (a function of Tables) and a SQL form for the
twin queries, kept next to each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"

_BANK = """
SELECT doc_id AS id, text AS content, lang AS subject,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE concat('t', CAST(doc_id % 5 AS {str})) END AS topic,
  CASE WHEN doc_id % 13 = 0 THEN '' ELSE CAST(1 + doc_id % 12 AS {str}) END AS grade,
  CASE WHEN doc_id % 4 = 3 THEN 'essay' ELSE 'mcq' END AS question_type,
  CASE WHEN n_chars < 1050 THEN 'easy' WHEN n_chars < 2200 THEN 'medium' ELSE 'hard' END AS difficulty,
  CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 6 = 1 THEN ''
       ELSE substr('ABCD', CAST(1 + doc_id % 4 AS INT), 1) END AS answer,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'because' END AS explanation,
  CASE WHEN doc_id % 9 = 0 THEN concat('images/', CAST(doc_id AS {str}), '/main.png') ELSE NULL END AS image_url,
  source, CAST(doc_id % 7 AS INT) AS times_used, {created} AS created_at,
  {options} AS options
FROM {documents}
"""
_OPTIONS = "concat('a', CAST(doc_id AS {s})), concat('b', CAST(doc_id AS {s})), concat('c', CAST(doc_id AS {s})), concat('d', CAST(doc_id AS {s}))"

BANK_SQL = "bank AS (" + _BANK.format(
    str="VARCHAR", documents="documents",
    created="TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 30 AS INTEGER))",
    options="[" + _OPTIONS.format(s="VARCHAR") + "]",
) + ")"


def bank(t) -> DataFrame:
    text = _BANK.format(
        str="STRING", documents="{documents}",
        created="timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(CAST(doc_id % 30 AS INT))",
        options="array(" + _OPTIONS.format(s="STRING") + ")",
    )
    return t.sql(text, documents=t.documents)


# Responses: what a user clicked, as a mark at the position named in props.
# The earliest mark of a position counts.
RESPONSES_SQL = """
responses AS (
  SELECT sheet_id, template, q, arg_min(mark, (ts, event_id)) AS mark FROM (
    SELECT user_id AS sheet_id, ts, event_id,
      CASE user_id % 3 WHEN 0 THEN 'IKSC_BENJAMIN' WHEN 1 THEN 'IKLC_PRE_ECOLIER' ELSE 'IKLC_BENJAMIN' END AS template,
      1 + CAST(json_extract(props, '$.k') AS INT) AS q,
      CASE WHEN event_id % 50 = 0 THEN 'MULTI' WHEN event_type = 'view' THEN 'A' WHEN event_type = 'click' THEN 'B'
           WHEN event_type = 'purchase' THEN 'C' WHEN event_type = 'signup' THEN 'D' ELSE '' END AS mark
    FROM events)
  GROUP BY sheet_id, template, q),
key AS (
  SELECT template, CAST(q AS INT) AS q, substr('ABCD', CAST(1 + q % 4 AS INT), 1) AS correct
  FROM (VALUES ('IKSC_BENJAMIN', 30), ('IKLC_PRE_ECOLIER', 25), ('IKLC_BENJAMIN', 50)) v(template, n),
       generate_series(1, 50) g(q) WHERE q <= n),
graded AS (
  SELECT s.sheet_id, s.template, k.q, nullif(r.mark, '') AS student, k.correct,
    CASE WHEN r.mark IS NULL THEN 'not_found' WHEN r.mark = '' THEN 'blank' WHEN r.mark = 'MULTI' THEN 'invalid'
         WHEN r.mark = k.correct THEN 'correct' ELSE 'wrong' END AS status
  FROM (SELECT DISTINCT sheet_id, template FROM responses) s JOIN key k USING (template)
  LEFT JOIN responses r ON r.sheet_id = s.sheet_id AND r.q = k.q),
tallies AS (
  SELECT sheet_id, template, count(*) FILTER (status = 'correct') AS n_correct,
    count(*) FILTER (status IN ('wrong', 'invalid')) AS n_wrong,
    count(*) FILTER (status IN ('blank', 'not_found')) AS n_blank, count(*) AS n_total
  FROM graded GROUP BY ALL),
flat AS (SELECT sheet_id, template, 2.0::DOUBLE * n_correct AS score, n_correct, n_wrong, n_blank, n_total
  FROM tallies WHERE template = 'IKLC_PRE_ECOLIER'),
tiered AS (SELECT sheet_id, template, (30 + p)::DOUBLE AS score, n_correct, n_wrong, n_blank, n_total
  FROM tallies JOIN (SELECT sheet_id, sum(CASE WHEN status = 'correct' THEN
      CASE WHEN q <= 10 THEN 3 WHEN q <= 20 THEN 4 ELSE 5 END
      WHEN status IN ('wrong', 'invalid') THEN -1 ELSE 0 END) AS p FROM graded GROUP BY sheet_id) USING (sheet_id)
  WHERE template = 'IKSC_BENJAMIN'),
best_of AS (SELECT sheet_id, template, round_even(10 + p, 2)::DOUBLE AS score, n_correct, n_wrong, n_blank, n_total
  FROM tallies JOIN (SELECT sheet_id, sum(points) AS p FROM (
      SELECT sheet_id, points, row_number() OVER (PARTITION BY sheet_id ORDER BY points DESC) AS rn FROM (
        SELECT sheet_id, CASE WHEN status = 'correct' THEN 1.0 WHEN status IN ('wrong', 'invalid') THEN -0.5 ELSE 0 END AS points
        FROM graded)) WHERE rn <= 40 GROUP BY sheet_id) USING (sheet_id)
  WHERE template = 'IKLC_BENJAMIN'),
sheets AS (SELECT * FROM flat UNION ALL SELECT * FROM tiered UNION ALL SELECT * FROM best_of)
"""
USED_TEMPLATES = ["IKSC_BENJAMIN", "IKLC_PRE_ECOLIER", "IKLC_BENJAMIN"]


def responses(t) -> DataFrame:
    mark = (
        F.when(F.col("event_id") % 50 == 0, "MULTI")
        .when(F.col("event_type") == "view", "A")
        .when(F.col("event_type") == "click", "B")
        .when(F.col("event_type") == "purchase", "C")
        .when(F.col("event_type") == "signup", "D")
        .otherwise("")
    )
    template = F.element_at(
        F.array(*[F.lit(x) for x in USED_TEMPLATES]), (F.col("user_id") % 3 + 1).cast("int")
    )
    marks = t.events.select(
        F.col("user_id").alias("sheet_id"), template.alias("template"),
        (F.get_json_object("props", "$.k").cast("int") + 1).alias("q"),
        mark.alias("mark"), F.struct("ts", "event_id").alias("at"),
    )
    return (
        marks.groupBy("sheet_id", "template", "q")
        .agg(F.min_by("mark", "at").alias("mark"))
        .select("sheet_id", "template", "q", F.when(F.col("mark") != "", F.col("mark")).alias("student"))
    )


def answer_key(t) -> DataFrame:
    from examloom.operators.grading import templates_df

    return (
        templates_df(t.spark)
        .filter(F.col("template").isin(USED_TEMPLATES))
        .select("template", F.explode(F.sequence(F.lit(1), F.col("questions"))).alias("q"))
        .withColumn("correct", F.substring(F.lit("ABCD"), F.col("q") % 4 + 1, F.lit(1)))
    )


# Exams: orders with their lines; questions: parts.
EXAMS_SQL = """
exams AS (SELECT o_orderkey AS exam_id, o_orderpriority AS subject, concat('Exam ', CAST(o_orderkey AS VARCHAR)) AS title,
  o_orderdate AS created_at FROM orders),
exam_questions AS (SELECT l_orderkey AS exam_id, l_partkey AS question_id, CAST(l_linenumber AS INT) AS "order",
  l_quantity AS points FROM lineitem),
questions AS (SELECT p_partkey AS id, p_name AS content, p_type AS subject,
  CASE WHEN p_size <= 16 THEN 'easy' WHEN p_size <= 33 THEN 'medium' ELSE 'hard' END AS difficulty,
  [concat('red ', p_name), concat('blue ', p_name), p_brand, p_type] AS options,
  CASE p_partkey % 5 WHEN 0 THEN p_brand WHEN 1 THEN p_type WHEN 2 THEN concat('red ', p_name)
    WHEN 3 THEN concat('blue ', p_name) ELSE 'other' END AS answer FROM part),
variants AS (SELECT o_orderkey AS exam_id, code AS variant_code FROM orders, (VALUES ('A'), ('B')) v(code)
  WHERE o_orderstatus = 'F')
"""


def exams(t) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("exam_id"), F.col("o_orderpriority").alias("subject"),
        F.concat(F.lit("Exam "), F.col("o_orderkey")).alias("title"),
        F.col("o_orderdate").alias("created_at"),
    )


def exam_questions(t) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("exam_id"), F.col("l_partkey").alias("question_id"),
        F.col("l_linenumber").cast("int").alias("order"), F.col("l_quantity").alias("points"),
    )


def questions(t) -> DataFrame:
    name, key = F.col("p_name"), F.col("p_partkey")
    red, blue = F.concat(F.lit("red "), name), F.concat(F.lit("blue "), name)
    answer = (
        F.when(key % 5 == 0, F.col("p_brand")).when(key % 5 == 1, F.col("p_type"))
        .when(key % 5 == 2, red).when(key % 5 == 3, blue).otherwise("other")
    )
    level = F.when(F.col("p_size") <= 16, "easy").when(F.col("p_size") <= 33, "medium").otherwise("hard")
    return t.part.select(
        key.alias("id"), name.alias("content"), F.col("p_type").alias("subject"), level.alias("difficulty"),
        F.array(red, blue, "p_brand", "p_type").alias("options"), answer.alias("answer"),
    )


def variants(t) -> DataFrame:
    """Finished orders have two variants."""
    return t.orders.filter(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("exam_id"),
        F.explode(F.array(F.lit("A"), F.lit("B"))).alias("variant_code"),
    )


CURRICULUM_SQL = """
curriculum AS (SELECT c_custkey AS id, r_name AS subject, CAST(1 + c_custkey % 12 AS INT) AS grade, n_name AS chapter,
  c_mktsegment AS topic, c_name AS lesson, concat(c_mktsegment, ' of ', n_name) AS knowledge,
  CAST(c_custkey % 9 AS INT) AS periods
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


def curriculum(t) -> DataFrame:
    return (
        t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("id"), F.col("r_name").alias("subject"),
            (F.col("c_custkey") % 12 + 1).cast("int").alias("grade"), F.col("n_name").alias("chapter"),
            F.col("c_mktsegment").alias("topic"), F.col("c_name").alias("lesson"),
            F.concat("c_mktsegment", F.lit(" of "), "n_name").alias("knowledge"),
            (F.col("c_custkey") % 9).cast("int").alias("periods"),
        )
    )
