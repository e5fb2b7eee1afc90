"""Queries over question rows, curricula and answer sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from examloom.functions.small import literal_table
from examloom.functions.storage import scratch_folder
from examloom.operators import curation as ops, curriculum as cur, sheets
from examloom.plans import bindings as b
from examloom.plans.document_queries import joined
from examloom.plans.registry import query

SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def stripped(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACE}+', ''), '{SPACE}+$', '')"


@query("normalize_keys", f"""
SELECT doc_id, lower({stripped(f"regexp_replace(strip_accents(text), '{SPACE}+', ' ', 'g')")}) AS name_key,
  lower({stripped("text")}) AS question_key FROM documents""")
def normalize_keys(t):
    return ops.normalize_keys(t.documents.select("doc_id", "text"), "text").select("doc_id", "name_key", "question_key")


@query("normalize_numbering", """
SELECT p_partkey AS id, p_name AS stripped, lower(p_name) AS question_key FROM part""")
def normalize_numbering(t):
    kind = F.col("p_partkey") % 4
    text = (F.when(kind == 0, F.concat(F.lit("CÂU HỎI 12: 3) "), "p_name")).when(kind == 1, F.concat(F.lit("question 7. "), "p_name"))
            .when(kind == 2, F.concat(F.lit(" 15- "), "p_name")).otherwise(F.concat(F.lit(" "), "p_name", F.lit("\n"))))
    return ops.normalize_keys(t.spread("part").select(F.col("p_partkey").alias("id"), text.alias("x")), "x").select("id", "stripped", "question_key")


@query("language_flags", r"""
WITH x AS (SELECT doc_id, text, regexp_matches(text, '[À-ỹ]') AS v, regexp_matches(text, '[a-zA-Z]{3,}') AS e FROM documents)
SELECT doc_id, v AS has_vietnamese, e AS has_english, (text LIKE '% / %' OR text LIKE '% - %') AND v AND e AS is_bilingual,
  CASE WHEN e AND NOT v THEN text || ' / [Cần dịch sang tiếng Việt]' WHEN v AND NOT e THEN '[Need English translation] / ' || text ELSE text END AS filled_question,
  CASE WHEN doc_id % 2 = 0 THEN 'abc' || doc_id || ' / [Cần dịch]|é1' ELSE '[Translation] / đ ' || doc_id || '|é1' END AS filled_options FROM x""")
def language_flags(t):
    first = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("abc"), "doc_id")).otherwise(F.concat(F.lit("đ "), "doc_id"))
    rows = t.documents.select("doc_id", F.col("text").alias("question"), F.array(first, F.lit("12")).alias("options"))
    out = ops.language_flags(rows)
    shown = F.array_join(F.transform("filled_options", lambda o: F.when(o == "12", "é1").otherwise(o)), "|")
    return out.select("doc_id", "has_vietnamese", "has_english", "is_bilingual", "filled_question", shown.alias("filled_options"))


MERGE_ROWS_SQL = f"""
WITH r AS (SELECT CAST(substr(source, 4) AS BIGINT) AS doc_id, doc_id AS pos, {stripped("text")} AS q,
  list_transform(range(1, 1 + doc_id % 6), lambda i: CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 'đ' ELSE 'o' END || i) AS o FROM documents),
"""


def merge_rows(t):
    """Documents of one source as the ordered rows of a paper."""
    sign = F.when(F.col("text").rlike(r"[^\x00-\x7F]"), "đ").otherwise("o")
    options = F.when(F.col("doc_id") % 6 == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.col("doc_id") % 6).cast("int"))), lambda i: F.concat(sign, i)))
    return t.documents.select(
        F.substring("source", 4, 9).cast("long").alias("doc_id"), F.col("doc_id").alias("pos"),
        F.col("text").alias("question"), options.alias("options"))


@query("bilingual_merge", MERGE_ROWS_SQL + r"""
n AS (SELECT *, regexp_matches(q, '[^\x00-\x7F]') AS f, lead(q) OVER w AS nq, lead(o) OVER w AS no,
  lead(regexp_matches(q, '[^\x00-\x7F]')) OVER w AS nf, lag(regexp_matches(q, '[^\x00-\x7F]')) OVER w AS pf FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
m AS (SELECT *, NOT f AND coalesce(nf, false) AS opener, f AND NOT coalesce(pf, true) AS taken FROM n)
SELECT doc_id, pos, opener AS merged, CASE WHEN opener THEN q || chr(10) || nq ELSE q END AS question,
  array_to_string(CASE WHEN NOT opener THEN o WHEN len(o) >= len(no) AND len(o) >= 3 THEN
    CASE WHEN len(o) = len(no) THEN list_transform(o, lambda x, i: x || ' / ' || no[i]) ELSE o END ELSE no END, '/') AS options
FROM m WHERE opener OR (NOT taken AND (f OR len(o) >= 5))""")
def bilingual_merge(t):
    return joined(ops.bilingual_merge(merge_rows(t)), "options")


@query("bilingual_line_merge", r"""
WITH l AS (SELECT p_partkey AS doc_id, unnest([1, 2, 3, 4]) AS line_no, unnest(['1. What is ' || p_name, 'Cái gì là ' || p_brand, '2. plain', 'no ' || p_size]) AS text FROM part)
SELECT doc_id, line_no::INT AS line_no, CASE WHEN line_no = 1 THEN substr(text, 4) || chr(10) || (SELECT 'Cái gì là ' || p_brand FROM part WHERE p_partkey = doc_id) ELSE text END AS text
FROM l WHERE line_no <> 2""")
def bilingual_line_merge(t):
    lines = F.array(F.concat(F.lit("1. What is "), "p_name"), F.concat(F.lit("Cái gì là "), "p_brand"), F.lit("2. plain"), F.concat(F.lit("no "), "p_size"))
    rows = t.spread("part").select(F.col("p_partkey").alias("doc_id"), F.posexplode(lines).alias("_i", "text"))
    return ops.bilingual_line_merge(rows.select("doc_id", (F.col("_i") + 1).alias("line_no"), "text"))


def copies(t):
    """Documents of the same length as rows of one paper, so that copies are close to each other."""
    return t.documents.select(
        F.col("n_chars").alias("doc_id"), F.col("doc_id").alias("pos"), F.col("text").alias("question"),
        F.array(F.col("source")).alias("options"))


@query("near_dup_merge", r"""
WITH RECURSIVE r AS (SELECT n_chars AS doc_id, doc_id AS pos, """ + stripped("text") + r""" AS q, source,
  row_number() OVER (PARTITION BY n_chars ORDER BY doc_id) AS i FROM documents),
e AS (SELECT a.doc_id, a.i, b.i - a.i AS d FROM (SELECT *, regexp_replace(q, '(?:[A-Z]\d){2,}', '', 'g') AS c FROM r) a
  JOIN (SELECT *, regexp_replace(q, '(?:[A-Z]\d){2,}', '', 'g') AS c FROM r) b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i + 1 AND a.i + 4
  WHERE length(a.c) > 10 AND length(b.c) > 10 AND (contains(b.c, a.c) OR contains(a.c, b.c) OR contains(b.q, a.q) OR contains(a.q, b.q))),
walk AS (SELECT doc_id, 0::BIGINT AS i, []::BIGINT[] AS gone, NULL::BIGINT AS take FROM (SELECT DISTINCT doc_id FROM r)
  UNION ALL SELECT w.doc_id, r.i,
    CASE WHEN list_contains(w.gone, r.i) THEN w.gone ELSE list_concat(w.gone, list_filter([(SELECT min(r.i + e.d) FROM e WHERE e.doc_id = r.doc_id AND e.i = r.i AND NOT list_contains(w.gone, r.i + e.d))], lambda x: x IS NOT NULL)) END,
    CASE WHEN list_contains(w.gone, r.i) THEN NULL ELSE (SELECT min(e.d) FROM e WHERE e.doc_id = r.doc_id AND e.i = r.i AND NOT list_contains(w.gone, r.i + e.d)) END
  FROM walk w JOIN r ON r.doc_id = w.doc_id AND r.i = w.i + 1),
fin AS (SELECT w.doc_id, w.i, w.take, list_contains(g.gone, w.i) AS lost FROM walk w JOIN (SELECT doc_id, max_by(gone, i) AS gone FROM walk GROUP BY doc_id) g USING (doc_id) WHERE w.i > 0)
SELECT r.doc_id, r.pos, fin.take IS NOT NULL AS merged, r.source AS options FROM fin JOIN r USING (doc_id, i) WHERE NOT lost""")
def near_dup_merge(t):
    return joined(ops.near_dup_merge(copies(t)), "options").select("doc_id", "pos", "merged", "options")


@query("best_version", """
SELECT n_chars % 7 AS doc_id, doc_id % 50 AS number, doc_id AS pos, text AS question, CASE WHEN doc_id % 11 = 0 THEN 'A' ELSE '' END AS answer
FROM documents QUALIFY row_number() OVER (PARTITION BY n_chars % 7, doc_id % 50
  ORDER BY CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 1 END, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE -length(text) END, doc_id) = 1""")
def best_version(t):
    rows = t.documents.select(
        (F.col("n_chars") % 7).alias("doc_id"), (F.col("doc_id") % 50).alias("number"), F.col("doc_id").alias("pos"),
        F.col("text").alias("question"), F.when(F.col("doc_id") % 11 == 0, "A").otherwise("").alias("answer"))
    return ops.best_version(rows)


PAPER_SQL = """
WITH r AS (SELECT CAST(p_size AS BIGINT) AS doc_id, p_partkey AS pos, p_name || ' ' || p_brand AS question,
  CASE WHEN p_partkey % 10 < p_size % 4 THEN CAST(p_partkey // 10 % 40 + 1 AS INT) END AS number FROM part)
"""


def paper(t):
    number = F.when(F.col("p_partkey") % 10 < F.col("p_size") % 4, (F.floor(F.col("p_partkey") / 10) % 40 + 1).cast("int"))
    return t.part.select(
        F.col("p_size").cast("long").alias("doc_id"), F.col("p_partkey").alias("pos"),
        F.concat("p_name", F.lit(" "), "p_brand").alias("question"), number.alias("number"))


@query("splice_order", PAPER_SQL + """
, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM r WHERE number IS NULL),
f AS (SELECT doc_id, min(number) AS first FROM r WHERE number IS NOT NULL GROUP BY doc_id),
k AS (SELECT o.doc_id, pos, question, number, CASE WHEN i < first THEN 0 ELSE 2 END AS part, i AS k FROM o LEFT JOIN f USING (doc_id)
  UNION ALL SELECT doc_id, pos, question, number, 1, number FROM r WHERE number IS NOT NULL),
u AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, question ORDER BY part, k, pos) = 1)
SELECT doc_id, pos, number, question, row_number() OVER (PARTITION BY doc_id ORDER BY part, k, pos) AS place FROM u""")
def splice_order(t):
    return ops.splice_order(paper(t))


@query("number_sort", """
WITH r AS (SELECT CAST(p_size AS BIGINT) AS doc_id, p_partkey AS pos, CASE WHEN p_partkey % 10 < p_size % 9 THEN CAST(p_partkey * 7 % 40 AS INT) END AS number FROM part),
s AS (SELECT doc_id, avg(CASE WHEN number IS NULL THEN 0 ELSE 1 END) > 0.5 AS n FROM r GROUP BY doc_id)
SELECT doc_id, pos, number, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN n THEN coalesce(nullif(number, 0), 1000000) ELSE pos END, pos) AS place FROM r JOIN s USING (doc_id)""")
def number_sort(t):
    rows = t.part.select(
        F.col("p_size").cast("long").alias("doc_id"), F.col("p_partkey").alias("pos"),
        F.when(F.col("p_partkey") % 10 < F.col("p_size") % 9, (F.col("p_partkey") * 7 % 40).cast("int")).alias("number"))
    return ops.number_sort(rows)


@query("missing_numbers", """
SELECT p_partkey AS doc_id, 1::BIGINT AS number, 'x/' || p_brand AS options FROM part UNION ALL SELECT p_partkey, 3, 'y/' || p_type FROM part
UNION ALL SELECT p_partkey, 5, NULL FROM part UNION ALL SELECT p_partkey, 9000000000 + p_partkey, NULL FROM part""")
def missing_numbers(t):
    passages = t.spread("part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("a (5) of (1) "), "p_name", F.lit(" (2) and (3) or (1) ("), (F.lit(9000000000) + F.col("p_partkey")).cast("string"), F.lit(")")).alias("text"))
    rows = t.spread("part").select(F.col("p_partkey").alias("doc_id"), F.explode(F.array(
        F.struct(F.lit(9).alias("seq"), F.lit(2).alias("number"), F.array(F.lit("z")).alias("options")),
        F.struct(F.lit(12).alias("seq"), F.lit(None).cast("int").alias("number"), F.array(F.lit("y"), F.col("p_type")).alias("options")),
        F.struct(F.lit(4).alias("seq"), F.lit(None).cast("int").alias("number"), F.array(F.lit("x"), F.col("p_brand")).alias("options")),
    )).alias("o")).select("doc_id", "o.*")
    return joined(ops.missing_numbers(passages, rows), "options")


MARKS_SQL = PAPER_SQL + """
, m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM r),
g AS (SELECT *, CASE WHEN total < 3 THEN total ELSE total // 3 END AS size FROM m),
marked AS (SELECT *, CASE WHEN n <= size THEN 3.0 WHEN n <= 2 * size THEN 4.0 ELSE 5.0 END::DOUBLE AS marks,
  CASE WHEN n <= size THEN 'EASY' WHEN n <= 2 * size THEN 'MEDIUM' ELSE 'HARD' END AS difficulty FROM g)
"""


@query("position_marks", MARKS_SQL + "SELECT doc_id, pos, marks, difficulty FROM marked")
def position_marks(t):
    return ops.position_marks(paper(t), "science").select("doc_id", "pos", "marks", "difficulty")


@query("question_sheet", MARKS_SQL + """
SELECT doc_id, n AS number, CASE WHEN doc_id % 5 = 0 THEN 'SAQ' ELSE 'MSA' END AS question_type, question,
  CASE WHEN doc_id % 5 > 0 THEN 'x' || pos END AS option_1, CASE WHEN doc_id % 5 > 0 THEN 'y' END AS option_2, NULL::VARCHAR AS option_3, NULL::VARCHAR AS option_4,
  NULL::VARCHAR AS option_5, CASE WHEN n % 3 = 0 THEN (1 + n % 5) WHEN pos % 2 = 0 THEN 2 END::INT AS correct_answer, marks AS default_marks, 30 AS time_to_solve,
  difficulty AS difficulty_level, NULL::VARCHAR AS hint, NULL::VARCHAR AS solution FROM marked""")
def question_sheet(t):
    rows = paper(t).drop("number").select(
        "*", F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(
            F.array(F.concat(F.lit("x"), "pos"), F.lit("y"))).alias("options"),
        F.when(F.col("pos") % 2 == 0, " b").otherwise("?").alias("answer"))
    number = F.explode(F.sequence(F.lit(3), F.greatest(F.lit(3), F.col("n")), F.lit(3)))
    key = rows.groupBy("doc_id").agg(F.count("*").cast("int").alias("n")).select("doc_id", number.alias("number"))
    key = key.withColumn("correct", F.col("number") % 5 + 1)
    return ops.question_sheet(rows, key, "science")


@query("section_renumber", """
WITH s AS (SELECT CAST(s_nationkey AS BIGINT) AS exam_id, s_suppkey AS section, s_suppkey % 5 + 2 AS size FROM supplier),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY exam_id ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT exam_id, section, (before + n)::BIGINT AS number, chr(64 + n::INT) AS answer FROM o, generate_series(1, 6) g(n) WHERE n <= size""")
def section_renumber(t):
    sections = t.supplier.select(F.col("s_nationkey").cast("long").alias("exam_id"), F.col("s_suppkey").alias("section"), (F.col("s_suppkey") % 5 + 2).alias("size"))
    answers = sections.select("exam_id", "section", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("number"))
    return ops.section_renumber(sections, answers.withColumn("answer", F.char(F.col("number") + 64)))


BACKFILL_SQL = "WITH " + b.BANK_SQL + """
, resp AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE chr(65 + (doc_id % 4)::INT) END AS letter FROM documents JOIN labels USING (doc_id)),
open AS (SELECT resp.* FROM resp JOIN bank USING (id) WHERE coalesce(answer, '') = '')
"""


def backfill(t):
    letter = F.char((F.col("doc_id") % 4 + 97).cast("int"))
    responses = t.labels.select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 5 == 0, "not sure").otherwise(F.concat(F.lit("It is **"), letter, F.lit("** because D"))).alias("text"))
    return ops.answer_backfill(b.bank(t), responses)


@query("answer_backfill", BACKFILL_SQL + "SELECT id, coalesce(nullif(letter, ''), answer) AS answer FROM bank LEFT JOIN open USING (id)")
def answer_backfill(t):
    return backfill(t)[0].select("id", "answer")


@query("answer_backfill_errors", BACKFILL_SQL + "SELECT id, 'ID ' || id || ': no answer letter in the response' AS error FROM open WHERE letter = ''")
def answer_backfill_errors(t):
    return backfill(t)[1]


@query("answer_prompts", "WITH " + b.BANK_SQL + """
SELECT id, content, 'A. a' || id || chr(10) || 'B. b' || id || chr(10) || 'C. c' || id || chr(10) || 'D. d' || id AS options_text, subject FROM bank WHERE coalesce(answer, '') = ''""")
def answer_prompts(t):
    return ops.answer_prompts(b.bank(t))


@query("rule_variants", """
WITH v AS (SELECT p_partkey AS id, unnest([1, 2]) AS variant, p_name, p_size FROM part),
x AS (SELECT *, md5('4' || id || '|' || variant || '|0')[1] < '8' AS t1, md5('4' || id || '|' || variant || '|3')[1] < '8' AS t2,
  md5('4' || id || '|' || variant || '#0')[1] < '8' AS n1, greatest(1, round_even(p_size * 0.15, 0)::BIGINT) AS d FROM v)
SELECT id, variant::INT AS variant, CASE WHEN t1 THEN 'xác định' ELSE 'tìm' END || ' ' || CASE WHEN t2 THEN 'con số' ELSE 'giá trị' END || ' viên bi của ' || p_name ||
  ' với ' || greatest(1, CASE WHEN n1 THEN p_size - d ELSE p_size + d END) || ' và 0 mẫu?' AS text FROM x""")
def rule_variants(t):
    rows = t.spread("part").select(F.col("p_partkey").alias("id"), F.concat(
        F.lit("Câu 5: tính số quả táo của "), "p_name", F.lit(" với "), "p_size", F.lit(" và 0 ...?")).alias("text"))
    return ops.rule_variants(rows, 2, topic="toan_hoc", keywords=["mẫu"], seed=4)


@query("rule_variants_forced", """
SELECT p_partkey AS id, 1 AS variant, CASE p_partkey % 3 WHEN 0 THEN 'Choose the correct option: ' || p_name WHEN 1 THEN 'Hãy cho biết: ệệệ ' || p_brand
  ELSE 'Pick: ' || p_name || chr(10) || 'A. ' || p_brand || chr(10) || 'B) x' END AS text FROM part""")
def rule_variants_forced(t):
    kind = F.col("p_partkey") % 3
    text = (F.when(kind == 0, F.col("p_name")).when(kind == 1, F.concat(F.lit("ệệệ "), "p_brand"))
            .otherwise(F.concat(F.lit("Pick:"), "p_name", F.lit("\nA. "), "p_brand", F.lit("\nnote\nB) x"))))
    return ops.rule_variants(t.spread("part").select(F.col("p_partkey").alias("id"), text.alias("text")), 1, paraphrase=False, change_numbers=False, change_context=False)


@query("math_text", """
SELECT p_partkey AS id, p_size % 3 > 0 AS has_formula, CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END::INT AS n_formulas,
  CASE p_size % 3 WHEN 0 THEN 'plain ' || p_name WHEN 1 THEN 'Solve x²+(a)/(b) ≤ π for ' || p_name ELSE 'Let y₁₂ and √2n ∈  A of ' || p_name || '.' END AS plain_text FROM part""")
def math_text(t):
    size = F.col("p_size") % 3
    text = (F.when(size == 0, F.concat(F.lit("plain "), "p_name")).when(size == 1, F.concat(F.lit("Solve $x^2+\\frac{a}{b} \\leq \\pi$ for "), "p_name"))
            .otherwise(F.concat(F.lit("Let $y_{12}$ and $$\\sqrt{2n} \\in \\mathbb A$$ of "), "p_name", F.lit("."))))
    return ops.math_text(t.spread("part").select(F.col("p_partkey").alias("id"), text.alias("x")), "x").drop("x")


@query("shape_tags", """
SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'triangle' WHEN 1 THEN 'rectangle' WHEN 2 THEN 'circle' END AS shape,
  CASE p_size % 4 WHEN 0 THEN 'ABC' WHEN 2 THEN 'O' END AS labels,
  CASE p_size % 4 WHEN 0 THEN p_size || '.5/3.0' WHEN 1 THEN p_size || '.0/1.0/2.0/3.0' WHEN 2 THEN p_size || '.0' END AS measurements FROM part""")
def shape_tags(t):
    size = F.col("p_size") % 4
    text = (F.when(size == 0, F.concat(F.lit("Cho TAM GIÁC ABC, cạnh "), "p_size", F.lit(",5 cm và 3m")))
            .when(size == 1, F.concat(F.lit("rectangle of "), "p_size", F.lit(" by 1, 2, 3, 4")))
            .when(size == 2, F.concat(F.lit("tâm O, r = "), "p_size")).otherwise("none 7"))
    return joined(ops.shape_tags(t.spread("part").select(F.col("p_partkey").alias("id"), text.alias("x")), "x").drop("x"), "measurements")


# ----------------------------------------------------------------- curriculum

CUR = "WITH " + b.CURRICULUM_SQL


@query("curriculum_filter", CUR + "SELECT * FROM curriculum WHERE subject = 'ASIA' AND grade = 3 AND chapter ILIKE '%nation_1%' ORDER BY grade, chapter, id LIMIT 15 OFFSET 2")
def curriculum_filter(t):
    return cur.curriculum_filter(b.curriculum(t), "ASIA", 3, "nation_1", skip=2, limit=15)


@query("curriculum_search", CUR + "SELECT * FROM curriculum WHERE grade = 5 AND (topic ILIKE '%build%' OR lesson ILIKE '%build%' OR knowledge ILIKE '%build%')")
def curriculum_search(t):
    return cur.curriculum_search(b.curriculum(t), "build", grade=5)


@query("curriculum_distinct", CUR + "SELECT DISTINCT chapter FROM curriculum WHERE subject = 'EUROPE' AND grade = 7 AND chapter <> ''")
def curriculum_distinct(t):
    return cur.curriculum_distinct(b.curriculum(t), "chapter", "EUROPE", 7)


@query("curriculum_stats", CUR + """
SELECT 'grade' AS level, subject, grade, count(*) AS total FROM curriculum GROUP BY subject, grade
UNION ALL SELECT 'subject', subject, NULL, count(*) FROM curriculum GROUP BY subject""")
def curriculum_stats(t):
    return cur.curriculum_stats(b.curriculum(t))


@query("replace_slice", CUR + """
SELECT * FROM curriculum WHERE subject <> 'AFRICA' UNION ALL
SELECT id, subject, 1::INT, chapter, topic, lesson, knowledge, periods FROM curriculum WHERE subject = 'AFRICA' AND grade = 2""")
def replace_slice(t):
    rows = b.curriculum(t)
    return cur.replace_slice(rows, rows.filter(F.col("grade") == 2).withColumn("grade", F.lit(1)), "AFRICA")


@query("write_slice", CUR + """
SELECT * FROM curriculum WHERE subject <> 'AFRICA' UNION ALL
SELECT id, subject, 1::INT, chapter, topic, lesson, knowledge, periods FROM curriculum WHERE subject = 'AFRICA' AND grade = 2""")
def write_slice(t):
    """A table stored by subject, one subject of it written again."""
    path = scratch_folder(t.spark, "curriculum")
    rows = b.curriculum(t)
    cur.write_slice(rows, path)
    cur.write_slice(rows.filter((F.col("subject") == "AFRICA") & (F.col("grade") == 2)).withColumn("grade", F.lit(1)), path)
    return t.spark.read.parquet(path)


@query("curriculum_flatten", CUR + """
, b AS (SELECT r_name AS subject, CAST(s_suppkey % 4 + 1 AS INT) AS grade, n_name AS chapter, s_name AS lesson
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT subject, grade, chapter, topic, unnest([lesson, lesson || ' bis']) AS lesson, knowledge, NULL::VARCHAR AS skills, CAST(periods // 2 AS INT) AS periods
FROM curriculum WHERE (subject, grade) NOT IN (SELECT subject, grade FROM b)
UNION ALL SELECT subject, grade, chapter, 'T', lesson, 'k', 's', 7 FROM b""")
def curriculum_flatten(t):
    def nested(df, lessons, periods, knowledge, skills, topic):
        topics = F.array(F.struct(topic.alias("topic"), periods.alias("periods"), lessons.alias("lessons")))
        chapters = F.array(F.struct("chapter", knowledge.alias("knowledge"), skills.alias("skills"), topics.alias("topics")))
        return df.select("subject", F.create_map("grade", chapters).alias("grades"))

    a = nested(b.curriculum(t), F.array("lesson", F.concat("lesson", F.lit(" bis"))), F.col("periods"), F.col("knowledge"),
               F.lit(None).cast("string"), F.col("topic"))
    rows = (t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("r_name").alias("subject"), (F.col("s_suppkey") % 4 + 1).cast("int").alias("grade"), F.col("n_name").alias("chapter"), "s_name"))
    later = nested(rows, F.array("s_name"), F.lit(7), F.lit("k"), F.lit("s"), F.lit("T"))
    return cur.curriculum_flatten(a, later)


@query("curriculum_context", CUR + """
, h AS (SELECT * FROM curriculum WHERE subject = 'ASIA' AND grade = 4),
l AS (SELECT *, coalesce(lag(chapter) OVER (ORDER BY chapter, id), '') <> chapter AS new FROM h)
SELECT chapter, id, CASE WHEN new THEN chr(10) || '## ' || chapter || chr(10) ELSE '' END || '- **Chủ đề:** ' || topic || chr(10) ||
  '  - Bài: ' || lesson || chr(10) || '  - Kiến thức: ' || knowledge AS content FROM l""")
def curriculum_context(t):
    return cur.curriculum_context(b.curriculum(t), "ASIA", 4)


# --------------------------------------------------------------------- sheets

@query("mark_decision", """
WITH bub AS (SELECT l_orderkey AS sheet_id, l_linenumber AS q, (l_partkey % 5)::INT AS opt, max(l_discount * 8) AS f, max(l_quantity * 4) AS m, max(l_discount * 8 > 0.4) AS x
  FROM lineitem GROUP BY ALL),
c AS (SELECT sheet_id, q, list(f ORDER BY opt) AS f, list(m ORDER BY opt) AS m, list(x ORDER BY opt) AS x, list(opt ORDER BY opt) AS o FROM bub GROUP BY ALL),
d AS (SELECT *, list_reverse_sort(f) AS s, list_min(m) AS lo, list_max(m) AS hi,
  list_filter(range(1, len(f) + 1), lambda i: x[i] AND f[i] > 0 AND f[i] > coalesce(list_max(f[1:i - 1]), 0)) AS rec, list_filter(range(1, len(f) + 1), lambda i: x[i]) AS fil FROM c),
e AS (SELECT *, list_position(f, s[1]) AS top, coalesce(s[1] > s[2] * 1.3, false) AS clear,
  CASE WHEN len(rec) = 0 AND len(fil) > 0 THEN list_sort(list_transform(fil, lambda i: {'m': m[i], 'i': i}))[1].i WHEN len(fil) = 1 THEN fil[1] ELSE rec[-1] END AS sel FROM d),
g AS (SELECT *, len(list_filter(m, lambda v: v < 50)) >= 3 AS dark, list_filter(range(1, len(f) + 1), lambda i: m[i] > 100 OR f[i] > 0.3) AS val,
  len(list_filter(f, lambda v: v > CASE WHEN s[1] > 0.5 THEN s[1] * 0.6 ELSE 0.35 END)) AS n FROM e),
h AS (SELECT *, CASE WHEN dark THEN CASE WHEN hi - lo > 50 THEN CASE WHEN f[list_position(m, hi)] > 0.1 THEN list_position(m, hi)
      WHEN len(val) > 0 THEN -list_reverse_sort(list_transform(val, lambda i: {'f': f[i], 'i': -i}))[1].i ELSE sel END ELSE sel END
    WHEN n <= 1 THEN CASE WHEN sel IS NULL AND s[1] > 0.25 AND clear THEN top ELSE sel END
    WHEN m[top] = lo OR clear OR (s[1] > 0.5 AND s[2] < 0.4) THEN top WHEN hi - lo > 30 THEN list_position(m, lo) ELSE -1 END AS mark FROM g)
SELECT sheet_id, q, CASE WHEN mark = -1 THEN 'MULTI' ELSE chr((65 + o[mark])::INT) END AS student FROM h""")
def mark_decision(t):
    bubbles = t.lineitem.select(
        F.col("l_orderkey").alias("sheet_id"), F.col("l_linenumber").alias("q"), (F.col("l_partkey") % 5).cast("int").alias("opt"),
        (F.col("l_discount") * 8).alias("fill_ratio"), (F.col("l_quantity") * 4).alias("mean_val"), (F.col("l_discount") * 8 > 0.4).alias("is_filled"))
    return sheets.mark_decision(bubbles).drop("fill_ratios")


@query("row_cluster", """
WITH RECURSIVE r AS (SELECT user_id AS sheet_id, event_id, "value" AS cx, CAST(json_extract(props, '$.k') AS INT) * 4 AS cy FROM events),
a AS (SELECT sheet_id, min(cy) AS y FROM r GROUP BY sheet_id UNION ALL
  SELECT sheet_id, y FROM (SELECT a.sheet_id, (SELECT min(cy) FROM r WHERE r.sheet_id = a.sheet_id AND cy > a.y + 15) AS y FROM a) WHERE y IS NOT NULL)
SELECT sheet_id, event_id, (SELECT count(*) FROM a WHERE a.sheet_id = r.sheet_id AND a.y <= r.cy)::INT AS row_no FROM r""")
def row_cluster(t):
    rects = t.events.select(F.col("user_id").alias("sheet_id"), "event_id", F.col("value").alias("cx"),
                            (F.get_json_object("props", "$.k").cast("int") * 4).alias("cy"))
    return sheets.row_cluster(rects).select("sheet_id", "event_id", "row_no")


@query("gap_group", """
WITH s AS (SELECT c_custkey AS sheet_id, CASE WHEN c_custkey % 2 = 0 THEN 'row' ELSE 'column' END AS template FROM customer)
SELECT sheet_id, template, (2 + row)::INT AS row_no, (row * 4 + grp + 1)::INT AS q, opt::INT AS opt, (10 + grp * 160 + opt * 20)::DOUBLE AS cx
FROM s, generate_series(0, 1) r(row), generate_series(0, 3) g(grp), generate_series(0, 4) o(opt)
UNION ALL SELECT sheet_id, template, 4, 9, opt::INT, (10 + opt * 20)::DOUBLE FROM s, generate_series(0, 4) o(opt)""")
def gap_group(t):
    """Every customer's sheet: a header row, two full rows of four questions, one short row; doubled edges."""
    def cells(row, groups):
        return F.transform(F.sequence(F.lit(0), F.lit(groups * 5 - 1)), lambda i: F.struct(
            F.lit(row).alias("row_no"), (F.floor(i / 5) * 160 + (i % 5) * 20 + 10).cast("double").alias("cx"), F.lit(row * 30).alias("cy")))

    twin = F.array(F.struct(F.lit(2).alias("row_no"), F.lit(14.0).alias("cx"), F.lit(60).alias("cy")))
    rows = t.customer.select(
        F.col("c_custkey").alias("sheet_id"), F.when(F.col("c_custkey") % 2 == 0, "row").otherwise("column").alias("template"),
        F.explode(F.concat(cells(1, 1), cells(2, 4), cells(3, 4), cells(4, 1), twin)).alias("b")).select("sheet_id", "template", "b.*")
    spec = literal_table(t.spark, [("row", 9, 5, 4, "row"), ("column", 30, 5, 4, "column")],
                                   "template string, questions int, options int, questions_per_row int, layout string")
    return sheets.gap_group(rows, spec)


@query("nearest_right_match", """
SELECT c_custkey AS doc_id, (col + 1)::INT AS "column", q::BIGINT AS q, chr((65 + (c_custkey + col + q) % 5)::INT) AS letter
FROM customer, generate_series(0, 5) c(col), generate_series(1, 4) g(q)""")
def nearest_right_match(t):
    """Six columns of four numbers; a stray letter five lower and one 60 to the right must lose."""
    cells = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.array(*[
        F.struct(text.alias("text"), (F.floor(i / 4) * 90 + dx).cast("double").alias("x"), ((i % 4) * 20 + dy).cast("double").alias("y"))
        for text, dx, dy in [
            ((i % 4 + 1).cast("string"), 5, 3), (F.lit("E"), 12, 8),
            (F.concat(F.char((F.lit(65) + (F.col("c_custkey") + F.floor(i / 4) + i % 4 + 1) % 5).cast("int")), F.lit(", X")), 30, 4), (F.lit("A"), 65, 3)]
    ])))
    spans = t.customer.select(F.col("c_custkey").alias("doc_id"), F.posexplode(cells).alias("seq", "s")).select("doc_id", "seq", "s.*")
    return sheets.nearest_right_match(spans)


@query("answer_key_unpivot", """
SELECT p_partkey AS doc_id, q::INT AS q, chr((65 + (p_size + q) % 5)::INT) AS letter FROM part, generate_series(1, 3) g(q)""")
def answer_key_unpivot(t):
    kind = F.col("p_partkey") % 3

    def letter(q):
        return F.char((F.lit(97) + (F.col("p_size") + q) % 5).cast("int"))

    def row(n, *cells):
        return F.struct(F.lit(n).alias("row_no"), F.array(*[F.lit(c) if isinstance(c, str) else c for c in cells]).alias("cells"))

    single = F.array(row(0, "No", "Ecolier", "Pre-Ecolier"), *[row(i, str(i), "E" if i > 1 else "A", letter(i)) for i in (1, 2, 3)], row(4, "x", "A", "B"))
    pairs = F.array(row(0, "Ecolier", "Ecolier", "pre ecolier", "Pre_Ecolier"), *[row(i, str(i), "A", f" {i} ", letter(i)) for i in (1, 2, 3)])
    plain = F.array(row(0, "Câu", "Đáp án"), *[row(i, str(i), letter(i)) for i in (1, 2, 3)], row(4, "9", "F"))
    tables = t.spread("part").select(F.col("p_partkey").alias("doc_id"), F.explode(F.when(kind == 0, single).when(kind == 1, pairs).otherwise(plain)).alias("r"))
    return sheets.answer_key_unpivot(tables.select("doc_id", "r.*"), "Pre-Ecolier")
