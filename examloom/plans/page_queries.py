"""Queries over stored pages and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from examloom.operators import ingest, pages as ops
from examloom.plans import bindings as b
from examloom.plans.registry import query

WITH = "WITH " + b.BANK_SQL
# Documents with a quality label are in the bank already; every document arrives again.
INGEST_SQL = """
WITH batch AS (SELECT doc_id AS seq, trim(text, E' \\n\\t\\r') AS content, lang AS subject, source FROM documents),
known AS (SELECT DISTINCT trim(text, E' \\n\\t\\r') AS content FROM documents JOIN labels USING (doc_id)),
fresh AS (SELECT min(seq) AS seq FROM batch WHERE content <> '' AND content NOT IN (SELECT content FROM known) GROUP BY content)
"""


def ingest_inputs(t):
    batch = t.documents.select(F.col("doc_id").alias("seq"), F.col("text").alias("content"),
                               F.col("lang").alias("subject"), "source")
    bank = t.documents.join(t.labels, "doc_id").select(F.col("text").alias("content"))
    return batch, bank


@query("ingest_dedup", INGEST_SQL + """
SELECT seq, content, subject, source, '' AS grade, '' AS answer, 'medium' AS difficulty, 'essay' AS question_type
FROM batch JOIN fresh USING (seq)""")
def ingest_dedup(t):
    return ingest.ingest_dedup(*ingest_inputs(t), {"question_type": "essay"})[0]


@query("ingest_counts", INGEST_SQL + """
SELECT (SELECT count(*) FROM fresh) AS saved, (SELECT count(*) FROM batch WHERE content <> '') - (SELECT count(*) FROM fresh) AS skipped""")
def ingest_counts(t):
    return ingest.ingest_dedup(*ingest_inputs(t))[1]


HISTORY_SQL = """
WITH history AS (SELECT strftime(min(ts), '%Y-%m-%d %H:00') AS "timestamp", 'view' AS history_type, 0::BIGINT AS n FROM events
  WHERE event_type = 'view' GROUP BY date_trunc('hour', ts)),
rows AS (SELECT strftime(ts, '%Y-%m-%d %H:00') AS "timestamp", arg_min(event_type, event_id) AS history_type,
  arg_min(user_id, event_id) AS n FROM events GROUP BY 1),
all_rows AS (SELECT * FROM history UNION ALL SELECT * FROM rows WHERE "timestamp" NOT IN (SELECT "timestamp" FROM history))
"""


def history(t):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:00").alias("timestamp")
    seen = t.events.filter(F.col("event_type") == "view").groupBy(stamp).agg(
        F.first(F.lit("view")).alias("history_type"), F.first(F.lit(0)).cast("long").alias("n"))
    rows = t.events.select(stamp, F.col("event_type").alias("history_type"), F.col("user_id").alias("n"),
                           F.col("event_id").alias("seq"))
    return ingest.history_append(seen, rows)


@query("history_append", HISTORY_SQL + "SELECT * FROM all_rows")
def history_append(t):
    return history(t)


@query("history_list", HISTORY_SQL + "SELECT * FROM all_rows WHERE history_type = 'view' ORDER BY \"timestamp\" DESC LIMIT 20")
def history_list(t):
    return ingest.history_list(history(t), "view", 20)


@query("history_delete", HISTORY_SQL + "SELECT * FROM all_rows WHERE \"timestamp\" <> '2024-01-03 05:00'")
def history_delete(t):
    return ingest.history_delete(history(t), "2024-01-03 05:00")


@query("subject_by_slug", """
SELECT page_id, CASE WHEN file LIKE '%ref=x%' THEN 'ref' WHEN file LIKE '%#top%' THEN 'top'
  WHEN title LIKE '%tion%' THEN 'title' WHEN url LIKE '%/en/%' THEN 'english' WHEN url LIKE '%/fr/%' THEN 'french' WHEN lower(url) LIKE '%tion%' THEN 'title' ELSE 'general' END AS subject
FROM (SELECT page_id, url, split_part(url, '/', -1) AS file, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages)""")
def subject_by_slug(t):
    rows = t.pages.select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    slugs = {"/en/": "english", "/fr/": "french", "tion": "title", "#top": "top", "ref=x": "ref"}
    return ingest.subject_by_slug(rows, slugs, title="title").select("page_id", "subject")


@query("subject_by_slug_first", """
SELECT page_id, CASE WHEN url LIKE '%/en/%' THEN 'english' WHEN url LIKE '%example%' THEN 'other' ELSE '' END AS subject FROM pages""")
def subject_by_slug_first(t):
    return ingest.subject_by_slug(t.pages, {"/en/": "english", "example": "other"}, mode="first").select("page_id", "subject")


SLUG_TABLE = """
WITH slugs AS (SELECT DISTINCT slug, 's' || length(slug) || left(slug, 2) AS subject FROM (
  SELECT lower(split_part(p_name, ' ', 2)) AS slug FROM part UNION ALL SELECT lower(left(split_part(url, '/', -1), 3)) FROM pages
  UNION ALL SELECT lower(regexp_extract(html, '<title>([^ <]*)', 1)) FROM pages UNION ALL SELECT lower(right(url, 8)) FROM pages WHERE page_id % 2 = 0) WHERE slug <> ''),
p AS (SELECT page_id, lower(url) AS url, lower(split_part(url, '/', -1)) AS file, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages)
"""


def slug_table(t):
    """Slugs of many lengths out of names, addresses and titles."""
    title = F.lower(F.regexp_extract("html", "<title>([^ <]*)", 1))
    found = t.part.select(F.lower(F.split("p_name", " ")[1]).alias("slug")).unionByName(t.pages.select(F.lower(F.substring(F.substring_index("url", "/", -1), 1, 3)).alias("slug")))
    found = found.unionByName(t.pages.select(title.alias("slug"))).unionByName(t.pages.where("page_id % 2 = 0").select(F.lower(F.expr("right(url, 8)")).alias("slug")))
    slugs = found.where("slug <> ''").distinct()
    return slugs.withColumn("subject", F.concat(F.lit("s"), F.length("slug").cast("string"), F.substring("slug", 1, 2)))


@query("subject_by_slug_table", SLUG_TABLE + """
, best AS (SELECT page_id, arg_min(subject, {'place': place, 'n': -length(slug), 'slug': slug}) AS subject FROM (
  SELECT page_id, unnest([file, title, url]) AS text, unnest([0, 1, 2]) AS place FROM p) f JOIN slugs ON contains(text, slug) GROUP BY page_id)
SELECT page_id, coalesce(subject, 'general') AS subject FROM p LEFT JOIN best USING (page_id)""")
def subject_by_slug_table(t):
    """Slugs from a table: a contains join by stretches."""
    rows = t.pages.select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return ingest.subject_by_slug(rows, slug_table(t), title="title").select("page_id", "subject")


@query("subject_by_slug_table_first", SLUG_TABLE + """
, ranked AS (SELECT *, ascii(right(slug, 1)) AS rank FROM slugs),
best AS (SELECT page_id, arg_min(subject, {'rank': rank, 'slug': slug}) AS subject FROM p JOIN ranked ON contains(url || ' ' || title, slug) GROUP BY page_id)
SELECT page_id, coalesce(subject, '') AS subject FROM p LEFT JOIN best USING (page_id)""")
def subject_by_slug_table_first(t):
    rows = t.pages.select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    ranked = slug_table(t).withColumn("rank", F.ascii(F.expr("right(slug, 1)")))
    return ingest.subject_by_slug(rows, ranked, mode="first", title="title").select("page_id", "subject")


@query("route_by_domain", """
SELECT page_id, CASE WHEN host LIKE '%example.com%' THEN 'first' WHEN host LIKE '%example.net%' THEN 'second' ELSE 'generic' END AS route
FROM (SELECT *, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host FROM pages)""")
def route_by_domain(t):
    return ingest.route_by_domain(t.pages, {"example.com": "first", "example.net": "second"}).select("page_id", "route")


@query("grade_from_url", """
SELECT page_id, CASE WHEN n BETWEEN 1 AND 12 THEN n::VARCHAR ELSE '' END AS grade
FROM (SELECT page_id, CASE WHEN length(d) <= 2 THEN CAST(nullif(d, '') AS INT) END AS n FROM (
  SELECT page_id, regexp_extract(url, '/([0-9]+)(?:[?#].*)?$', 1) AS d FROM pages))""")
def grade_from_url(t):
    # The page number takes the place of the grade: .../12 becomes ...-12-
    rows = t.pages.select("page_id", F.regexp_replace("url", r"/([0-9]+)(?:[?#].*)?$", "-$1-x").alias("url"))
    rows = rows.withColumn("url", F.regexp_replace("url", r"-0+([0-9])", "-$1"))
    return ingest.grade_from_url(rows).select("page_id", "grade")


@query("page_links", r"""
SELECT DISTINCT page_id, url, regexp_replace(regexp_replace(regexp_extract(url, '^(https?://[^/?#]*)', 1) || replace(h, '&amp;', '&'), '#.*$', ''), '/+$', '') AS link
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\b[^>]*?href="([^"]*)"', 1)) AS h FROM pages) WHERE h LIKE '/%'""")
def page_links(t):
    return ops.page_links(t.pages)


@query("html_questions", r"""
WITH cut AS (SELECT page_id, url, regexp_replace(html, '(?is)<(script|style|nav|header|footer|aside)\b[^>]*>.*?</(script|style|nav|header|footer|aside)>', '', 'g') AS html FROM pages),
box AS (SELECT page_id, url, regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article>', 1) AS box FROM cut),
p AS (SELECT *, regexp_extract_all(box, '(?is)<p(?:\s[^>]*)?>(.*?)(?:</p>|$)', 1) AS ps FROM box),
stem AS (SELECT page_id, url, list_filter(list_transform(ps, lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(x, '(?is)<p[\s>].*$', ''), '(?s)<[^>]*>', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: true)[1] AS content FROM p)
SELECT page_id, url, content FROM stem WHERE length(content) >= 10""")
def html_questions(t):
    return ops.html_questions(t.pages).select("page_id", "url", "content")


def site_page(t, *parts):
    """One page per part; parts are column names or '=literals'."""
    pieces = [F.lit(p[1:]) if p.startswith("=") else F.col(p).cast("string") for p in parts]
    return t.spread("part").select(F.col("p_partkey").alias("page_id"), F.lit("https://site/list").alias("url"), F.concat(*pieces).alias("html"))


def listed_questions(rows):
    return rows.select("page_id", "pos", "content", F.array_join("options", "/").alias("options"), "answer", "question_type", "image_url")


@query("html_questions_boxes", """
SELECT p_partkey AS page_id, 0 AS pos, 'Which brand in the hình vẽ is ' || p_name || '?' AS content, p_brand || '/' || p_type AS options, 'B' AS answer, 'mcq' AS question_type,
  'https://site/pics/' || p_size || '.png' AS image_url FROM part
UNION ALL SELECT p_partkey, 1, 'Write about ' || p_name, '', '', 'essay', NULL FROM part""")
def html_questions_boxes(t):
    """Options and answer in containers of their own; a list before them must lose."""
    return listed_questions(ops.html_questions(site_page(
        t, '=<section class="question-item"><p class="question-content">Câu 1: Which brand in the hình vẽ is ', "p_name",
        '=?</p><ol><li>not an option</li></ol><img src="/pics/', "p_size", '=.png"><ul class="answer-list"><li>A. ', "p_brand", "=</li><li>B. ", "p_type",
        '=</li></ul><div class="answer">Đáp án: B</div></section><section class="question-item"><p class="question-content">Câu 2: Write about ', "p_name",
        "=</p></section>"), "vietjack"))


@query("html_questions_nested", """
SELECT p_partkey AS page_id, 'vietjack' AS layout, 0 AS pos, 'Which brand in the hình vẽ is ' || p_name || '?' AS content, p_brand || ' note/note/' || p_type AS options, 'B' AS answer,
  'mcq' AS question_type, 'https://site/pics/' || p_size || '.png' AS image_url FROM part
UNION ALL SELECT p_partkey, 'hoc247', 0, 'Where is ' || p_name || ' kept & sold?', p_type || '/' || p_brand, 'A', 'mcq', NULL FROM part
UNION ALL SELECT p_partkey, 'loigiaihay', 0, 'Find the ' || p_name, p_size || '/' || p_size || '5', 'C', 'mcq', NULL FROM part
UNION ALL SELECT p_partkey, 'generic', 0, 'How many ' || p_name || ' are there?', p_size || '/' || p_brand, '', 'mcq', NULL FROM part
UNION ALL SELECT p_partkey, 'generic', 1, 'How many ' || p_name || ' are there?', '', '', 'essay', NULL FROM part""")
def html_questions_nested(t):
    """Elements of one name inside each other, lists in lists, containers in containers, for every layout."""
    made = {
        "vietjack": [
            '=<div class="wrap"><div class="box-question"><div class="question-content"><div>Câu 1: Which brand in the hình vẽ is <div>', "p_name",
            '=?</div></div></div><!-- </div> --><div class="answer-list"><div><ul><li>A. ', "p_brand", "=<ul><li>note</ul></li><li>B. ", "p_type",
            '=</li></ul></div></div><img alt="a>b" src="/pics/', "p_size", '=.png"><div class="correct-answer"><div>Đáp án</div><div>: b</div></div></div></div>'],
        "hoc247": [
            '=<div class="content-question"><div><div class="question-text"><div>Câu 2. Where is ', "p_name", "=</div> kept &amp; sold?</div><div><ol><li>A. ", "p_type",
            "=</li><li>B. ", "p_brand", "=</li></ol></div></div><div><div>Answer: a</div></div></div>"],
        "loigiaihay": [
            '=<div class="box-content big"><div><p> </p><p>Bài 3. Find the ', "p_name", "=</p></div><div><p>A. ", "p_size", "= B. ", "p_size", "=5</p></div><div><div><b>C</b></div></div></div>"],
        "generic": [
            '=<header><header><div class="question"><p>Not a question of this page</p></div></header><p>more of it</p></header><main><div class="my-question"><div class="a-question"><p>How many ',
            "p_name", "= are there?</p></div><div><ul><li>A. ", "p_size", "=</li><li>", "p_brand", "=</li></ul></div></div></main>"],
    }
    rows = [ops.html_questions(site_page(t, *parts), layout).withColumn("layout", F.lit(layout)) for layout, parts in made.items()]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    return every.select("page_id", "layout", "pos", "content", F.array_join("options", "/").alias("options"), "answer", "question_type", "image_url")


@query("html_questions_quiz", """
SELECT p_partkey AS page_id, 0 AS pos, 'Which brand is ' || p_name || '?' AS content, p_brand || '/' || p_type || '/none' AS options, chr(65 + (p_size % 3)::INT) AS answer,
  'mcq' AS question_type, NULL::VARCHAR AS image_url FROM part
UNION ALL SELECT p_partkey, 1, 'Tam giác number ' || p_size, p_size || '/7', '', 'mcq', 'https://cdn/' || p_partkey || '.png' FROM part""")
def html_questions_quiz(t):
    """Items of a quiz with their answers in the script; an item with one option goes."""
    item = '=<li class="wpProQuiz_listItem"><div class="wpProQuiz_question_text"><p>'
    option = '=<li class="wpProQuiz_questionListItem" data-pos="0"><label><input type="radio"> '
    marks = [F.when(F.col("p_size") % 3 == k, "1").otherwise("0").alias(f"m{k}") for k in range(3)]
    t = _with_columns(t, marks)
    return listed_questions(ops.quiz_list_questions(site_page(
        t, "=<ol>", item, "=Câu 1: Which brand is ", "p_name", '=?</p></div><ul class="wpProQuiz_questionList" data-question_id="11">', option, "p_brand",
        "=</label></li>", option, "p_type", "=</label></li>", option, "=none</label></li></ul></li>", item, "=Tam giác number ", "p_size",
        '=<img src="//cdn/', "p_partkey", '=.png"></p></div><ul data-question_id="12">', option, "p_size", "=</label></li>", option, "=7</label></li></ul></li>",
        item, "=Only one option here", "=</p></div><ul>", option, '=x</label></li></ul></li></ol><script>wpProQuizInitList.push({id: 1, json: {"11":{"correct":[',
        "m0", "=,", "m1", "=,", "m2", '=]},"12":{"correct":[0,0]}} });</script>'), least_options=2))


class _with_columns:
    """The part table with further columns."""

    def __init__(self, t, columns):
        self.spread = lambda name: t.spread(name).select("*", *columns)


@query("html_questions_header_list", """
SELECT p_partkey AS page_id, 0 AS pos, 'Which brand is ' || p_name || '?' AS content, p_brand || '/' || p_type AS options, '' AS answer, 'mcq' AS question_type, NULL::VARCHAR AS image_url FROM part
UNION ALL SELECT p_partkey, 1, 'Read the đồ thị of ' || p_name, p_size || '/9/x', '', 'mcq', 'https://site/g/' || p_partkey || '.png' FROM part""")
def html_questions_header_list(t):
    """Headings before lists of labelled spans; a plain heading between them must lose."""
    label = '=<li><span class="cautl">A.</span><span>'
    return listed_questions(ops.header_list_questions(site_page(
        t, '=<h3 class="b-title"><a href="#"><p>Câu 1: Which brand is ', "p_name", '=?</p></a></h3><h3>advert</h3><ul class="dstl">', label, "p_brand", "=</span></li>", label, "p_type",
        '=</span></li><li>no label</li></ul><h3 class="b-title">câu 2. Read the đồ thị of ', "p_name", '=<img src="/g/', "p_partkey", '=.png"></h3><ul class="list dstl">', label, "p_size",
        "=</span></li>", label, "=9</span></li>", label, '=x</span></li></ul><h3 class="b-title">Three: lonely</h3><ul class="dstl">', label, "=y</span></li></ul>")))


def exam_page(t):
    """Parts written as a page of numbered questions."""
    return t.spread("part").select(
        F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://site/de-"), "p_partkey").alias("url"),
        F.concat(
            F.lit("Bài tập\nCâu 1: Which brand makes the "), "p_name", F.lit("?\nA. "), "p_brand", F.lit("\nB. "), "p_type",
            F.lit("\nC. none of them\nLời giải: see page 3\nCÂU 2. How large is part number "), "p_partkey",
            F.lit(" in the list A. "), "p_size", F.lit("0 B. about 75 C. unknown D. less\nCâu 3: short\nA. 1\nB. 2\n"),
        ).alias("text"))


@query("cau_segments", """
SELECT p_partkey AS page_id, 1 AS number, 'Which brand makes the ' || p_name || '?' AS content, p_brand || '/' || p_type || '/none of them' AS options FROM part
UNION ALL SELECT p_partkey, 2, 'How large is part number ' || p_partkey || ' in the list', p_size || '0/about 75/unknown/less' FROM part""")
def cau_segments(t):
    return ops.cau_segments(exam_page(t)).select("page_id", "number", "content", F.array_join("options", "/").alias("options"))


@query("cau_segments_inline", """
SELECT p_partkey AS page_id, 1 AS number, 'Which brand makes the ' || p_name || '?' AS content,
  p_brand || '/' || p_type || '/none' AS options, chr(65 + (p_size % 4)::INT) AS answer FROM part""")
def cau_segments_inline(t):
    rows = t.spread("part").select(
        F.col("p_partkey").alias("page_id"),
        F.concat(F.lit("Câu 1: Which brand makes the "), "p_name", F.lit("? A. "), "p_brand", F.lit(" B. "), "p_type",
                 F.lit(" C. none Đáp án: "), F.char((F.col("p_size") % 4 + 97).cast("int"))).alias("text"))
    return ops.cau_segments(rows, "inline").select(
        "page_id", "number", "content", F.array_join("options", "/").alias("options"), "answer")


@query("cau_segments_page", """
SELECT p_partkey AS page_id, 1 AS number, 'Which brand makes the ' || p_name || ' & more?' AS content, p_brand || '/' || p_type || '/none of them' AS options FROM part
UNION ALL SELECT p_partkey, 2, 'How large is part number ' || p_partkey, p_size || '0/about 75' FROM part""")
def cau_segments_page(t):
    """Segments of a stored page: texts between its tags, at any depth, without scripts."""
    rows = site_page(
        t, "=<body><script>var t = 'Câu 9: no';</script><div><div><b>Câu 1:</b> Which brand makes the ", "p_name", "= &amp; more?<div><div>A. ", "p_brand", "=</div><div>B. ", "p_type",
        "=</div></div><p>C. none of them</p></div><div>Lời giải: see page 3</div></div><div>Câu 2. How large is part number ", "p_partkey", "=<p>A. ", "p_size",
        "=0</p><p>B. about 75</p></div></body>")
    return ops.cau_segments(rows, html="html").select("page_id", "number", "content", F.array_join("options", "/").alias("options"))


@query("passage_nested", """
SELECT p_partkey AS page_id, '[Reading Passage]' || chr(10) || 'Read the passage about ' || p_name || repeat(' and the people who make it', 4) || ' at ' || p_type || chr(10) || chr(10) || '[Question]' || chr(10) || p_brand AS content FROM part""")
def passage_nested(t):
    """A passage whose parts stand around further elements of its own name."""
    rows = site_page(
        t, '=<div class="page"><div>Read the passage below</div><div>Read the passage about ', "p_name", "=<div>an advert <div>inside</div></div>" + " and the people who make it" * 4,
        "=<br> at ", "p_type", "=<span>not this</span></div></div>")
    return ops.passage_attach(rows, t.spread("part").select(F.col("p_partkey").alias("page_id"), F.col("p_brand").alias("content")))


@query("passage_attach", """
SELECT doc_id AS page_id, CASE WHEN length(t) > 88 THEN '[Reading Passage]' || chr(10) || t || chr(10) || chr(10) || '[Question]' || chr(10) || source ELSE source END AS content
FROM (SELECT doc_id, source, 'Read the passage ' || trim(regexp_replace(regexp_replace(text, '[<>&]', ' ', 'g'), '[\\s\\x{85}\\x{A0}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{3000}]+', ' ', 'g')) || ' end' AS t FROM documents)""")
def passage_attach(t):
    pages = t.documents.select(
        F.col("doc_id").alias("page_id"),
        F.concat(F.lit("<h1>T</h1><div class='x'>Read the passage "), F.regexp_replace("text", "[<>&]", " "),
                 F.lit(" end<br>Câu 1: gone</div>")).alias("html"))
    questions = t.documents.select(F.col("doc_id").alias("page_id"), F.col("source").alias("content"))
    return ops.passage_attach(pages, questions)


@query("embedded_answers", """
SELECT p_partkey AS page_id, p_partkey::VARCHAR AS question_id, chr(65 + (p_size % 4)::INT) AS answer FROM part WHERE p_size % 5 < 4
UNION ALL SELECT p_partkey, '9' || p_partkey, 'B' FROM part""")
def embedded_answers(t):
    ones = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(
        (F.col("p_size") % 4 == i) & (F.col("p_size") % 5 < 4), "1").otherwise("0")), ",")
    html = F.concat(
        F.lit('<script>wpProQuizInitList.push({ quiz: "#1", json: {"'), "p_partkey",
        F.lit('": {"type": "single", "correct": ['), ones, F.lit(']}, "9'), "p_partkey",
        F.lit('": {"correct": [0,1,0,0]}}, more: 1 });</script>'))
    return ops.embedded_answers(t.spread("part").select(F.col("p_partkey").alias("page_id"), html.alias("html")))


@query("document_links", """
SELECT p_partkey AS page_id, 'https://site/list' AS url, 'https://site/files/' || p_partkey || '.docx' AS link FROM part
UNION ALL SELECT p_partkey, 'https://site/list', 'https://cdn/' || p_partkey || '.docx' FROM part""")
def document_links(t):
    html = F.concat(
        F.lit('<a href="/files/'), "p_partkey", F.lit('.docx">file</a> <a href="/files/'), "p_partkey",
        F.lit('.docx">again</a><a href="x.pdf">no</a><iframe src="https://view.officeapps.live.com/op/view.aspx?src=https%3A%2F%2Fcdn%2F'),
        "p_partkey", F.lit('.docx&wd=1"></iframe>'))
    return ops.document_links(t.spread("part").select(F.col("p_partkey").alias("page_id"), F.lit("https://site/list").alias("url"), html.alias("html")))


@query("link_frontier", """
WITH RECURSIVE p AS (SELECT regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS url, page_id FROM pages),
down AS (SELECT a.url AS url, c.url AS link FROM p c JOIN p a ON CASE WHEN c.page_id <= 24 THEN c.page_id - 1 ELSE (c.page_id - 1) // 3 END = a.page_id AND c.page_id > 0),
edges AS (SELECT url, link FROM down UNION SELECT link, url FROM down),
walk AS (SELECT url, 0 AS depth FROM p WHERE page_id = 0
  UNION SELECT e.link, depth + 1 FROM walk JOIN edges e ON e.url = walk.url WHERE depth < 60)
SELECT url, min(depth)::INT AS depth FROM walk GROUP BY url""")
def link_frontier(t):
    # A chain of 25 pages, and below it a tree: page i links to pages 3i+1, 3i+2 and 3i+3, and back to its parent.
    parent = F.when(F.col("page_id") <= 24, F.col("page_id") - 1).otherwise(((F.col("page_id") - 1) / 3).cast("long"))
    child = t.pages.select(parent.alias("parent"), F.col("url").alias("link"), "page_id")
    child = child.filter(F.col("page_id") > 0).drop("page_id")
    down = t.pages.join(child, F.col("page_id") == F.col("parent")).select("url", "link")
    links = down.unionByName(down.select(F.col("link").alias("url"), F.col("url").alias("link")))
    seeds = t.pages.filter(F.col("page_id") == 0)
    return ops.link_frontier(t.pages, links, seeds)


@query("image_flags", """
SELECT p_partkey AS page_id, p_size > 25 AS needs_image, 4::INT AS n_images, 1::INT AS n_skip, 1::INT AS n_formula,
  CASE WHEN p_size * 4 < 100 THEN 1 ELSE 0 END::INT AS n_small, CASE WHEN p_size * 4 < 100 THEN 1 ELSE 2 END::INT AS n_meaningful,
  CASE WHEN p_size > 25 THEN 'https://cdn/' || p_partkey || '.png' END AS image_url FROM part""")
def image_flags(t):
    html = F.concat(
        F.lit('<img src="/img/icon.png"><img src="https://latex.codecogs.com/gif.latex?x"><img src="//cdn/'), "p_partkey",
        F.lit('.png" width="'), (F.col("p_size") * 4).cast("string"), F.lit('" height="60px"><img alt="plain" src="pic/'), "p_partkey", F.lit('.jpg">'))
    rows = t.spread("part").select(
        F.col("p_partkey").alias("page_id"), F.lit("https://site/x/list").alias("url"), html.alias("html"),
        F.when(F.col("p_size") > 25, "Xem HÌNH VẼ").otherwise("no picture").alias("question"))
    return ops.image_flags(rows)


@query("facet_examples", WITH + """
, r AS (SELECT p_partkey AS request_id, CASE p_partkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END AS subject,
  CASE WHEN p_size % 3 > 0 THEN 't' || (p_size % 5) END AS topic, CASE WHEN p_size % 2 = 0 THEN 'hard' END AS difficulty, 'mcq' AS question_type FROM part),
d AS (SELECT DISTINCT subject, topic, difficulty, question_type FROM r),
top AS (SELECT d.*, bank.id, content || chr(10) || 'A) a' || bank.id || chr(10) || 'B) b' || bank.id || chr(10) || 'C) c' || bank.id || chr(10) || 'D) d' || bank.id AS example,
  row_number() OVER (PARTITION BY d.subject, d.topic, d.difficulty ORDER BY created_at DESC, bank.id DESC) AS place
  FROM d JOIN bank ON bank.subject = d.subject AND bank.question_type = d.question_type AND (d.topic IS NULL OR d.topic = bank.topic)
    AND (d.difficulty IS NULL OR d.difficulty = bank.difficulty) QUALIFY place <= 3)
SELECT request_id, place::INT AS place, id, example FROM r JOIN top ON r.subject = top.subject AND r.topic IS NOT DISTINCT FROM top.topic AND r.difficulty IS NOT DISTINCT FROM top.difficulty""")
def facet_examples(t):
    subject = F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    requests = t.part.select(
        F.col("p_partkey").alias("request_id"), subject.alias("subject"),
        F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("t"), (F.col("p_size") % 5).cast("string"))).alias("topic"),
        F.when(F.col("p_size") % 2 == 0, "hard").alias("difficulty"), F.lit("mcq").alias("question_type"))
    return ingest.facet_examples(requests, b.bank(t), 3)


@query("shape_similar", WITH + """
, pool AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY created_at DESC, id DESC) AS rn FROM bank QUALIFY rn <= 6),
s AS (SELECT conv_id * 1000 + turn AS sample_id, text, CASE role WHEN 'user' THEN 'en' ELSE 'fr' END AS subject FROM conversations),
x AS (SELECT sample_id, id, rn, (CASE WHEN abs(length(content) - length(text)) / greatest(length(text), 1) < 0.5 THEN 2
    WHEN abs(length(content) - length(text)) / greatest(length(text), 1) < 1 THEN 1 ELSE 0 END
  + CASE WHEN regexp_matches(text, '[ABCD][).]') THEN 2 ELSE 0 END)::INT AS score FROM s JOIN pool USING (subject)),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, rn) AS place FROM x)
SELECT sample_id, place::INT AS place, id, score FROM r WHERE place <= 3""")
def shape_similar(t):
    samples = t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("sample_id"), "text",
        F.when(F.col("role") == "user", "en").otherwise("fr").alias("subject"))
    return ingest.shape_similar(samples, b.bank(t), 3).select("sample_id", "place", "id", "score")


@query("variant_leak_check", """
WITH o AS (SELECT DISTINCT source AS batch_id, lower(trim(text, E' \\n\\t\\r')) AS k FROM documents),
i AS (SELECT DISTINCT source AS batch_id, lower(trim(text, E' \\n\\t\\r')) AS k FROM documents JOIN labels USING (doc_id)),
g AS (SELECT o.batch_id, count(*) AS outputs, count(i.k) AS repeated FROM o LEFT JOIN i ON o.batch_id = i.batch_id AND o.k = i.k GROUP BY o.batch_id)
SELECT *, outputs = repeated AS leaked FROM g""")
def variant_leak_check(t):
    rows = t.documents.select(F.col("source").alias("batch_id"), "doc_id", "text")
    return ingest.variant_leak_check(rows, rows.join(t.labels, "doc_id", "left_semi"))
