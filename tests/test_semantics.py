"""Pinned rules on small frames."""

import datetime

from pyspark.sql import functions as F

from examloom.functions.text import answer_letter, answer_text, blocks, fold_accents, name_key, squeeze, strip
from examloom.functions.urls import host, resolve
from examloom.operators import assemble, bank, curation, documents, grading, ingest, pages, sheets


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x"))).first()[0]


def test_text_functions(spark):
    assert one(spark, "Đường ĐẠI số", fold_accents) == "Đuong ĐAI so"
    assert one(spark, "  Đại   Số\n", name_key) == "đai so"
    assert one(spark, "　 a b \x85", strip) == "a b"
    assert one(spark, "a  b\tc \n d", squeeze) == "a b c d"
    assert one(spark, "a\n \n\nb\r\n\r\nc", blocks) == ["a", "b", "c"]


def test_answers_as_letter_or_text(spark):
    df = spark.createDataFrame(
        [("b", ["x", "y"]), ("y", ["x", "y"]), ("AB", ["x", "y"]), (None, ["x"])], "a string, o array<string>"
    )
    got = df.select(answer_letter("a", "o"), answer_text("a", "o")).collect()
    assert [tuple(r) for r in got] == [("B", "y"), ("B", "y"), (None, "AB"), (None, None)]


def test_urls(spark):
    base = "http://a.example.com/x/y.html?q=1#f"
    cases = {
        "/z": "http://a.example.com/z", "z": "http://a.example.com/x/z", "../z/./w": "http://a.example.com/z/w",
        "//b/c": "http://b/c", "?p=2": "http://a.example.com/x/y.html?p=2", "https://q/r": "https://q/r",
    }
    for href, want in cases.items():
        assert one(spark, href, lambda c: resolve(F.lit(base), c)) == want
    assert one(spark, "http://WWW.Site.com/x", host) == "site.com"


def test_search_needle_is_plain(spark):
    df = spark.createDataFrame([(1, "100% sure", datetime.datetime(2024, 1, 1)), (2, "1000 SURE", datetime.datetime(2024, 1, 2))], "id int, content string, created_at timestamp")
    assert [r["id"] for r in bank.bank_filter(df, search="0%").collect()] == [1]
    assert [r["id"] for r in bank.bank_filter(df, search="sure").collect()] == [2, 1]
    assert bank.bank_filter(df, id=2).count() == 1


def test_shuffle_keeps_options_and_answer(spark):
    df = spark.createDataFrame([(i, list("pqrst")[: 2 + i % 4], "AB"[i % 2]) for i in range(40)] + [(99, ["a", "b"], "AB")], "id int, options array<string>, answer string")
    before = {r["id"]: r for r in df.collect()}
    for r in assemble.shuffle_options(df, seed=1).collect():
        old = before[r["id"]]
        assert sorted(r["options"]) == sorted(old["options"])
        if old["answer"] == "AB":
            assert r["answer"] == "AB"
        else:
            assert r["options"][ord(r["answer"]) - 65] == old["options"][ord(old["answer"]) - 65]


def test_best_of_equals_sum_of_best(spark):
    rows = [(s, "IKLC_BENJAMIN", q, st) for s, (c, w) in enumerate([(45, 5), (10, 40), (30, 0), (0, 50)])
            for q, st in enumerate(["correct"] * c + ["wrong"] * w + ["blank"] * (50 - c - w), 1)]
    graded = spark.createDataFrame(rows, "sheet_id int, template string, q int, status string")
    got = {r["sheet_id"]: r["score"] for r in grading.score_best_of(graded, grading.templates_df(spark)).collect()}
    assert got == {0: 50.0, 1: 10 + 10 - 15.0, 2: 40.0, 3: 10 - 20.0}


def test_grading_status(spark):
    templates = spark.createDataFrame([("t", 5)], "template string, questions int")
    key = spark.createDataFrame([("t", 1, "A"), ("t", 2, "b"), ("t", 3, "C"), ("t", 9, "D")], "template string, q int, correct string")
    marks = spark.createDataFrame(
        [("s", "t", 1, "a"), ("s", "t", 2, "MULTI"), ("s", "t", 3, None), ("s", "t", 4, "A"), ("s", "t", 7, "A"), ("late", "t", 8, "A")],
        "sheet_id string, template string, q int, student string")
    got = {(r["sheet_id"], r["q"]): r["status"] for r in grading.grade_responses(marks, key, templates).collect()}
    assert [got["s", q] for q in range(1, 6)] == ["correct", "invalid", "blank", "wrong", "not_found"]
    assert {got["late", q] for q in range(1, 6)} == {"not_found"}


def test_grade_mixed_without_key(spark):
    templates = spark.createDataFrame([("t", 1, 3)], "template string, choices int, questions int")
    key = spark.createDataFrame([("t", 1, "A"), ("t", 2, "cat ")], "template string, q int, correct string")
    marks = spark.createDataFrame([("s", "t", 1, "B")], "sheet_id string, template string, q int, student string")
    fills = spark.createDataFrame([("s", "t", 9, 1, "later"), ("s", "t", 1, 1, " CAT"), ("s", "t", 5, 5, "extra")], "sheet_id string, template string, cx int, cy int, text string")
    got = {r["q"]: (r["student"], r["status"]) for r in grading.grade_mixed(marks, fills, key, templates, text_slots=2).collect()}
    assert got == {1: ("B", "wrong"), 2: (" CAT", "correct"), 3: ("later", "unknown")}


def test_score_summary_without_sheets(spark):
    sheets_df = spark.createDataFrame([("t", None)], "template string, score double")
    got = grading.score_summary(sheets_df).filter("level = 'all'").first()
    assert (got["sheets"], got["graded"], got["errors"], got["average"], got["highest"]) == (1, 0, 1, 0.0, 0.0)


def bubbles(spark, *options):
    rows = [(1, 1, i, float(f), float(m), bool(x)) for i, (f, m, x) in enumerate(options)]
    df = spark.createDataFrame(rows, "sheet_id int, q int, opt int, fill_ratio double, mean_val double, is_filled boolean")
    return sheets.mark_decision(df).first()["student"]


def test_mark_decision(spark):
    assert bubbles(spark, (0.8, 60, True), (0.1, 200, False), (0.1, 200, False)) == "A"
    assert bubbles(spark, (0.1, 200, False), (0.1, 200, False)) is None
    assert bubbles(spark, (0.8, 100, True), (0.75, 90, True), (0.1, 110, False)) == "MULTI"
    assert bubbles(spark, (0.8, 131, True), (0.75, 100, True), (0.1, 120, False)) == "B"
    assert bubbles(spark, (0.26, 150, False), (0.2, 150, False)) is None
    assert bubbles(spark, (0.27, 150, False), (0.2, 150, False)) == "A"
    assert bubbles(spark, (0.3, 40, False), (0.3, 30, False), (0.2, 45, False), (0.2, 120, False)) == "D"


def test_ingest_is_idempotent(spark):
    batch = spark.createDataFrame([(1, " a "), (2, "a"), (3, "b"), (4, " ")], "seq int, content string")
    empty = spark.createDataFrame([], "content string")
    accepted, counts = ingest.ingest_dedup(batch, empty)
    assert sorted((r["seq"], r["content"], r["subject"]) for r in accepted.collect()) == [(1, "a", "general"), (3, "b", "general")]
    assert tuple(counts.first()) == (2, 1)
    assert ingest.ingest_dedup(batch, accepted)[0].count() == 0


def test_bilingual_rules(spark):
    o = [f"o{i}" for i in range(6)]
    rows = [
        (1, 1, "3 - Point Questions", []), (1, 2, "What", o[:3]), (1, 3, "Cái gì", ["đ1", "đ2", "đ3"]),
        (1, 4, "Lonely", o[:4]), (1, 5, "Full", o[:5]), (1, 6, "4 – Point Questions", []), (1, 7, "Đầu tiên", ["x"]),
        (1, 8, "Many", o[:4]), (1, 9, "Ít", ["đ"]), (1, 10, "Few", o[:2]), (1, 11, "Nhiều", ["đ1"]),
    ]
    df = spark.createDataFrame(rows, "doc_id int, pos int, question string, options array<string>")
    got = {r["pos"]: (r["question"], r["options"]) for r in curation.bilingual_merge(df).collect()}
    assert got[2] == ("What\nCái gì", ["o0 / đ1", "o1 / đ2", "o2 / đ3"])
    # An en-dash is no ASCII: the header after an English row passes for its translation.
    assert got[5][0] == "Full\n4 – Point Questions"
    assert got[8] == ("Many\nÍt", o[:4])
    assert got[10] == ("Few\nNhiều", ["đ1"])
    assert sorted(got) == [2, 5, 7, 8, 10]


def test_best_version_rules(spark):
    rows = [(1, 7, 1, "short", ""), (1, 7, 2, "longer text", ""), (1, 7, 3, "x", "A"), (1, 7, 4, "answered too", "B"), (1, 8, 5, "aa", None), (1, 8, 6, "bb", "")]
    df = spark.createDataFrame(rows, "doc_id int, number int, pos int, question string, answer string")
    assert {r["number"]: r["pos"] for r in curation.best_version(df).collect()} == {7: 3, 8: 5}


def test_position_thirds(spark):
    df = spark.createDataFrame([(1, i) for i in range(8)] + [(2, 0), (2, 1)], "doc_id int, pos int")
    got = [(r["doc_id"], r["marks"]) for r in curation.position_marks(df, "science").orderBy("doc_id", "pos").collect()]
    assert got == [(1, m) for m in (3, 3, 4, 4, 5, 5, 5, 5)] + [(2, 3), (2, 3)]
    assert curation.position_marks(df, "english", "cadet").first()["marks"] == 1.25


def test_split_questions_rules(spark):
    text = "1. one\ntwo\n3) three\n\nWhat? Why? end\n\nStem\nA. x\nB) y\n\nWhat?"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = [r["question"] for r in documents.split_questions(df).orderBy("pos").collect()]
    assert got == ["one two", "three", "What?", "Why?", "end", "Stem\nA. x\nB) y"]


def test_numbers_vary_by_fifteen_percent(spark):
    df = spark.createDataFrame([(i, "take 0 of 1 and 100 and 10") for i in range(30)], "id int, text string")
    out = curation.rule_variants(df, 1, paraphrase=False, change_context=False)
    for r in out.collect():
        words = r["text"].split()
        assert words[1] == "0" and words[3] in ("1", "2") and words[5] in ("85", "115") and words[7] in ("8", "12")


def test_html_layouts(spark):
    html = (
        '<div class="question-item"><div class="question-content">Câu 1: What is it?</div><ul><li>A. one</li><li>B. two</li></ul>'
        '<p>Đáp án: b</p></div>'
    )
    df = spark.createDataFrame([(1, "u", html), (2, "u", "<body>Câu 1: How many legs? A. 6 B. 8 Đáp án: B</body>")], "page_id int, url string, html string")
    got = {r["page_id"]: r for r in pages.html_questions(df, "vietjack").collect()}
    assert (got[1]["content"], got[1]["options"], got[1]["answer"], got[1]["question_type"]) == ("What is it?", ["one", "two"], "B", "mcq")
    assert (got[2]["content"], got[2]["answer"]) == ("How many legs?", "B")


def test_elements_of_soup(spark):
    """Unclosed, stray and quoted tags; items and paragraphs end by what follows."""
    from examloom.functions.markup import Markup, with_markup

    html = (
        '</i><div id=1>x<p>one<p>two<div title="a>b">in</div></div><ul><li>A<ul><li>i1<li>i2</ul>tail<li>B</ul>'
        "<!-- <div> --><script>'<div>'</script><span>open<br/><img src=x>")
    rows = with_markup(spark.createDataFrame([(1, html), (2, ""), (3, None), (4, "plain < text")], "page_id int, html string"))
    page = Markup(F.col("_pieces"), F.col("_texts"), F.col("_elements"))
    found = F.transform("_elements", lambda e: F.concat_ws("|", e["name"], page.text(e), page.direct_text(e), e["n"].cast("string")))
    got = {r[0]: r[1] for r in rows.select("page_id", found).collect()}
    assert got[1] == [
        "div|x one two in|x|3", "p|one|one|0", "p|two in|two|1", "div|in|in|0", "ul|A i1 i2 tail B||5", "li|A i1 i2 tail|A tail|3",
        "ul|i1 i2||2", "li|i1|i1|0", "li|i2|i2|0", "li|B|B|0", "span|open|open|0"]
    assert got[2] == [] and got[3] is None and got[4] == []


def test_running_sums_of_any_length(spark):
    import itertools

    from examloom.functions import markup

    sizes = (0, 1, 63, 64, 65, 128, 4096, 4097, 9000)
    df = spark.createDataFrame([([(k * 7) % 5 - 2 for k in range(n)],) for n in sizes], "xs array<bigint>")
    for xs, got in df.select("xs", F.expr(markup.running_sums("xs"))).collect():
        assert got == list(itertools.accumulate(xs))


def test_nested_containers_and_other_stems(spark):
    nested = '<div class="my-question"><div>What is <b>this</b>?</div><div class="q-question"><div>Inner one</div></div></div>'
    df = spark.createDataFrame([(1, "u", nested), (2, "u", '<div id="content">Câu 1: How many legs has it? A. 6 B. 8</div>Câu 2: outside of it'), (3, "u", None)], "page_id int, url string, html string")
    got = [(r["page_id"], r["content"]) for r in pages.html_questions(df, "vietjack").orderBy("page_id", "pos").collect()]
    assert got == [(1, "What is this ?"), (1, "Inner one"), (2, "How many legs has it?")]


def test_passage_before_the_first_heading(spark):
    long = "Some people like to read books in the evening because it is quiet then, others in the morning when it is light"
    html = f'<div><div>Other text</div><div>{long}<div>nested</div></div><h3 class="b-title">Câu 1</h3></div>'
    df = spark.createDataFrame([(1, html), (2, html.replace("b-title", "c"))], "page_id int, html string")
    questions = spark.createDataFrame([(1, "Q"), (2, "Q")], "page_id int, content string")
    got = {r["page_id"]: r["content"] for r in pages.passage_attach(df, questions).collect()}
    assert got == {1: f"[Reading Passage]\n{long}\n\n[Question]\nQ", 2: "Q"}


def test_slug_first_and_longest(spark):
    df = spark.createDataFrame([("http://x/van/tieng-anh-1.html",), ("http://x/van/1.html",), ("http://x/1.html",)], "url string")
    assert [r["subject"] for r in ingest.subject_by_slug(df).collect()] == ["english", "literature", "general"]
    assert [r["subject"] for r in ingest.subject_by_slug(df, mode="first").collect()] == ["literature", "literature", ""]


def test_slugs_from_a_table_equal_the_map(spark):
    rows = [("http://x/van/tieng-anh-1.html", "t"), ("http://x/van/1.html", None), ("http://x/1.html", "Toán hoa-hoc"), (None, "dia"), ("HTTP://X/TOAN", ""), ("http://x/van/1.html", None), ("", None)]
    df = spark.createDataFrame([(*r, "old", 1) for r in rows], "url string, title string, subject string, rank int")
    slugs = [(slug, subject, k) for k, (slug, subject) in enumerate(ingest.SUBJECT_SLUGS.items())]
    table = spark.createDataFrame([*slugs, ("", "none", -1), ("van", "twice", 99), (None, "null", 0)], "slug string, subject string, rank int")
    for mode in ("longest", "first"):
        plain = ingest.subject_by_slug(df, mode=mode, title="title").select("url", "title", "subject").collect()
        joined = ingest.subject_by_slug(df, table, mode=mode, title="title").select("url", "title", "subject").collect()
        assert sorted(map(str, joined)) == sorted(map(str, plain))
    empty = ingest.subject_by_slug(df, table.where("false"), title="title").select("subject").distinct().collect()
    assert [r[0] for r in empty] == ["general"]


def test_many_long_slugs_do_not_crowd_short_stretches(spark, monkeypatch):
    """Who meets grows with what matches: 40,000 slugs of eight characters share few stretches of four."""
    numbers = spark.range(40_000).select(F.format_string("n/%06d", F.col("id") * 23).alias("slug"))
    table = numbers.select("slug", F.concat(F.lit("s"), "slug").alias("subject"), F.lit(0).cast("bigint").alias("rank"))
    texts = spark.range(0, 40_000, 400).select(F.format_string("http://a.example.com/en/%06d?x=1", F.col("id") * 23).alias("text"))
    named = texts.select(F.xxhash64("text").alias("id"), "text")
    assert ingest.slug_candidates(named, table).count() == 100
    got = ingest.slug_matches(texts, table.drop("rank")).collect()
    assert sorted(r["subject"] for r in got) == [f"sn/{n * 23:06d}" for n in range(0, 40_000, 400)]
    monkeypatch.setattr(ingest, "SLUG_STRETCHES", (4,))
    assert ingest.slug_candidates(named, table).count() > 200
    assert sorted(map(tuple, ingest.slug_matches(texts, table.drop("rank")).collect())) == sorted(map(tuple, got))


def test_slugs_of_every_length_equal_a_nested_loop(spark):
    text = "aab-übcdefghijklmnopq/rst"
    cuts = sorted({text[i:i + n] for n in range(1, 21) for i in range(0, len(text) - n + 1, 3)} | {"zzz", "rst/", "übcdefgh!"})
    slugs = [(c, f"s{c}", len(c) * 7 % 5) for c in cuts]
    texts = ["", "a", "ab", "üb", text, text[:9], text[4:17], "x" + text[6:14] + "y", "defg", "zzzz"]
    table = spark.createDataFrame(slugs, "slug string, subject string, rank int")
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for mode, order in (("longest", lambda r: (-len(r[0]), r[0])), ("first", lambda r: (r[2], r[0]))):
        want = {t: min((r for r in slugs if r[0] in t), key=order)[1] for t in texts if any(r[0] in t for r in slugs)}
        assert {r["text"]: r["subject"] for r in ingest.slug_matches(df, table, mode).collect()} == want


def test_overlapping_cells_equal_a_walk_in_turn(spark):
    import hashlib

    matrix = [{"topic": "", "easy": 4, "hard": 1}, {"topic": "a", "easy": 3}, {"topic": "b", "easy": 2}, {"topic": "a", "easy": 2, "hard": 9}]
    rows = [(i, "s", "ab"[i % 2], "easy" if i % 3 else "hard", i % 4 if i % 5 else None, "A", "mcq") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, subject string, topic string, difficulty string, times_used int, answer string, question_type string")
    md5 = lambda seed, i: hashlib.md5(f"{seed}{i}".encode()).hexdigest()
    for oversample in (1, 3):
        taken, want, cell = set(), [], 0
        for row in matrix:
            for difficulty in ("easy", "medium", "hard"):
                n = row.get(difficulty, 0)
                if not n:
                    continue
                cell += 1
                fit = [r for r in rows if r[3] == difficulty and row["topic"] in ("", r[2]) and r[0] not in taken]
                fit.sort(key=lambda r: (r[4] is not None, r[4] or 0, md5("7", r[0]), r[0]))
                fit = fit[: n * oversample]
                if oversample > 1:
                    fit.sort(key=lambda r: (md5("7/", r[0]), r[0]))
                taken.update(r[0] for r in fit[:n])
                want += [(cell, k + 1, r[0]) for k, r in enumerate(fit[:n])]
        got = assemble.matrix_pick(df, matrix, "s", seed="7", oversample=oversample).select("cell", "place", "id").collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert assemble.matrix_pick(df.where("false"), matrix, "s").count() == 0


def test_sizes_in_words(spark):
    from examloom.sources.files import size_text

    df = spark.createDataFrame([(n,) for n in (0, 1023, 1024, 3328, 3430, 1 << 20, 5 << 30)], "n long")
    assert [r[0] for r in df.select(size_text(F.col("n"))).collect()] == ["0 B", "1023 B", "1.0 KB", "3.2 KB", "3.3 KB", "1.0 MB", "5.0 GB"]


def test_grade_styles(spark):
    df = spark.createDataFrame([("a-13-b",), ("a-12-b",), ("lop-7",), ("thpt",)], "url string")
    def grades(style):
        return [r["grade"] for r in ingest.grade_from_url(df, style).collect()]
    assert grades("dashed") == ["", "12", "7", ""]
    assert grades("dashed_any") == ["13", "12", "7", ""]
    assert grades("named") == [None, None, "7", "12"]


def test_explanations_and_sections(spark):
    text = "What?\n\nANSWERS:\n1. a\n2) C\n\nExplanations\nCâu 1: so\nmore\n2. thus"
    row = documents.split_answer_sections(spark.createDataFrame([(1, text)], "id int, text string")).first()
    assert row["questions"] == ["What?"] and row["answers"] == "1. A\n2. C" and row["explanations"] == ["so more", "thus"]


def test_formula_text(spark):
    df = spark.createDataFrame([("$x^2$ and $$\\frac{a}{b}$$ $\\unknown y$",), ("no formula, 5$",)], "t string")
    rows = curation.math_text(df, "t").collect()
    assert rows[0]["plain_text"] == "x² and (a)/(b) y" and rows[1]["has_formula"] is False
