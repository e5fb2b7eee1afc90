"""Stored web pages to question rows, links and images.

Everything about one page is worked out inside its row, so these jobs are
scans without a shuffle.  Elements end at their own closing tag, however deep
they are nested (``functions/markup.py``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examloom.functions import urls
from examloom.functions.markup import Markup, first_matching, matching, on_markup, page_pieces, page_text, selector, with_markup
from examloom.functions.storage import checkpointed
from examloom.functions.text import contains_any, let, letter_at, squeeze, strip_tags, unescape_html

# Marks of answers and numbering in page texts.
ANSWER_MARK = r"(?iu)(?:Đáp án|Answer|Đ/A)[:\s]*([A-Da-d])"
INLINE_ANSWER_MARK = r"(?iu)(?:Đáp án|Answer)[:\s]*([A-Da-d])"
NUMBER_PREFIX = r"(?iu)^(Câu|Question|Bài)\s*\d+[.:]\s*"
NOISE_TAGS = ["nav", "header", "footer", "aside"]


@dataclass(frozen=True)
class PageLayout:
    """Where a site keeps its questions: selectors of containers in order of choice, of stem, options and answer."""

    containers: tuple[str, ...]
    stems: tuple[str, ...] = ()
    options: tuple[str, ...] = ()
    answers: tuple[str, ...] = ()
    min_length: int = 1
    drop_noise: bool = False
    first_filled: bool = False
    options_after_stem: bool = False


# Layouts by route.
LAYOUTS = {
    "vietjack": PageLayout((".box-question", ".question-item", ".cau-hoi", "div[class*='question']"),
                           (".question-content", ".noi-dung", "p:first-child", "div:first-child"),
                           options=(".answer-list", ".dap-an", "ul"), answers=(".correct-answer", ".dap-an-dung", ".answer")),
    "hoc247": PageLayout((".content-question", ".question-box", ".quiz-item", "div[class*='question']"),
                         (".question-text", "p.question", ".noidung")),
    "loigiaihay": PageLayout((".box-content", ".question-content", ".bai-tap"), first_filled=True, options_after_stem=True),
    "generic": PageLayout(("[class*='question']", "[class*='cau-hoi']", "[class*='bai-tap']", "article", ".content"),
                          min_length=10, drop_noise=True),
}
# Where the text of a page stands if it has no containers.
MAIN_AREAS = ("main", "article", ".content", ".post-content", "#content")


def _of_class(name: str) -> str:
    """An element of any tag that carries the class itself; its content is group 2."""
    return rf"(?is)<([a-z]\w*)\b[^>]*\bclass=[\"'](?:[^\"']*\s)?{name}(?:\s[^\"']*)?[\"'][^>]*>(.*?)</\1>"


def _first_found(choices: list[Column]) -> Column:
    """First non-empty array; later choices are looked at only when needed."""
    if len(choices) == 1:
        return choices[0]
    return let(choices[0], lambda x: F.when(F.size(x) > 0, x).otherwise(_first_found(choices[1:])))


def _labelled_elements(page: Markup, inside) -> Column:
    """Texts of elements that begin with a label A–D, label by label."""
    begins = lambda e, c: F.coalesce(F.get(page.texts, e["at"] + 1), F.lit("")).rlike(rf"^{c}[.):]")
    found = [F.filter(inside, lambda e, c=c: begins(e, c)) for c in "ABCD"]
    texts = F.transform(F.flatten(F.array(*found)), lambda e: F.regexp_replace(page.text(e), r"^[A-Da-d][.):\s]+", ""))
    return F.filter(texts, lambda x: x != "")


def _options(page: Markup, inside, text) -> Column:
    """List items without labels, four at most; else labelled runs of the text; else labelled elements."""
    items = F.filter(F.transform(F.filter(inside, lambda e: e["name"] == "li"), lambda e: page.text(e)), lambda x: x != "")
    listed = F.transform(items, lambda x: F.regexp_replace(x, r"^[A-Da-d][.):\s]+", ""))
    runs = lambda: let(
        labelled_runs(text), lambda x: F.when(F.size(x) > 0, x).otherwise(_labelled_elements(page, inside)))
    return F.slice(let(listed, lambda x: F.when(F.size(x) > 0, x).otherwise(runs())), 1, 4)


def labelled_runs(text, inner: str = r"[^A-Da-d\n]") -> Column:
    """Texts after ``A.``/``B)`` labels up to the next letter of A–D."""
    runs = F.regexp_extract_all(text, F.lit(rf"[A-Da-d][.)]\s*({inner}+?)(?=[A-Da-d][.)]|$)"), F.lit(1))
    return F.slice(F.transform(runs, squeeze), 1, 4)


def _answer(page: Markup, inside, text) -> Column:
    """Letter after an answer mark, else the first letter of A–D that begins a bold element."""
    low = F.lower(text)
    named = low.contains("đáp án") | low.contains("answer") | low.contains("đ/a")
    marked = F.when(named, F.upper(F.regexp_extract(text, ANSWER_MARK, 1))).otherwise("")
    bold = F.transform(F.filter(inside, lambda e: e["name"].isin("b", "strong")), lambda e: F.regexp_extract(page.text(e), r"^([A-D])", 1))
    return let(marked, lambda m: F.when(m != "", m).otherwise(F.coalesce(F.array_min(F.filter(bold, lambda x: x != "")), F.lit(""))))


def _first_image(content, url, *parts) -> Column:
    """Address of the first usable picture of the parts, in order, if the text calls for one."""
    tags = lambda html: F.regexp_extract_all(html, F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))
    return _image_of(content, url, *[tags(p) for p in parts])


def _image_of(content, url, *tags) -> Column:
    """As above, from lists of picture tags."""
    def address(found):
        src = _attribute(F.get(F.filter(found, lambda t: image_kind(t) == "meaningful"), 0), "src")
        return F.when(src.startswith("//"), F.concat(F.lit("https:"), src)).when(src != "", urls.resolve(url, src))

    return F.when(needs_image(content), F.coalesce(*[address(t) for t in tags]))


_QUESTION = "array<struct<content:string,options:array<string>,answer:string,image_url:string>>"


def _question_rows(found: DataFrame) -> DataFrame:
    """One row per question of ``_q``.

    The outer form: with the inner one Spark would test ahead, in a filter below, whether there are questions, and
    so work all of them out twice.
    """
    rows = found.select("page_id", "url", F.posexplode_outer("_q").alias("pos", "q")).where("q is not null")
    return rows.select(
        "page_id", "url", "pos", "q.content", "q.options", "q.answer",
        F.when(F.size("q.options") > 0, "mcq").otherwise("essay").alias("question_type"), "q.image_url",
    )


def quiz_list_questions(pages: DataFrame, least_options: int = 0, most_options: int | None = None) -> DataFrame:
    """Questions of pages that hold a quiz as a list of items.

    An item runs to the next one.  The answers stand in the script that fills the quiz: per question id a list
    with a 1 at the right option.  Items with less than ``least_options`` options go.
    """
    html = F.col("html")
    items = F.filter(
        F.split(html, r"(?is)(?=<li\b[^>]*\bclass=[\"'][^\"']*wpProQuiz_listItem)"),
        lambda x: x.rlike(r"(?is)^<li\b[^>]*\bclass=[\"'][^\"']*wpProQuiz_listItem"))
    block = F.regexp_extract(html, r"(?s)wpProQuizInitList\.push\(\s*\{.*?json\s*:\s*(\{.*?\}\s*\})", 1)
    told = F.from_json(block, "map<string,struct<correct:array<int>>>")

    def question(item):
        stem = F.regexp_extract(item, _of_class("wpProQuiz_question_text"), 2)
        listed = F.regexp_extract_all(
            item, F.lit(r"(?is)<li\b[^>]*\bclass=[\"'][^\"']*wpProQuiz_questionListItem[^>]*>(.*?)(?=</li>|<li\b|</ul>|$)"), F.lit(1))
        options = F.filter(F.transform(listed, strip_tags), lambda x: x != "")
        options = options if most_options is None else F.slice(options, 1, most_options)
        own = F.regexp_extract(item, r"(?is)<ul\b[^>]*\bdata-question_id=[\"']([^\"']*)[\"']", 1)
        right = F.array_position(F.try_element_at(told, own)["correct"], 1)
        content = F.regexp_replace(strip_tags(stem), r"^Câu\s*\d+[.:]\s*", "")
        return let(content, lambda c: F.struct(
            c.alias("content"), options.alias("options"), F.when(right > 0, letter_at(right)).otherwise("").alias("answer"),
            _first_image(c, F.col("url"), stem, item).alias("image_url")))

    found = F.filter(F.transform(items, question), lambda q: (F.length(q["content"]) >= 5) & (F.size(q["options"]) >= least_options))
    return _question_rows(pages.select("page_id", "url", found.cast(_QUESTION).alias("_q")))


def header_list_questions(pages: DataFrame) -> DataFrame:
    """Questions whose heading stands before the list of its options.

    Lists of class ``dstl`` belong to the nearest heading of class ``b-title`` before them, or to the nearest
    heading without one.  An option has a label and the texts beside it; two options at least.
    """
    marks = F.regexp_extract_all(
        "html", F.lit(r"(?is)<(h3)\b[^>]*>.*?</h3>|<ul\b[^>]*\bclass=[\"'](?:[^\"']*\s)?dstl(?:\s[^\"']*)?[\"'][^>]*>.*?</ul>"), F.lit(0))
    titled = r"(?is)^<h3\b[^>]*\bclass=[\"'](?:[^\"']*\s)?b-title(?:\s[^\"']*)?[\"']"

    def question(heading, items):
        link = F.coalesce(F.nullif(F.regexp_extract(heading, r"(?is)<a\b[^>]*>(.*?)</a>", 1), F.lit("")), heading)
        stem = F.coalesce(F.nullif(F.regexp_extract(link, r"(?is)<p\b[^>]*>(.*?)</p>", 1), F.lit("")), link)
        listed = F.filter(
            F.regexp_extract_all(items, F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1)), lambda x: x.rlike(r"(?is)<span\b[^>]*\bcautl\b"))
        spans = lambda x: F.filter(
            F.regexp_extract_all(x, F.lit(r"(?is)<span\b[^>]*>.*?</span>"), F.lit(0)), lambda y: ~y.rlike(r"(?is)^<span\b[^>]*\bcautl\b"))
        options = F.filter(F.transform(listed, lambda x: strip_tags(F.array_join(spans(x), " "))), lambda x: x != "")
        content = F.regexp_replace(strip_tags(stem), r"(?iu)^Câu\s*\d+[.:]\s*", "")
        return let(content, lambda c: F.struct(
            c.alias("content"), F.slice(options, 1, 4).alias("options"), F.lit("").alias("answer"),
            _first_image(c, F.col("url"), heading).alias("image_url")))

    def with_heading(xs):
        # the place of the nearest heading so far, of the class and of any
        at = lambda test: F.transform(xs, lambda x, i: F.when(test(x), i).otherwise(-1))
        any_h, own_h = at(lambda x: x.rlike("(?i)^<h3")), at(lambda x: x.rlike(titled))
        nearest = lambda places, i: F.array_max(F.slice(places, 1, i + 1))
        pairs = F.filter(
            F.transform(xs, lambda x, i: F.struct(
                x.alias("x"), F.when(nearest(own_h, i) >= 0, nearest(own_h, i)).otherwise(nearest(any_h, i)).alias("h"))),
            lambda p: ~p["x"].rlike("(?i)^<h3") & (p["h"] >= 0))
        return F.transform(pairs, lambda p: question(F.get(xs, p["h"]), p["x"]))

    found = F.filter(let(marks, with_heading), lambda q: (F.length(q["content"]) >= 5) & (F.size(q["options"]) >= 2))
    return _question_rows(pages.select("page_id", "url", found.cast(_QUESTION).alias("_q")))


def html_questions(pages: DataFrame, rules: PageLayout | str = "generic") -> DataFrame:
    """Question rows of stored pages: stem, options, answer letter, type, picture.

    The first container selector that takes anything on a page counts; containers may stand in one another.  The
    stem is the element of the first stem selector that takes any, else the first paragraph.  Options and answer
    come from their own elements where the layout names them and the page has them.  A page without a usable
    container falls back to its "Câu n" text.
    """
    layout = LAYOUTS[rules] if isinstance(rules, str) else rules

    def question(page, box, inside):
        paragraphs = F.filter(inside, lambda e: e["name"] == "p")
        texts = lambda: F.filter(F.transform(paragraphs, lambda e: page.text(e)), lambda x: x != "")
        first = F.get(texts(), 0) if layout.first_filled else page.text(F.get(paragraphs, 0))
        stem = first
        if layout.stems:
            named = let(first_matching(inside, layout.stems), lambda e: page.text(e))
            stem = let(named, lambda x: F.when(F.coalesce(x != "", F.lit(False)), x).otherwise(first))
        content = F.regexp_replace(F.coalesce(stem, F.lit("")), NUMBER_PREFIX, "")
        own_text = page.text(box)
        return let(content, lambda c: let(own_text, lambda text: described(page, box, inside, c, text, texts)))

    def described(page, box, inside, content, text, texts):
        def area(choices, found):
            """``found`` on the elements and text of the first element chosen, else on those of the container."""
            whole = found(page, inside, text)
            if not choices:
                return whole
            inner = lambda e: let(page.inside(e), lambda x: let(page.text(e), lambda t: found(page, x, t)))
            return let(first_matching(inside, choices), lambda e: F.when(e.isNull(), whole).otherwise(inner(e)))

        after = lambda: labelled_runs(F.array_join(F.slice(texts(), 2, 1 << 30), " "), r"[^A-Da-d]")
        return F.struct(
            content.alias("content"), (after() if layout.options_after_stem else area(layout.options, _options)).alias("options"),
            area(layout.answers, _answer).alias("answer"), _image_of(content, F.col("url"), page.tags(box, "img")).alias("image_url"))

    def inline(page):
        main = F.get(F.filter(page.elements, lambda e: _any_of(e, MAIN_AREAS)), 0)
        chosen = F.coalesce(main, F.get(F.filter(page.elements, lambda e: e["name"] == "body"), 0))
        text = let(chosen, lambda e: F.when(e.isNull(), squeeze(F.array_join(page.texts, ""))).otherwise(page.text(e)))
        return F.transform(let(text, _inline_questions), lambda q: F.struct(
            q["content"].alias("content"), q["options"].alias("options"), q["answer"].alias("answer"), F.lit(None).cast("string").alias("image_url")))

    def questions(page):
        boxes = _first_found([matching(page.elements, c) for c in layout.containers])
        found = F.transform(boxes, lambda box: F.when(
            F.length(box["name"]) > 0, let(page.inside(box), lambda inside: question(page, box, inside))))
        usable = F.filter(found, lambda q: F.length(q["content"]) >= layout.min_length)
        return let(usable, lambda x: F.when(F.size(x) > 0, x).otherwise(inline(page)))

    rows = with_markup(pages.select("page_id", "url", "html"), drop=NOISE_TAGS if layout.drop_noise else None)
    return _question_rows(rows.select("page_id", "url", on_markup(questions).cast(_QUESTION).alias("_q")))


def _any_of(e, choices: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for css in choices:
        out = out | selector(css)(e)
    return out


def _inline_questions(text) -> Column:
    """Questions written as "Câu n: …" in running text, ten characters at least."""
    segments = F.filter(
        F.transform(
            F.regexp_extract_all(text, F.lit(r"(?isu)Câu\s*\d+[.:]\s*(.+?)(?=Câu\s*\d+[.:]|$)"), F.lit(1)), squeeze
        ),
        lambda s: F.length(s) >= 10,
    )

    def parts(s):
        start = F.regexp_instr(s, F.lit(r"[A-D][.)]\s"))
        stem = F.when(start > 0, squeeze(F.substring(s, F.lit(1), start - 1))).otherwise(s)
        options = F.when(start > 0, labelled_runs(F.substring(s, start, F.length(s)))).otherwise(
            F.array().cast("array<string>")
        )
        answer = F.upper(F.regexp_extract(s, INLINE_ANSWER_MARK, 1))
        cut = F.when(answer != "", squeeze(F.regexp_replace(stem, r"(?isu)(?:Đáp án|Answer)[:\s]*[A-Da-d].*", "")))
        return F.struct(F.coalesce(cut, stem).alias("content"), options.alias("options"), answer.alias("answer"))

    return F.filter(F.transform(segments, parts), lambda q: q["content"] != "")


@dataclass(frozen=True)
class SegmentRule:
    """How one source writes its questions in running text."""

    header: str
    option_marks: tuple[str, ...]
    cut: str
    min_stem: int
    min_options: int = 2
    min_option_length: int = 1
    answer: str | None = None
    separator: str = "\n"


_CUT = r"(?su)\s*(?:Câu\s*\d+|Lời giải).*$"

# Rules by source.
SEGMENT_RULES = {
    "tracnghiem": SegmentRule(
        r"(?iu)Câu\s*(\d+)\s*[:.]\s*", (r"\n\s*[A-D][.)]\s*", r"\s+[A-D][.)]\s+"), _CUT, 20, 2, 2
    ),
    "vietjack_quiz": SegmentRule(r"\n\s*Câu\s*(\d+)[.:]\s*", (r"\n\s*[A-D][.)]\s*",), _CUT, 10),
    "vietjack_exam": SegmentRule(
        r"Câu\s*(\d+)[.:]\s*", (r"\b[A-D][.)]\s*(?=\S)",),
        r"(?su)(?:Câu\s*\d+[.:]|Đáp án|Lời giải|Hướng dẫn).*$", 1, separator="",
    ),
    "inline": SegmentRule(
        r"(?iu)Câu\s*(\d+)[.:]\s*", (r"\b[A-D][.)]\s",), r"(?isu)(?:Đáp án|Answer)[:\s]*[A-Da-d].*$", 10, 0,
        answer=INLINE_ANSWER_MARK,
    ),
}


def cau_segments(
    pages: DataFrame, rules: SegmentRule | str = "tracnghiem", text: str = "text", html: str | None = None
) -> DataFrame:
    """ "Câu n" segments of a text: number, stem, options (four at most), answer letter.

    With ``html`` the text is that of the page: the texts between its tags, without comments and scripts.
    """
    rule = SEGMENT_RULES[rules] if isinstance(rules, str) else rules
    if html is not None:
        pages = pages.withColumn(text, page_text(page_pieces(F.col(html)), rule.separator)).drop(html)
    keep = [c for c in pages.columns if c != text]
    numbers = F.regexp_extract_all(F.col(text), F.lit(rule.header), F.lit(1))
    bodies = F.slice(F.split(F.col(text), rule.header), 2, 1_000_000_000)

    def tidy(x):
        return squeeze(F.regexp_replace(x, rule.cut, ""))

    def pieces(body):
        out = F.split(body, rule.option_marks[-1])
        for mark in reversed(rule.option_marks[:-1]):
            out = F.when(body.rlike(mark), F.split(body, mark)).otherwise(out)
        return out

    def segment(s, i):
        answer = F.upper(F.regexp_extract(s["body"], rule.answer, 1)) if rule.answer else F.lit("")
        return let(pieces(s["body"]), lambda p: F.struct(
            i.alias("pos"), s["n"].try_cast("int").alias("number"), tidy(F.element_at(p, 1)).alias("content"),
            F.filter(F.transform(F.slice(p, 2, 1_000_000_000), tidy), lambda x: x != "").alias("options"),
            answer.alias("answer"),
        ))

    def usable(q):
        return (
            (F.length(q["content"]) >= rule.min_stem)
            & (F.size(q["options"]) >= rule.min_options)
            & F.forall(q["options"], lambda o: F.length(o) >= rule.min_option_length)
        )

    # Filtered before the rows are made: a filter on the rows would work everything out again.
    zipped = F.arrays_zip(numbers.alias("n"), bodies.alias("body"))
    rows = pages.select(*keep, F.explode(F.filter(F.transform(zipped, segment), usable)).alias("_q"))
    return rows.select(
        *keep, "_q.pos", "_q.number", "_q.content", F.slice("_q.options", 1, 4).alias("options"), "_q.answer"
    )


# How reading passages begin.
PASSAGE_STARTS = [
    "Read the passage",
    "Read the following passage",
    "Read the text",
    "Read the following text",
    "Fill in each numbered blank",
    "Fill in the blank",
    "Complete the dialogue",
    "Complete the conversation",
]


def page_passage(page: Markup) -> Column:
    """The reading passage of a page, or empty.

    It is the direct text of the first ``div`` with an instruction within its first 80 characters, longer than 100
    characters, cut before "Câu n:"; what stands in elements of that ``div``, be they ``div`` themselves, is no part
    of it.  Else it is the direct text of the ``div`` just before the first heading of class ``b-title``, if it is
    longer than 100 characters and holds three words in a row or a numbered blank.
    """
    starts = "|".join(PASSAGE_STARTS)
    long = lambda x: F.length(x) > 100

    def cleaned(x):
        return squeeze(F.regexp_replace(x, r"(?su)(?:Câu\s*\d+\s*:|Bắt đầu làm bài).*$", ""))

    def before_heading(page):
        def sibling(h, parent):
            # the last div that ends before the heading, inside the same parent and in no other element of it
            ahead = F.filter(page.elements, lambda e: (e["name"] == "div") & (e["to"] < h["at"]) & (e["at"] > F.coalesce(parent["at"], F.lit(-1))))
            outer = F.filter(ahead, lambda e: ~F.exists(page.elements, lambda o: (
                (o["at"] < e["at"]) & (e["to"] < o["to"]) & (o["at"] > F.coalesce(parent["at"], F.lit(-1))))))
            return let(F.try_element_at(outer, F.lit(-1)), lambda e: page.direct_text(e))

        def text(h):
            around = F.filter(page.elements, lambda e: (e["at"] < h["at"]) & (h["to"] < e["to"]))
            return let(F.try_element_at(around, F.lit(-1)), lambda parent: sibling(h, parent))

        found = let(F.get(matching(page.elements, "h3.b-title"), 0), text)
        return let(found, lambda x: F.when(long(x) & x.rlike(r"[A-Za-z]{3,}\s+[A-Za-z]{3,}\s+[A-Za-z]{3,}|\(\d+\)\s*_+"), x).otherwise(""))

    def passage(page):
        marked = F.filter(page.elements, lambda e: e["name"] == "div")
        texts = F.filter(F.transform(marked, lambda e: page.direct_text(e)), lambda x: long(x) & F.substring(x, 1, 80).rlike(starts))
        good = F.filter(F.transform(texts, cleaned), lambda x: F.length(x) > 80)
        return let(F.get(good, 0), lambda x: F.when(x.isNotNull(), x).otherwise(before_heading(page)))

    return F.coalesce(passage(page), F.lit(""))


def passage_attach(pages: DataFrame, questions: DataFrame) -> DataFrame:
    """Put the reading passage of a page before each of its questions."""
    found = with_markup(pages.select("page_id", "html")).select("page_id", on_markup(page_passage).alias("_passage"))
    joined = questions.join(found.hint("merge"), "page_id", "left")  # texts made from narrow rows look small
    whole = F.concat(
        F.lit("[Reading Passage]\n"), F.col("_passage"), F.lit("\n\n[Question]\n"), F.col("content")
    )
    attached = F.when(F.col("_passage") != "", whole).otherwise(F.col("content"))
    return joined.withColumn("content", attached).drop("_passage")


def embedded_answers(pages: DataFrame) -> DataFrame:
    """Answer letters kept in script data of a page: question id and letter of the 1 in ``correct``."""
    block = F.explode(
        F.regexp_extract_all("html", F.lit(r"(?s)wpProQuizInitList\.push\(\s*\{(.*?)\}\s*\)"), F.lit(1))
    )
    data = F.regexp_extract("_block", r"(?s)json\s*:\s*(\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\})", 1)
    parsed = F.from_json(data, "map<string,struct<correct:array<int>>>")
    rows = pages.select("page_id", block.alias("_block")).select("page_id", F.explode(parsed).alias("question_id", "_v"))
    place = F.array_position(F.col("_v.correct"), F.lit(1))
    return rows.filter(place > 0).select("page_id", "question_id", F.char(place.cast("int") + 64).alias("answer"))


_HREF = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"


def page_links(
    pages: DataFrame, include: str | None = None, exclude: str | None = None, same_site: bool = True
) -> DataFrame:
    """Distinct absolute links of every page, sorted, without fragment and trailing slash.

    ``include`` and ``exclude`` are patterns on the address.  Links of a page
    are told apart inside its row.
    """
    hrefs = F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))
    links = let(
        urls.base_parts(F.col("url")),
        lambda base: F.transform(
            hrefs,
            lambda h: F.regexp_replace(
                urls.without_fragment(urls.resolve_from(base, unescape_html(h))), r"/+$", ""
            ),
        ),
    )
    kept = F.filter(links, lambda x: x.rlike("(?i)^https?://"))
    if same_site:
        on_site = kept
        kept = let(urls.host(F.col("url")), lambda site: F.filter(on_site, lambda x: urls.host(x) == site))
    if include:
        kept = F.filter(kept, lambda x: x.rlike(include))
    if exclude:
        kept = F.filter(kept, lambda x: ~x.rlike(exclude))
    return pages.select("page_id", "url", F.explode(F.array_sort(F.array_distinct(kept))).alias("link"))


def document_links(pages: DataFrame, suffix: str = ".docx") -> DataFrame:
    """Links to documents: direct ones and those shown in an embedded viewer."""
    direct = F.filter(
        F.regexp_extract_all("html", F.lit(_HREF), F.lit(1)), lambda h: F.lower(h).endswith(suffix)
    )
    viewers = F.regexp_extract_all(
        "html", F.lit(r"(?is)<iframe\b[^>]*?\bsrc\s*=\s*[\"'][^\"']*view\.officeapps\.live\.com[^\"']*?src=([^&\"']+)"), F.lit(1)
    )
    shown = F.filter(F.transform(viewers, F.try_url_decode), lambda u: F.lower(u).endswith(suffix))
    resolved = let(urls.base_parts(F.col("url")), lambda base: F.transform(direct, lambda h: urls.resolve_from(base, h)))
    return pages.select(
        "page_id", "url", F.explode(F.array_sort(F.array_distinct(F.concat(resolved, shown)))).alias("link")
    )


def link_frontier(
    pages: DataFrame, links: DataFrame, seeds: DataFrame, max_pages: int | None = None, max_depth: int | None = None
) -> DataFrame:
    """Breadth-first walk over stored pages: each reached address once, with its depth.

    ``links(url, link)``, ``seeds(url)``.  A level is one join of the newest
    addresses with their links, which lie by address from the start; lineage is cut after each level.  The walk
    ends when a level brings nothing new, or at ``max_depth`` if given.  With ``max_pages`` the nearest, and
    then alphabetically first, pages are taken.
    """
    stored = pages.select(_clean_url(F.col("url")).alias("url")).distinct()
    edges = (
        links.select(_clean_url(F.col("url")).alias("url"), _clean_url(F.col("link")).alias("link"))
        .join(stored.withColumnRenamed("url", "link"), "link", "left_semi")
        .distinct()
    )
    edges = checkpointed(edges.repartition("url"))
    frontier = checkpointed(
        seeds.select(_clean_url(F.col("url")).alias("url")).join(stored, "url", "left_semi").distinct()
        .withColumn("depth", F.lit(0))
    )
    reached, taken = frontier, frontier.count()
    depth = 0
    while depth != max_depth and (max_pages is None or taken < max_pages):
        depth += 1
        frontier = checkpointed(
            edges.join(frontier.select("url"), "url")
            .select(F.col("link").alias("url")).distinct()
            .join(reached, "url", "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        new = frontier.count()
        if new == 0:
            break
        taken += new
        reached = reached.unionByName(frontier)  # every level is a stored table
    return reached if max_pages is None else reached.orderBy("depth", "url").limit(max_pages)


def _clean_url(url) -> Column:
    return F.regexp_replace(urls.without_fragment(url), r"/+$", "")


# Words that call for a picture, and marks of pictures to skip.
NEEDS_IMAGE = [
    "hình vẽ", "hình bên", "như hình", "hình sau", "hình dưới", "đồ thị", "biểu đồ",
    "bảng biến thiên", "bảng xét dấu", "sơ đồ", "mặt phẳng", "hệ trục", "trục tọa độ",
    "hình chữ nhật", "hình vuông", "hình tròn", "tam giác", "tứ giác", "hình hộp",
    "hình lăng trụ", "hình chóp", "hình cầu", "hình trụ", "hình nón", "mặt cầu",
    "khối cầu", "khối hộp", "khối chóp", "khối lăng trụ", "phần gạch", "phần tô màu", "vùng gạch",
]
SKIPPED_IMAGES = [
    "icon", "avatar", "logo", "placeholder", "loading", "pixel", "emoji", "button", "banner",
    "ad-", "ads/", "advertisement", "tracking", "analytics",
]
FORMULA_SERVICES = [
    "latex.codecogs.com", "latex2png", "mathjax", "katex", "tex.s2cms", "mimetex", "mathurl",
    "quicklatex", "latex4technics", "sciweavers.org/tex2img", "chart.googleapis.com/chart?cht=tx",
    "i.upmath.me", "render.githubusercontent.com",
]
FORMULA_PATHS = ["/latex/", "/tex/", "/math/", "/formula/", "/equation/"]
FORMULA_CLASSES = ["mathjax", "latex", "katex", "math", "tex", "mjx", "equation"]
FORMULA_WORDS = [
    r"\\frac", r"\\sqrt", r"\\sum", r"\\int", r"\\alpha", r"\\beta", r"\\gamma", r"\\delta", r"\\theta",
    r"\\pi", r"\\infty", r"\\lim", r"\\begin{", r"\\end{", r"\\left", r"\\right", r"\\cdot", r"\\times",
    r"\\div", r"\\pm", r"\\leq", r"\\geq", r"\\neq", r"\\approx", r"\\equiv", r"\$",
]
FORMULA_DELIMITERS = ["$$", "\\(", "\\)", "\\[", "\\]"]


def needs_image(text) -> Column:
    return F.coalesce(text.rlike("(?iu)" + "|".join(NEEDS_IMAGE)), F.lit(False))


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1)


def image_kind(tag) -> Column:
    """skip, formula, small or meaningful for one ``<img>`` tag; none without a source."""
    parts = F.struct(
        F.lower(_attribute(tag, "src")).alias("src"), F.lower(_attribute(tag, "alt")).alias("alt"),
        F.lower(_attribute(tag, "title")).alias("title"),
    )
    return let(parts, lambda p: _kind_of(tag, p))


def _kind_of(tag, p) -> Column:
    src, alt = p["src"], p["alt"]
    formula = (
        contains_any(src, FORMULA_SERVICES + FORMULA_PATHS)
        | contains_any(F.lower(_attribute(tag, "class")), FORMULA_CLASSES)
        | (_attribute(tag, "data-latex") != "")
        | (_attribute(tag, "data-formula") != "")
        | contains_any(F.concat(alt, F.lit(" "), p["title"]), FORMULA_WORDS)
        | contains_any(alt, FORMULA_DELIMITERS)
    )
    width = F.regexp_replace(_attribute(tag, "width"), "px", "").try_cast("int")
    height = F.regexp_replace(_attribute(tag, "height"), "px", "").try_cast("int")
    small = F.coalesce((width < 100) | (height < 50), F.lit(False)) & width.isNotNull() & height.isNotNull()
    return (
        F.when(src == "", "none")
        .when(contains_any(src, SKIPPED_IMAGES), "skip")
        .when(formula, "formula")
        .when(small | F.coalesce(width < 30, F.lit(False)), "small")
        .otherwise("meaningful")
    )


def image_flags(pages: DataFrame, question: str = "question") -> DataFrame:
    """Per row (html with its question): needs a picture, counts of image kinds, first usable address."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))
    kinds = F.transform(tags, lambda t: F.struct(image_kind(t).alias("kind"), _attribute(t, "src").alias("src")))
    rows = pages.withColumn("_images", kinds).withColumn("needs_image", needs_image(F.col(question)))
    wanted = F.filter("_images", lambda i: i["kind"] == "meaningful")
    first = F.try_element_at(wanted, F.lit(1))["src"]
    address = F.when(first.startswith("//"), F.concat(F.lit("https:"), first)).otherwise(
        urls.resolve(F.col("url"), first)
    )

    def count(kind):
        return F.size(F.filter("_images", lambda i: i["kind"] == kind)).alias(f"n_{kind}")

    return rows.select(
        "page_id", "needs_image", F.size("_images").alias("n_images"),
        count("skip"), count("formula"), count("small"), count("meaningful"),
        F.when(F.col("needs_image") | (F.coalesce(F.col(question), F.lit("")) == ""), address).alias("image_url"),
    )
