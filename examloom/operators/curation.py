"""Cleaning, merging, ordering and varying question rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examloom.functions.ranking import split_row_number, split_running_sum, with_neighbours
from examloom.functions.storage import checkpointed
from examloom.functions.text import (
    NON_ASCII_CHAR,
    VIETNAMESE_CHAR,
    is_blank,
    lines,
    name_key,
    question_key,
    seeded,
    strip,
    strip_numbering,
)
from examloom.operators.bank import bank_patch

ALL = 1_000_000_000


def normalize_keys(df: DataFrame, column: str) -> DataFrame:
    """Accent-free key, text without leading numbering, and comparison key of a column."""
    return df.select(
        "*",
        name_key(F.col(column)).alias("name_key"),
        strip_numbering(F.col(column)).alias("stripped"),
        question_key(F.col(column)).alias("question_key"),
    )


def _viet(x) -> Column:
    return x.rlike(VIETNAMESE_CHAR)


def _eng(x) -> Column:
    return x.rlike("[a-zA-Z]{3,}")


def language_flags(questions: DataFrame, question: str = "question", options: str = "options") -> DataFrame:
    """Languages of a question, and texts with a placeholder for the missing one."""
    q = F.col(question)

    def filled(x, vn, en):
        single = ~x.contains(" / ") | ~(_viet(x) & _eng(x))
        return (
            F.when(single & _eng(x) & ~_viet(x), F.concat(x, F.lit(f" / {vn}")))
            .when(single & _viet(x) & ~_eng(x), F.concat(F.lit(f"{en} / "), x))
            .otherwise(x)
        )

    return questions.select(
        "*",
        _viet(q).alias("has_vietnamese"),
        _eng(q).alias("has_english"),
        ((q.contains(" / ") | q.contains(" - ")) & _viet(q) & _eng(q)).alias("is_bilingual"),
        filled(q, "[Cần dịch sang tiếng Việt]", "[Need English translation]").alias("filled_question"),
        F.transform(options, lambda o: filled(o, "[Cần dịch]", "[Translation]")).alias("filled_options"),
    )


# ------------------------------------------------------------------- merging

# Fixed value: headers between sections.
_SECTION_HEADER = r"(?i)^\d+\s*[–\-]\s*Point\s+Questions?$"


def bilingual_merge(questions: DataFrame) -> DataFrame:
    """Merge an English row with the Vietnamese row right after it.

    ``questions(doc_id, pos, question, options)``.  Section headers go.  The
    English options win when there are three or more and not fewer than the
    Vietnamese; equal counts are joined pairwise.  A lone English row with
    fewer than five options goes.  An English row never follows as the
    Vietnamese one, so pairs cannot overlap and neighbours decide.
    """
    rows = questions.withColumn("question", strip(F.col("question")))

    def foreign(x):
        return x.rlike(NON_ASCII_CHAR)

    def opens(q):
        return ~q.rlike(_SECTION_HEADER) & ~foreign(q)

    near = with_neighbours(
        rows, ["doc_id"], "pos", F.struct(F.col("question").alias("q"), F.col("options").alias("o")),
        F.coalesce(opens(F.col("question")), F.lit(False)),
    )

    q, o, nq, no = F.col("question"), F.col("options"), F.col("_next.q"), F.col("_next.o")
    opener = opens(q) & F.coalesce(foreign(nq), F.lit(False))
    taken = foreign(q) & F.coalesce(F.col("_prev"), F.lit(False))
    paired = F.zip_with(
        o, no, lambda en, vn: F.when(foreign(vn) & ~foreign(en), F.concat(en, F.lit(" / "), vn)).otherwise(en)
    )
    options = (
        F.when((F.size(o) >= F.size(no)) & (F.size(o) >= 3), F.when(F.size(o) == F.size(no), paired).otherwise(o))
        .otherwise(no)
    )
    kept = opener | (~taken & ~q.rlike(_SECTION_HEADER) & (foreign(q) | (F.size(o) >= 5)))
    return near.filter(kept).select(
        "doc_id", "pos",
        F.when(opener, F.concat(q, F.lit("\n"), nq)).otherwise(q).alias("question"),
        F.when(opener, options).otherwise(o).alias("options"),
        opener.alias("merged"),
    )


def bilingual_line_merge(doc_lines: DataFrame) -> DataFrame:
    """Raw lines: a numbered line without Vietnamese letters and the Vietnamese line after it become one."""

    def opens(x):
        return x.rlike(r"^\d+\.\s*") & ~_viet(x)

    text = F.col("text")
    near = with_neighbours(
        doc_lines, ["doc_id"], "line_no", F.struct(text.alias("t")), F.coalesce(opens(text), F.lit(False)))
    opener = opens(text) & F.coalesce(_viet(F.col("_next.t")), F.lit(False))
    taken = _viet(text) & F.coalesce(F.col("_prev"), F.lit(False))
    whole = F.concat(strip(F.regexp_replace(text, r"^\d+\.\s*", "")), F.lit("\n"), F.col("_next.t"))
    return near.filter(~taken).select("doc_id", "line_no", F.when(opener, whole).otherwise(text).alias("text"))


# Fixed value: labels of diagrams in texts.
_LABEL_NOISE = r"(?:[A-Z]\d){2,}"


def near_dup_merge(
    questions: DataFrame, lookahead: int = 4, min_len: int = 10, block_rows: int = 50_000
) -> DataFrame:
    """Merge a row with the first of the next ``lookahead`` rows that holds it or is held by it.

    ``questions(doc_id, pos, question, options)``.  Texts are compared whole
    and without diagram labels, both longer than ``min_len``.  A row takes part
    once, in order.

    Finding candidates is a window over each document.  A document of more than ``block_rows`` rows is cut in blocks
    that share their first rows with the block before, so none needs to fit one task.
    Who merges with whom depends on what earlier rows took, but only on the
    last ``lookahead`` rows: that is a state of ``lookahead`` bits.  For a document longer
    than a block, every block first reports what it makes of each state; the
    reports are chained, and then each block runs once from its true state.
    Only rows with a candidate reach this step.

    Texts travel once to be compared, without their neighbours; who takes whom is told by places, and what
    is wanted of a taken row comes to its taker from there.  Rows at one place of a document go by a hash.
    """
    rows = questions.select(
        "doc_id", "pos", strip(F.col("question")).alias("question"), "options", F.xxhash64("question", "options").alias("_tie"))
    # At most one document for every ``block_rows`` rows.
    long_docs = checkpointed(rows.groupBy("doc_id").count().filter(F.col("count") > block_rows).select(F.col("doc_id").alias("_long")))
    several = not long_docs.isEmpty()
    is_long = F.col("doc_id").eqNullSafe(F.col("_long"))
    short = rows.join(F.broadcast(long_docs), is_long, "left_anti") if several else rows
    along = Window.partitionBy("doc_id").orderBy("pos", "_tie")
    numbered = short.withColumn("_idx", F.row_number().over(along).cast("long") - 1)
    masks = _masks(short.withColumn("_block", F.lit(0).cast("long")), along, lookahead, min_len)
    if several:
        cut = split_row_number(rows.join(F.broadcast(long_docs), is_long, "left_semi"), ["doc_id"], ["pos", "_tie"], "_idx")
        cut = cut.withColumn("_idx", F.col("_idx") - 1)
        numbered = numbered.unionByName(cut)
        own = F.floor(F.col("_idx") / block_rows)
        shared = (F.col("_idx") % block_rows < lookahead) & (own > 0)
        spread = cut.withColumn("_own", own).withColumn(
            "_block", F.explode(F.when(shared, F.array(own, own - 1)).otherwise(F.array(own))))
        inside = Window.partitionBy("doc_id", "_block").orderBy("pos", "_tie")
        found = _masks(spread, inside, lookahead, min_len, "_idx", "_own").filter(F.col("_block") == F.col("_own"))
        masks = masks.unionByName(found.drop("_own"))

    # Rows with a candidate, and the rows they may take.
    # They are few, and three steps read them, so they are stored once.
    linked = checkpointed(masks.filter((F.col("_mask") > 0) & F.col("doc_id").isNotNull()))
    doc_type = questions.schema["doc_id"].dataType.simpleString()
    starts = _start_states(linked, lookahead, doc_type)
    takes = checkpointed(
        linked.join(starts, ["doc_id", "_block"], "left")
        .repartition("doc_id", "_block").sortWithinPartitions("doc_id", "_block", "_idx")
        .mapInPandas(lambda batches: _choose(batches, lookahead), f"doc_id {doc_type}, _idx long, _take int")
    )
    gone = takes.select("doc_id", (F.col("_idx") + F.col("_take")).alias("_idx"), F.col("_idx").alias("_by"))
    given = numbered.join(gone, ["doc_id", "_idx"]).select(
        "doc_id", F.col("_by").alias("_idx"), F.col("question").alias("_other"), F.col("options").alias("_theirs"))
    joined = numbered.join(takes, ["doc_id", "_idx"], "left").join(gone, ["doc_id", "_idx"], "left_anti").join(
        given, ["doc_id", "_idx"], "left")

    text, other = F.col("question"), F.col("_other")
    clean = _without_labels(text)
    noisy, other_noisy = clean != text, _without_labels(other) != other
    best = F.when(noisy & ~other_noisy, other).when(~noisy, text).otherwise(clean)
    more = F.when(F.size("options") >= F.size("_theirs"), F.col("options")).otherwise(F.col("_theirs"))
    hit = F.col("_take").isNotNull()
    return joined.select(
        "doc_id", "pos",
        F.when(hit, best).otherwise(text).alias("question"),
        F.when(hit, more).otherwise(F.col("options")).alias("options"),
        hit.alias("merged"),
    )


def _without_labels(text: Column) -> Column:
    return F.regexp_replace(text, _LABEL_NOISE, "")


def _masks(rows: DataFrame, along, lookahead: int, min_len: int, *kept: str) -> DataFrame:
    """Place, block and candidates of each row: bit d - 1 stands for the row d places further."""
    # Plain columns, put together after the window: a text without labels is sent once.
    marked = rows.withColumn("_clean", F.when(F.col("question").rlike(_LABEL_NOISE), _without_labels(F.col("question"))))
    place = [] if "_idx" in kept else [(F.row_number().over(along).cast("long") - 1).alias("_idx")]
    ahead = [F.lead(c, d).over(along).alias(f"{c}{d}") for d in range(1, lookahead + 1) for c in ("question", "_clean")]
    near = marked.select("doc_id", "_block", *kept, *place, "question", "_clean", *ahead)
    text, clean = F.col("question"), F.coalesce("_clean", "question")
    mask = F.lit(0)
    for d in range(1, lookahead + 1):
        q2, c2 = F.col(f"question{d}"), F.coalesce(f"_clean{d}", f"question{d}")
        same = (F.length(clean) > min_len) & (F.length(c2) > min_len) & (
            c2.contains(clean) | clean.contains(c2) | q2.contains(text) | text.contains(q2)
        )
        mask = mask + F.when(F.coalesce(same, F.lit(False)), 1 << (d - 1)).otherwise(0)
    return near.select("doc_id", "_idx", "_block", *[k for k in kept if k != "_idx"], mask.alias("_mask"))


def _walk(idx, masks, state: int, last: int, lookahead: int):
    """Greedy choice along rows; ``state`` bit d says row ``last + d`` is taken."""
    takes = []
    for i, mask in zip(idx, masks):
        state >>= min(i - last, lookahead + 1)
        last = i
        take = 0
        if not state & 1:
            for d in range(1, lookahead + 1):
                if mask >> (d - 1) & 1 and not state >> d & 1:
                    take = d
                    state |= 1 << d
                    break
        takes.append(take)
    return takes, state, last


def _choose(batches, lookahead: int):
    """Who takes whom, for rows sorted by document, block and place; a block may go on in the next batch."""
    key, state, last = None, 0, 0
    for pdf in batches:
        out = []
        columns = [pdf[c].tolist() for c in ("doc_id", "_block", "_idx", "_mask", "_state", "_last")]
        for doc, block, idx, mask, start, first in zip(*columns):
            if (doc, block) != key:
                key = (doc, block)
                state, last = (0, idx) if pd.isna(start) else (int(start), int(first))
            (take,), state, last = _walk([idx], [mask], state, last, lookahead)
            if take:
                out.append((doc, idx, take))
        yield pd.DataFrame(out, columns=["doc_id", "_idx", "_take"])


def _start_states(linked: DataFrame, lookahead: int, doc_type: str) -> DataFrame:
    """State in which each block of a long document starts; blocks of short ones need none."""
    long_docs = linked.filter(F.col("_block") > 0).select("doc_id").distinct()

    def report(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_idx")
        idx, masks = pdf["_idx"].tolist(), pdf["_mask"].tolist()
        ends, last = [], idx[-1]
        for state in range(1 << lookahead):
            # Bit d of a starting state stands for row (first of block) + d.
            ends.append(_walk(idx, masks, state, idx[0], lookahead)[1])
        return pd.DataFrame({
            "doc_id": [pdf["doc_id"].iloc[0]], "_block": [pdf["_block"].iloc[0]],
            "_first": [idx[0]], "_end": [last], "_ends": [ends],
        })

    reports = (
        linked.join(long_docs, "doc_id", "left_semi")
        .groupBy("doc_id", "_block")
        .applyInPandas(report, f"doc_id {doc_type}, _block long, _first long, _end long, _ends array<long>")
    )
    # One short row per block of a long document.
    return reports.groupBy("doc_id").applyInPandas(
        lambda pdf: _chain(pdf, lookahead), f"doc_id {doc_type}, _block long, _state long, _last long"
    )


def _chain(pdf: pd.DataFrame, lookahead: int) -> pd.DataFrame:
    pdf = pdf.sort_values("_block")
    state, last, out = 0, None, []
    for row in pdf.itertuples(index=False):
        block, first, end, ends = row[1], row[2], row[3], row[4]
        if last is not None:
            state >>= min(first - last, lookahead + 1)
        out.append((state & ((1 << lookahead) - 1), first))
        state, last = int(ends[state & ((1 << lookahead) - 1)]), end
    return pd.DataFrame({
        "doc_id": pdf["doc_id"], "_block": pdf["_block"],
        "_state": [s for s, _ in out], "_last": [f for _, f in out],
    })


# ------------------------------------------------------------------ ordering

def best_version(questions: DataFrame) -> DataFrame:
    """One row per document and number: the first answered, else the longest, ties the first.

    Rows without a number all stay.
    """
    answered = ~is_blank(F.col("answer"))
    rank = F.struct(
        (~answered).alias("a"), F.when(answered, 0).otherwise(-F.length("question")).alias("l"), F.col("pos")
    )
    rest = [c for c in questions.columns if c not in ("doc_id", "number")]
    best = (
        questions.filter(F.col("number").isNotNull()).groupBy("doc_id", "number")
        .agg(F.min_by(F.struct(*rest), rank).alias("_row"))
        .select("doc_id", "number", "_row.*")
    )
    return best.unionByName(questions.filter(F.col("number").isNull()).select("doc_id", "number", *rest))


def splice_order(questions: DataFrame) -> DataFrame:
    """Put numbered rows, as a block, before the place of their first number among the others.

    ``questions(doc_id, pos, number, question)``; other rows have a null
    number and go by ``pos``.  Of equal texts the first stays; empty ones stay all.
    """
    others = split_row_number(questions.filter(F.col("number").isNull()), ["doc_id"], ["pos"], "_r")
    numbered = questions.filter(F.col("number").isNotNull())
    first = numbered.groupBy("doc_id").agg(F.min("number").alias("_first"))
    part = F.lit(1 << 40)
    placed = others.join(first, "doc_id", "left").withColumn(
        "_at", F.when(F.col("_r") < F.col("_first"), F.col("_r")).otherwise(F.col("_r") + 2 * part)
    ).drop("_r", "_first")
    block = numbered.withColumn("_at", F.col("number") + part)
    both = placed.unionByName(block).withColumn("question", strip(F.col("question")))
    full = both.filter(F.col("question") != "")
    kept_keys = full.groupBy("doc_id", F.sha2("question", 256).alias("_digest")).agg(F.min(F.struct("_at", "pos")).alias("_k"))
    kept = full.join(
        kept_keys.select("doc_id", F.col("_k._at").alias("_at"), F.col("_k.pos").alias("pos")),
        ["doc_id", "_at", "pos"], "left_semi",
    ).unionByName(both.filter(F.col("question") == ""))
    return split_row_number(kept, ["doc_id"], ["_at", "pos"], "place").drop("_at")


def missing_numbers(passages: DataFrame, options: DataFrame) -> DataFrame:
    """Blank numbers of passages without options, each with a leftover option list by rank.

    ``passages(doc_id, text)``, ``options(doc_id, seq, number, options)``; a
    null number marks leftovers.  A number without a leftover keeps null options.
    """
    found = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\((\d+)\)"), F.lit(1))))
    seen = passages.select("doc_id", found.alias("_n")).select("doc_id", F.col("_n").try_cast("bigint").alias("number")).distinct()
    missing = seen.join(
        options.filter(F.col("number").isNotNull()).select("doc_id", "number").distinct(), ["doc_id", "number"], "left_anti"
    )
    ranked = split_row_number(missing, ["doc_id"], ["number"], "_rank")
    left = split_row_number(
        options.filter(F.col("number").isNull()).select("doc_id", "seq", "options"), ["doc_id"], ["seq"], "_rank"
    ).drop("seq")
    return ranked.join(left, ["doc_id", "_rank"], "left").select("doc_id", "number", "options")


def number_sort(questions: DataFrame) -> DataFrame:
    """Place of each row: by number when more than half of the document has one, missing last, else by ``pos``."""
    share = questions.groupBy("doc_id").agg((F.avg(F.col("number").isNotNull().cast("int")) > 0.5).alias("_by_number"))
    last = F.lit(1 << 40)
    key = F.when(
        F.col("_by_number"), F.coalesce(F.when(F.col("number") != 0, F.col("number").cast("long")), last)
    ).otherwise(F.col("pos").cast("long"))
    keyed = questions.join(share, "doc_id").withColumn("_at", key)
    return split_row_number(keyed, ["doc_id"], ["_at", "pos"], "place").drop("_at", "_by_number")


# Marks of a right answer by level.
LEVEL_MARKS = {
    "preecolier": 2.0, "pre-ecolier": 2.0, "ecolier": 2.0, "benjamin": 1.0, "cadet": 1.25, "junior": 1.5, "student": 1.75,
}


def position_marks(
    questions: DataFrame, subject: str, level: str | None = None
) -> DataFrame:
    """Marks and difficulty of each question.

    English levels have one mark.  In science the first third of the document
    scores 3, the second 4 and the rest 5; fewer than three questions are all easy.
    """
    if subject != "science":
        return _marked(questions, None, subject, level)
    return _marked(_placed(questions, "_number"), "_number", subject, level).drop("_number")


def _placed(questions: DataFrame, out: str) -> DataFrame:
    return split_row_number(questions, ["doc_id"], ["pos"], out)


def _marked(placed: DataFrame, number: str | None, subject: str, level: str | None) -> DataFrame:
    if subject != "science":
        fixed = LEVEL_MARKS.get(level) if subject == "english" else None
        return placed.withColumn("marks", F.lit(fixed).cast("double")).withColumn("difficulty", F.lit("EASY"))
    total = placed.groupBy("doc_id").agg(F.count("*").alias("_total"))
    group = F.when(F.col("_total") >= 3, F.floor(F.col("_total") / 3)).otherwise(F.col("_total"))
    easy, medium = F.col(number) <= group, F.col(number) <= group * 2
    return (
        placed.join(total, "doc_id")
        .withColumn("marks", F.when(easy, 3.0).when(medium, 4.0).otherwise(5.0))
        .withColumn("difficulty", F.when(easy, "EASY").when(medium, "MEDIUM").otherwise("HARD"))
        .drop("_total")
    )


def section_renumber(sections: DataFrame, answers: DataFrame) -> DataFrame:
    """Answer numbers of a section to numbers of the whole exam; numbers beyond the section go.

    ``sections(exam_id, section, size)``, ``answers(exam_id, section, number, answer)``.
    """
    upto = split_running_sum(sections, ["exam_id"], ["section"], F.col("size"), "_upto")
    return (
        answers.join(upto, ["exam_id", "section"])
        .filter(F.col("number") <= F.col("size"))
        .select(
            "exam_id", "section", (F.col("number") + F.col("_upto") - F.col("size")).cast("long").alias("number"), "answer"
        )
    )


def question_sheet(
    questions: DataFrame, key: DataFrame, subject: str, level: str | None = None
) -> DataFrame:
    """Hand-off table of thirteen columns per question.

    ``questions(doc_id, pos, question, options, answer)``, ``key(doc_id,
    number, correct)`` with 1–5.  The key wins over the parsed answer letter.
    """
    numbered = _marked(_placed(questions, "number"), "number", subject, level)
    letter = F.upper(strip(F.col("answer")))
    parsed = F.when(letter.rlike("^[A-E]$"), F.ascii(letter) - 64)
    right = key.groupBy("doc_id", "number").agg(F.min("correct").alias("correct"))  # one entry per number
    rows = numbered.join(right, ["doc_id", "number"], "left")
    return rows.select(
        "doc_id", "number",
        F.when(F.size("options") > 0, "MSA").otherwise("SAQ").alias("question_type"),
        "question",
        *[F.try_element_at("options", F.lit(i)).alias(f"option_{i}") for i in range(1, 6)],
        F.coalesce(F.col("correct"), parsed).cast("int").alias("correct_answer"),
        F.col("marks").alias("default_marks"),
        F.lit(30).alias("time_to_solve"),
        F.col("difficulty").alias("difficulty_level"),
        F.lit(None).cast("string").alias("hint"),
        F.lit(None).cast("string").alias("solution"),
    )


# ------------------------------------------------------------------- answers

def answer_prompts(bank: DataFrame) -> DataFrame:
    """Rows without an answer with their options written out."""
    options = F.transform("options", lambda o, i: F.concat(F.char(i + F.lit(65)), F.lit(". "), o))
    return bank.filter(is_blank(F.col("answer"))).select(
        "id", "content", F.coalesce(F.array_join(options, "\n"), F.lit("")).alias("options_text"), "subject"
    )


def answer_backfill(bank: DataFrame, responses: DataFrame):
    """Fill missing answers from stored responses ``(id, text)``; rows whose response has no letter.

    The first stand-alone A–D of the response counts.  Of several responses for one id the smallest letter
    counts; the id is an error only if none has a letter.
    """
    letter = F.regexp_extract(F.upper("text"), r"\b([A-D])\b", 1)
    open_rows = bank.filter(is_blank(F.col("answer"))).select("id")
    read = responses.join(open_rows, "id", "left_semi").select("id", F.nullif(letter, F.lit("")).alias("answer"))
    read = read.groupBy("id").agg(F.coalesce(F.min("answer"), F.lit("")).alias("answer"))
    patched = bank_patch(bank, read.filter(F.col("answer") != ""))
    message = F.concat(F.lit("ID "), F.col("id"), F.lit(": no answer letter in the response"))
    return patched, read.filter(F.col("answer") == "").select("id", message.alias("error"))


# ------------------------------------------------------------------ variants

# Synonyms, and context words by topic.
SYNONYMS = {
    "tính": ("xác định", "tìm"),
    "hãy": ("vui lòng", "mời"),
    "bao nhiêu": ("bao nhiêu là", "là bao nhiêu"),
    "số": ("con số", "giá trị"),
    "tổng": ("cộng", "tổng số"),
    "hiệu": ("chênh lệch", "hiệu số"),
    "lớn hơn": ("cao hơn", "nhiều hơn"),
    "nhỏ hơn": ("ít hơn", "thấp hơn"),
}
CONTEXTS = {
    "toan_hoc": {"quả táo": "viên bi", "cửa hàng": "siêu thị", "học sinh": "bạn An"},
    "vat_ly": {"chiếc xe": "tàu hỏa", "đi bộ": "chạy", "bạn An": "bạn Bình"},
    "sinh_hoc": {"cây": "thực vật", "động vật": "sinh vật", "môi trường": "hệ sinh thái"},
    "lich_su": {"vua": "chúa", "triều đình": "chính quyền", "chiến tranh": "xung đột"},
    "dia_ly": {"vùng": "khu vực", "núi": "cao nguyên", "đồng bằng": "bồn trũng"},
}
_OPTION = r"^[A-Ha-h][).\-:]\s+"


def _coin(seed, *parts) -> Column:
    """A fair choice that depends on the parts only."""
    return F.substring(seeded(seed, *parts), 1, 1) < "8"


def _vary_numbers(text: Column, seed, *parts) -> Column:
    """Every whole number moves by 15 %, at least 1, up or down; 0 stays."""
    pattern = r"(?U)\b\d+\b"
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def moved(v, i):
        n = v.try_cast("bigint")
        delta = F.greatest(F.lit(1), F.bround(n * 0.15).cast("bigint"))
        new = F.greatest(F.lit(1), F.when(_coin(seed, *parts, F.lit("#"), i), n - delta).otherwise(n + delta))
        return F.when(n == 0, "0").otherwise(F.coalesce(new.cast("string"), v))

    gaps = F.split(text, pattern)
    return F.array_join(F.zip_with(gaps, F.transform(values, moved), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def _rewrite_block(text: Column) -> Column:
    """Option blocks: the short head before ":" is set apart and only option lines follow."""
    parts = F.split(text, "\n")
    first = F.element_at(parts, 1)
    head = F.element_at(F.split(first, ":", 2), 1)
    tail = F.try_element_at(F.split(first, ":", 2), F.lit(2))
    words = F.size(F.filter(F.split(head, r"\s+"), lambda w: w != ""))
    stem = F.when(
        tail.isNotNull() & (words <= 5),
        F.when(strip(head) != "", F.concat(strip(head), F.lit(": "), strip(tail))).otherwise(strip(tail)),
    ).otherwise(first)
    options = F.filter(F.slice(parts, 2, ALL), lambda x: x.rlike(_OPTION))
    is_block = F.coalesce(F.try_element_at(parts, F.lit(2)).rlike(_OPTION), F.lit(False))
    return F.when(is_block, F.concat(stem, F.lit("\n"), F.array_join(options, "\n"))).otherwise(text)


def _forced(text: Column) -> Column:
    """A prefix for texts that came out unchanged."""
    bare = strip(text)
    has_options = F.exists(F.slice(lines(bare), 2, ALL), lambda x: x.rlike(_OPTION))
    ascii_share = F.length(F.regexp_replace(bare, NON_ASCII_CHAR, "")) / F.greatest(F.lit(1), F.length(bare))
    return (
        F.when(bare == "", bare)
        .when(has_options, _rewrite_block(bare))
        .when(ascii_share > 0.9, F.concat(F.lit("Choose the correct option: "), bare))
        .otherwise(F.concat(F.lit("Hãy cho biết: "), bare))
    )


def rule_variants(
    samples: DataFrame, k: int, topic: str | None = None, keywords: list[str] | None = None,
    paraphrase: bool = True, change_numbers: bool = True, change_context: bool = True, seed="0",
    text: str = "text", id_col: str = "id",
) -> DataFrame:
    """``k`` variants of each sample by rule: synonyms, numbers, context words, blanks."""
    rows = (
        samples.filter(strip(F.col(text)) != "")
        .select(F.col(id_col), strip_numbering(strip(F.col(text))).alias("_sample"))
        .select(id_col, "_sample", F.explode(F.sequence(F.lit(1), F.lit(int(k)))).alias("variant"))
    )
    who = [F.col(id_col), F.lit("|"), F.col("variant")]
    out = F.col("_sample")
    if paraphrase:
        for i, (word, (one, other)) in enumerate(SYNONYMS.items()):
            pick = F.when(_coin(seed, *who, F.lit(f"|{i}")), one).otherwise(other)
            out = F.replace(out, F.lit(word), pick)
    rows = rows.withColumn("_v", out)
    if change_numbers:
        rows = rows.withColumn("_v", _vary_numbers(F.col("_v"), seed, *who))
    if change_context:
        out = F.col("_v")
        for word, other in CONTEXTS.get(topic, {}).items():
            out = F.replace(out, F.lit(word), F.lit(other))
        for word in keywords or []:
            if word.strip():
                safe = word.strip().replace("\\", "\\\\").replace("$", "\\$")
                out = F.regexp_replace(out, r"(?s)^(.*?)\.\.\.", f"$1{safe}")
        rows = rows.withColumn("_v", out)
    rows = rows.withColumn("_v", _rewrite_block(strip_numbering(F.col("_v"))))
    same = question_key(F.col("_v")) == question_key(F.col("_sample"))
    return rows.select(id_col, "variant", F.when(same, _forced(F.col("_v"))).otherwise(F.col("_v")).alias("text"))


# ------------------------------------------------------------ formulas, shapes

# Plain characters of formula commands, in order of replacement.
FORMULA_SYMBOLS = [
    (r"\alpha", "α"), (r"\beta", "β"), (r"\gamma", "γ"), (r"\delta", "δ"), (r"\Delta", "Δ"), (r"\epsilon", "ε"),
    (r"\theta", "θ"), (r"\lambda", "λ"), (r"\mu", "μ"), (r"\pi", "π"), (r"\sigma", "σ"), (r"\phi", "φ"),
    (r"\omega", "ω"), (r"\infty", "∞"), (r"\pm", "±"), (r"\times", "×"), (r"\div", "÷"), (r"\leq", "≤"),
    (r"\geq", "≥"), (r"\neq", "≠"), (r"\ne", "≠"), (r"\approx", "≈"), (r"\sqrt", "√"), (r"\sum", "∑"),
    (r"\prod", "∏"), (r"\int", "∫"), (r"\partial", "∂"), (r"\nabla", "∇"), (r"\forall", "∀"), (r"\exists", "∃"),
    (r"\in", "∈"), (r"\notin", "∉"), (r"\subset", "⊂"), (r"\supset", "⊃"), (r"\cup", "∪"), (r"\cap", "∩"),
    (r"\emptyset", "∅"), (r"\rightarrow", "→"), (r"\leftarrow", "←"), (r"\Rightarrow", "⇒"), (r"\cdot", "·"),
    (r"\ldots", "…"), (r"\cdots", "⋯"), (r"\sin", "sin"), (r"\cos", "cos"), (r"\tan", "tan"), (r"\log", "log"),
    (r"\ln", "ln"), (r"\exp", "exp"),
]
SUPERSCRIPTS = ("0123456789+-=()nixy", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱˣʸ")
SUBSCRIPTS = ("0123456789+-=()aeinx", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑᵢₙₓ")


def _raised(text: Column, mark: str, table: tuple[str, str]) -> Column:
    """Characters after ``mark`` in small form: one character, then a braced group."""
    for pattern in (rf"{mark}(\w)", rf"{mark}\{{([^}}]+)\}}"):
        gaps = F.split(text, pattern)
        small = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda s: F.translate(s, *table))
        text = F.array_join(F.zip_with(gaps, small, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return text


def formula_text(formula: Column) -> Column:
    """Plain Unicode form of a simple formula."""
    out = formula
    for command, char in FORMULA_SYMBOLS:
        out = F.replace(out, F.lit(command), F.lit(char))
    out = F.regexp_replace(out, r"\\frac\{([^}]+)\}\{([^}]+)\}", "($1)/($2)")
    out = _raised(_raised(out, r"\^", SUPERSCRIPTS), "_", SUBSCRIPTS)
    out = F.regexp_replace(out, r"\\[a-zA-Z]+", "")
    return strip(F.regexp_replace(out, r"[{}]", ""))


_FORMULA = r"\$\$([^$]+)\$\$|\$([^$]+)\$"


def math_text(df: DataFrame, column: str) -> DataFrame:
    """Whether a text holds formulas, how many, and the text with formulas in plain Unicode."""
    text = F.col(column)
    has = text.rlike(_FORMULA)
    marked = F.regexp_extract_all(text, F.lit(_FORMULA), F.lit(0))
    plain = F.transform(marked, lambda m: formula_text(F.regexp_replace(m, r"^\$\$?|\$\$?$", "")))
    whole = F.array_join(
        F.zip_with(F.split(text, _FORMULA), plain, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""
    )
    return df.select(
        "*", has.alias("has_formula"), F.size(marked).alias("n_formulas"), F.when(has, whole).otherwise(text).alias("plain_text")
    )


# Words of shapes in order of choice, and how many vertex letters may follow.
SHAPES = {
    "triangle": r"(?iu)(?:tam giác|triangle|△)\s*([A-Z]{3})?",
    "rectangle": r"(?iu)(?:hình chữ nhật|rectangle)\s*([A-Z]{4})?",
    "square": r"(?iu)(?:hình vuông|square)\s*([A-Z]{4})?",
    "circle": r"(?iu)đường tròn|hình tròn|circle|tâm\s*([A-Z])|bán kính",
    "parallelogram": r"(?iu)(?:hình bình hành|parallelogram)\s*([A-Z]{4})?",
    "trapezoid": r"(?iu)(?:hình thang|trapezoid)\s*([A-Z]{4})?",
}


def shape_tags(df: DataFrame, column: str) -> DataFrame:
    """Geometric shape named in a text, its vertex letters, and the first four measurements."""
    text = F.col(column)
    shape, letters = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern in reversed(SHAPES.items()):
        hit = text.rlike(pattern)
        group = F.regexp_extract(text, pattern, 1)
        shape = F.when(hit, name).otherwise(shape)
        letters = F.when(hit, F.when(group.rlike("^[A-Z]+$"), group)).otherwise(letters)
    numbers = F.regexp_extract_all(text, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0))
    values = F.slice(F.transform(numbers, lambda v: F.replace(v, F.lit(","), F.lit(".")).cast("double")), 1, 4)
    return df.select(
        "*", shape.alias("shape"), letters.alias("labels"),
        F.when(shape.isNotNull(), values).alias("measurements"),
    )
