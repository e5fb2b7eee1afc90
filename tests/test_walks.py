"""Walks over arrays inside a row, against plain loops."""

import random

from pyspark.sql import functions as F

from examloom.functions.scans import running
from examloom.operators import documents, sheets


def test_running_states_over_many_chunks(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        values = [random.Random(n).randint(0, 9) for _ in range(n)]
        row = spark.createDataFrame([(values,)], "v array<int>").select(
            running(F.col("v"), F.lit(0), lambda s, x: s + x, "int").alias("s")).first()
        assert row.s == [sum(values[:i + 1]) for i in range(n)]
    assert spark.sql("SELECT CAST(NULL AS array<int>) AS v").select(
        running(F.col("v"), F.lit(0), lambda s, x: s + x, "int").alias("s")).first().s is None


LINES = [
    ("section", "Section B: next", [], 0), ("cloze", "{n}. Fill ___ (3) or ___ (4) here", [], 2), ("numbered", "{n}. Stem {n}", [], 0),
    ("numbered", "{n}.", [], 0), ("numbered", "{n}) A. x  B. y", ["x", "y"], 0), ("options", "A. p  B. q", ["p", "q"], 0),
    ("option", "C. z", ["z"], 0), ("number", "77", [], 0), ("question", "Which one of these is right?", [], 0),
    ("question", "Which ... of these is the right one?", [], 0), ("other", "stray words", [], 0), ("other", "blank ___ words", [], 0),
]


def by_hand(lines, tables):
    """The walk, line by line."""
    out, now, turn = [], None, 0

    def opened(kind, text, n, options):
        if kind not in ("numbered", "question"):
            return None
        stem = "" if kind == "numbered" and text == f"{n}." else f"{n}. ..." if options else text.split(". ", 1)[-1] if kind == "numbered" else text
        out.append({"number": n if kind == "numbered" else None, "question": stem, "options": list(options), "asked": True})
        return out[-1]

    for kind, text, options, blanks, n in lines:
        if kind == "section":
            now = None
        elif kind == "cloze":
            now = {"left": ["3", "4"], "text": text}
        elif now is not None and "left" in now:
            if kind == "options" and now["left"]:
                out.append({"number": None, "question": f"Cloze ({now['left'].pop(0)}): {now['text'][:100]}...", "options": list(options), "asked": False})
            elif kind not in ("options", "option"):
                now = opened(kind, text, n, options)
        elif kind == "numbered" or (kind == "question" and now is None):
            now = opened(kind, text, n, options)
        elif now is not None and kind in ("options", "option"):
            now["options"] += options
            now = None if len(now["options"]) >= 5 else now
        elif now is not None and now["options"]:
            now = opened(kind, text, n, options) if "..." in text or "___" in text else now
        elif now is not None:
            now["question"] = f"{now['question']}\n{text}".strip()
    for q in out:
        if q["asked"] and not q["options"] and turn < len(tables):
            q["options"], turn = tables[turn], turn + 1
    return [(q["number"], q["question"], q["options"]) for q in out if q["question"]]


def test_numbered_lines_and_leftover_tables(spark):
    rng, rows, want = random.Random(5), [], {}
    for doc in range(60):
        lines = [(*rng.choice(LINES), i + 1) for i in range(rng.choice([0, 1, 5, 40, 400]))]
        lines = [(k, text.format(n=n), o, b, n) for k, text, o, b, n in lines]
        tables = [[f"t{i}", "u"] for i in range(rng.randint(0, 4))]
        rows.append((doc, "\n".join(x[1] for x in lines), tables, "kept"))
        want[doc] = by_hand(lines, tables)
    rows += [(100, None, None, "kept"), (101, "1. Lonely", None, "kept")]
    got = {}
    docs = spark.createDataFrame(rows, "doc_id int, text string, tables array<array<string>>, number2 string")
    for r in documents.numbered_line_parse(docs, tables="tables").orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.number, r.question, r.options))
    assert got.pop(101) == [(1, "Lonely", [])]
    assert got == {d: q for d, q in want.items() if q}


def test_paper_of_25_questions(spark):
    text = "\n".join(f"{i}. Question {i}\nA) a{i}\tB) b{i}\tC) c{i}\tD) d{i}" for i in range(1, 26))
    got = documents.numbered_line_parse(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert [(r.number, r.question, r.options) for r in got] == [
        (i, f"Question {i}", [f"{x}{i}" for x in "abcd"]) for i in range(1, 26)]


def test_rows_of_a_large_sheet(spark):
    rng = random.Random(3)
    rects = [("s", i, rng.uniform(0, 9), float(rng.randint(0, 3000))) for i in range(20_000)] + [("s", -1, 1.0, None), (None, -2, 1.0, 2.0)]
    first, row, want = None, 0, {}
    for y in sorted({r[3] for r in rects[:20_000]}):
        if first is None or y - first > 15:
            first, row = y, row + 1
        want[y] = row
    got = sheets.row_cluster(spark.createDataFrame(rects, "sheet_id string, id int, cx double, cy double")).collect()
    assert len(got) == len(rects)
    assert all(r.row_no == (want[r.cy] if r.id >= 0 else 0) for r in got)


def test_long_outline(spark):
    text = "\n".join(f"Chương {i // 100 + 1}: Ch{i // 100 + 1}\nBài {i}: T{i}" if i % 100 == 0 else f"Bài {i}: T{i}\nkiến thức {i}" for i in range(1000))
    got = documents.outline_fill(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("pos").collect()
    assert [r.topic for r in got] == [f"T{i}" for i in range(1000)]
    assert [r.chapter for r in got] == [f"Chương {i // 100 + 1}: Ch{i // 100 + 1}" for i in range(1000)]
    assert [r.knowledge for r in got] == ["" if i % 100 == 0 else f"kiến thức {i}" for i in range(1000)]
