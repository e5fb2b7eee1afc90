"""Splitting large keys changes nothing in the results."""

import contextlib
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from examloom.functions.ranking import split_row_number, top_n, with_neighbours
from examloom.operators import assemble, curation, sheets
from examloom.plans import bindings as b
from examloom.plans.bank_queries import MATRIX, OVERLAPPING
from examloom.plans.registry import Tables

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@contextlib.contextmanager
def many_ranges(spark):
    """Small tables too are cut into as many ranges as there are shuffle partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def both_ways(spark, make):
    """The rows from many ranges are those from one."""
    with many_ranges(spark):
        cut = rows_of(make())
    assert cut == rows_of(make())
    return cut


def skewed(spark, n=3000):
    """A third of the rows has key 0."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("k"), F.col("id").alias("pos"), F.md5(F.col("id").cast("string")).alias("h")
    )


def test_split_row_number(spark):
    df = skewed(spark)
    plain = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("pos")).cast("long"))
    split = split_row_number(df, ["k"], ["pos"], "rn")
    assert rows_of(split.select("k", "pos", "rn")) == rows_of(plain.select("k", "pos", "rn"))


def test_one_key_with_small_numbers_and_null_keys_are_split(spark):
    """All rows in one document, numbers 1 to 40, and a null key: many balanced ranges."""
    from examloom.functions.ranking import _ranged

    for key in (F.lit(1).cast("long"), F.lit(None).cast("long")):
        df = spark.range(40_000).select(key.alias("k"), (F.col("id") % 40).alias("number"), F.col("id").alias("pos"))
        with many_ranges(spark):
            sizes = [r["count"] for r in _ranged(df, ["k"], ["number", "pos"]).groupBy("_range").count().collect()]
            got = split_row_number(df, ["k"], ["number", "pos"]).select("pos", "rn")
            assert len(sizes) == 8 and max(sizes) < 3 * min(sizes)
            plain = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("number", "pos")).cast("long")).select("pos", "rn")
            assert rows_of(got) == rows_of(plain)


def test_mended_operators(spark):
    rows = spark.createDataFrame([(1, 0, None, "a", None), (1, 1, None, "b", None), (1, 2, 3, "long", None), (1, 3, 3, "c", "A")], "doc_id long, pos long, number long, question string, answer string")
    assert sorted(r["question"] for r in curation.best_version(rows).collect()) == ["a", "b", "c"]
    bank = spark.createDataFrame([(1, "x", None), (2, "y", "B"), (3, "z", None)], "id long, content string, answer string")
    said = spark.createDataFrame([(1, "it is C"), (1, "no, B"), (3, "hm"), (3, "none"), (2, "A")], "id long, text string")
    patched, errors = curation.answer_backfill(bank, said)
    assert sorted((r["id"], r["answer"]) for r in patched.collect()) == [(1, "B"), (2, "B"), (3, None)]
    assert [r["id"] for r in errors.collect()] == [3]
    held = spark.createDataFrame([(1, 5, 2, 1.0)], "exam_id long, question_id long, order int, points double")
    more = spark.createDataFrame([(1, [7, 8]), (1, [9]), (2, [4])], "exam_id long, question_ids array<long>")
    got = sorted((r["exam_id"], r["order"], r["question_id"]) for r in assemble.exam_append(held, more).collect())
    assert got == [(1, 2, 5), (1, 3, 7), (1, 4, 8), (1, 5, 9), (2, 1, 4)]
    pool = spark.range(9)
    assert [assemble.sample_mix(pool, spark.range(100, 109), n, 0.5).where("id < 100").count() for n in (5, 7)] == [2, 4]
    text = spark.createDataFrame([(1, "(1234567890) (2)")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, seq long, number long, options array<string>")
    assert sorted(int(r["number"]) for r in curation.missing_numbers(text, none).collect()) == [2, 1234567890]


def test_split_row_number_by_hash(spark):
    df = skewed(spark)
    plain = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("h")).cast("long"))
    split = split_row_number(df, ["k"], ["h"], "rn")
    assert rows_of(split.select("k", "h", "rn")) == rows_of(plain.select("k", "h", "rn"))


def test_with_neighbours(spark):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("pos")
    plain = df.select("k", "pos", F.lag("pos").over(w).alias("a"), F.lead("pos").over(w).alias("b"))
    split = with_neighbours(df, ["k"], "pos", F.struct(F.col("pos").alias("p")), F.struct(F.col("pos").alias("p")))
    assert rows_of(split.select("k", "pos", "_prev.p", "_next.p")) == rows_of(plain)


def test_top_n_is_limited_before_the_shuffle(spark):
    plan = top_n(skewed(spark), ["k"], ["pos"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_top_n_beyond_the_group_limit(spark):
    df = skewed(spark, 9000)
    w = Window.partitionBy("k").orderBy("h")
    plain = df.withColumn("rn", F.row_number().over(w)).filter("rn <= 1500")
    assert rows_of(top_n(df, ["k"], ["h"], 1500)) == rows_of(plain)


def greedy(rows, lookahead=4, min_len=10):
    """Plain walk over (pos, text, options) rows."""
    import re

    clean = [re.sub(r"(?:[A-Z]\d){2,}", "", t) for _, t, _ in rows]
    gone, out = set(), []
    for i, (pos, text, options) in enumerate(rows):
        if i in gone:
            continue
        for j in range(i + 1, min(i + 1 + lookahead, len(rows))):
            other = rows[j]
            if j in gone or len(clean[i]) <= min_len or len(clean[j]) <= min_len:
                continue
            if clean[i] in clean[j] or clean[j] in clean[i] or text in other[1] or other[1] in text:
                noisy, other_noisy = clean[i] != text, clean[j] != other[1]
                best = other[1] if noisy and not other_noisy else (text if not noisy else clean[i])
                out.append((pos, best, tuple(options if len(options) >= len(other[2]) else other[2])))
                gone.add(j)
                break
        else:
            out.append((pos, text, tuple(options)))
    return out


def test_near_dup_merge_against_a_walk(spark):
    rng = random.Random(5)
    stems = ["which planet is the largest", "how many legs has a spider", "K1K2what is the capital of peru"]
    docs = {1: 200, 2: 7, 3: 1, 4: 90}
    data, want = [], []
    for doc, n in docs.items():
        rows = []
        for pos in range(n):
            text = rng.choice(stems) + rng.choice(["", " ?", " now"]) if rng.random() < 0.8 else rng.choice(["short", f"unlike text number {pos}"])
            if rng.random() < 0.2:
                text = text.replace("K1K2", "")
            rows.append((pos * 3, text, [f"o{i}" for i in range(rng.randrange(4))]))
        data += [(doc, *r) for r in rows]
        want += [(doc, *r) for r in greedy(rows)]
    df = spark.createDataFrame(data, "doc_id long, pos long, question string, options array<string>")
    for block in (7, 50, 50_000):
        out = curation.near_dup_merge(df, block_rows=block).select("doc_id", "pos", "question", "options")
        got = [(r[0], r[1], r[2], tuple(r[3])) for r in out.collect()]
        assert sorted(got) == sorted(want), block


def test_near_dup_merge_sends_texts_once(spark):
    """To find candidates a text travels once and alone; the query itself, which wants no text, sends none."""
    from examloom.plans import QUERIES

    seen = []
    real = curation.checkpointed
    curation.checkpointed = lambda df: seen.append(df) or real(df)
    try:
        last = QUERIES["near_dup_merge"](spark, FOLDER)
    finally:
        curation.checkpointed = real

    def sent(df):
        """Columns of strings and structs below every exchange of the plan."""
        out, todo = [], [df._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            if node.nodeName() == "AdaptiveSparkPlan":
                todo.append(node.initialPlan())
            if node.nodeName() == "Exchange":
                out.append([f"{a.name()}:{a.dataType().catalogString()}" for a in map(node.output().apply, range(node.output().size()))])
            todo += map(node.children().apply, range(node.children().size()))
        return [[c for c in cols if c.endswith(":string") or ":struct" in c] for cols in out]

    assert all(not cols for cols in sent(last))
    masks = [df for df in seen if "_mask" in df.columns]
    assert len(masks) == 1 and [c for c in sent(masks[0]) if c] == [["question:string", "_clean:string"]]


def test_near_dup_merge_places_that_tie_and_null_documents(spark):
    """Rows at one place are ordered by what they hold, each once; rows without a document stay as they are."""
    rows = [(1, 0, "what is the capital", ["a"]), (1, 0, "an unlike question", ["b"]), (1, 1, "what is the capital of peru", ["c", "d"]),
            (None, 0, "what is the capital", ["a"]), (None, 1, "what is the capital of peru", ["c"])]
    df = spark.createDataFrame(rows, "doc_id long, pos long, question string, options array<string>")
    for block in (1, 50_000):
        got = sorted((str(r["doc_id"]), r["question"], len(r["options"]), r["merged"]) for r in curation.near_dup_merge(df, block_rows=block).collect())
        assert got == [("1", "an unlike question", 1, False), ("1", "what is the capital", 2, True),
                       ("None", "what is the capital", 1, False), ("None", "what is the capital of peru", 1, False)]


def test_bilingual_merge_split(spark):
    t = Tables(spark, FOLDER)
    from examloom.plans.curation_queries import merge_rows

    rows = merge_rows(t)
    both_ways(spark, lambda: curation.bilingual_merge(rows))


def test_ordering_operators_split(spark):
    from examloom.plans.curation_queries import paper

    rows = paper(Tables(spark, FOLDER))
    for op in (curation.splice_order, curation.number_sort):
        both_ways(spark, lambda op=op: op(rows).select("doc_id", "pos", "place"))
    sheet_rows = rows.drop("number").withColumn("options", F.array(F.lit("a"))).withColumn("answer", F.lit("a"))
    key = rows.select("doc_id", F.lit(2).cast("long").alias("number"), F.lit(3).alias("correct")).distinct()
    both_ways(spark, lambda: curation.question_sheet(sheet_rows, key, "science"))
    both_ways(spark, lambda: curation.position_marks(rows, "science").select("doc_id", "pos", "marks"))


def test_section_renumber_split(spark):
    sections = spark.range(300).select((F.col("id") % 3).alias("exam_id"), F.col("id").alias("section"), (F.col("id") % 4 + 1).alias("size"))
    answers = sections.select("exam_id", "section", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("number"), F.lit("A").alias("answer"))
    both_ways(spark, lambda: curation.section_renumber(sections, answers))


def test_link_frontier_takes_the_nearest(spark):
    from examloom.operators import pages

    urls = ["http://s/a", "http://s/b/", "http://s/c#x", "http://s/d", "http://s/e"]
    stored = spark.createDataFrame([(u,) for u in urls], "url string")
    links = spark.createDataFrame([("http://s/a", "http://s/c"), ("http://s/a", "http://s/b"), ("http://s/b", "http://s/d"), ("http://s/d", "http://s/a"), ("http://s/d", "http://other")], "url string, link string")
    seeds = spark.createDataFrame([("http://s/a",)], "url string")
    got = [(r["depth"], r["url"]) for r in pages.link_frontier(stored, links, seeds, max_pages=2).collect()]
    assert got == [(0, "http://s/a"), (1, "http://s/b")]
    assert pages.link_frontier(stored, links, seeds).count() == 4


def test_exam_variants_split(spark):
    t = Tables(spark, FOLDER)
    args = (b.exam_questions(t), b.questions(t), ["A", "B"], 5)
    pick = ["exam_id", "variant_code", "position", "question_id"]
    both_ways(spark, lambda: assemble.exam_variants(*args).select(*pick))


def filled_in_turn(rows, matrix, seed, oversample, md5):
    taken, out, cell = set(), [], 0
    for row in matrix:
        for level in ("easy", "medium", "hard"):
            n = row.get(level, 0)
            if n <= 0:
                continue
            cell += 1
            fit = [r for r in rows if r["difficulty"] == level and (not row["topic"] or r["topic"] == row["topic"]) and r["id"] not in taken]
            fit.sort(key=lambda r: (r["times_used"], md5(f"{seed}{r['id']}"), r["id"]))
            fit = fit[: n * oversample]
            if oversample > 1:
                fit.sort(key=lambda r: (md5(f"{seed}/{r['id']}"), r["id"]))
            for r in fit[:n]:
                taken.add(r["id"])
                out.append((cell, r["id"]))
    return sorted(out)


def test_matrix_pick_against_a_walk(spark):
    import hashlib

    bank = b.bank(Tables(spark, "/root/testdata/sf0.01")).drop("content", "options", "created_at")
    rows = [
        r for r in bank.collect() if r["subject"] == "en" and r["question_type"] == "mcq" and r["answer"]
    ]
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    for matrix in (MATRIX, OVERLAPPING):
        for oversample in (1, 3):
            picks = assemble.matrix_pick(bank, matrix, "en", seed=7, oversample=oversample)
            got = sorted((r["cell"], r["id"]) for r in picks.collect())
            assert got == filled_in_turn(rows, matrix, 7, oversample, md5)
            ids = [i for _, i in got]
            assert len(ids) == len(set(ids))


def test_row_cluster_anchor(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (1, 9.0, 10.0), (1, 3.0, 20.0), (1, 1.0, 30.0)], "sheet_id long, cx double, cy double")
    got = {r["cy"]: r["row_no"] for r in sheets.row_cluster(df).collect()}
    assert got == {0.0: 1, 10.0: 1, 20.0: 2, 30.0: 2}
