"""Files in, files out."""

import json
import random

from pyspark.sql import functions as F

from examloom.sources import banks, feeds, files


def test_bank_json_shapes(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps([
        {"question": " q1 ", "type": "essay", "options": []}, {"content": "", "answer": "A"},
        {"content": "q2", "subject": "math", "options": ["a", "b"], "tags": ["t"], "difficulty": "hard"}]))
    (tmp_path / "object.json").write_text(json.dumps({"questions": [{"content": "q3", "grade": "9"}]}))
    rows = {r["content"]: r for r in banks.read_bank_json(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["q1", "q2", "q3"]
    assert (rows["q1"]["question_type"], rows["q1"]["subject"], rows["q1"]["options"]) == ("essay", "unknown", None)
    assert (rows["q2"]["options"], rows["q2"]["difficulty"], rows["q3"]["difficulty"]) == (["a", "b"], "hard", "medium")


def test_moodle_rules(spark, tmp_path):
    (tmp_path / "q.xml").write_text("""<?xml version="1.0"?><quiz>
<question type="category"><category><text>c</text></category></question>
<question type="truefalse"><name><text>fallback</text></name><questiontext format="html"><text></text></questiontext>
 <answer fraction="100"><text>true</text></answer><answer fraction="50"><text>half</text></answer><answer fraction="0"><text>false</text></answer></question>
<question type="numerical"><name><text>n</text></name><questiontext format="html"><text><![CDATA[<p>2 & 3</p>]]></text></questiontext></question>
</quiz>""")
    rows = {r["content"]: r for r in banks.read_moodle_xml(spark, str(tmp_path / "q.xml")).collect()}
    assert sorted(rows) == ["<p>2 & 3</p>", "fallback"]
    assert (rows["fallback"]["answer"], rows["fallback"]["question_type"]) == ("half", "mcq")
    assert (rows["<p>2 & 3</p>"]["options"], rows["<p>2 & 3</p>"]["question_type"]) == (None, "blank")


def test_text_corpus(spark, tmp_path):
    (tmp_path / "toan").mkdir()
    (tmp_path / "toan" / "a.txt").write_text("1. one?\n2. two?")
    (tmp_path / "toan" / "b.md").write_text("three")
    (tmp_path / "toan" / "c.bin").write_text("no")
    got = sorted((r["subject"], r["file"], r["question"]) for r in banks.read_text_corpus(spark, str(tmp_path)).collect())
    assert got == [("toan", "a.txt", "one?"), ("toan", "a.txt", "two?"), ("toan", "b.md", "three")]


def test_numbering_over_partitions(spark):
    rows = spark.range(1000).repartition(7).select(F.col("id"), (-F.col("id")).alias("k"))
    got = banks._numbered(rows, ["k"]).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 1001)) and [r["id"] for r in got] == list(range(999, -1, -1))


def test_inventory(spark, tmp_path):
    for path, size in {"toan/10/a.txt": 10, "toan/11/b.txt": 2048, "ly/10/c.png": 5, "ly/10/d.PNG": 5, "ly/10/c.png.meta.json": 1}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x" * size)
    listed = files.file_inventory(spark, str(tmp_path))
    assert {r["filename"]: r["size_text"] for r in listed.collect()} == {"a.txt": "10 B", "b.txt": "2.0 KB", "c.png": "5 B", "d.PNG": "5 B"}
    stats = {(r["level"], r["subject"], r["grade"]): (r["files"], r["bytes"]) for r in files.file_stats(listed).collect()}
    assert stats["total", None, None] == (4, 2068) and stats["subject", "toan", None] == (2, 2058) and stats["grade", None, "10"] == (3, 20)
    images = {r["extension"]: (r["files"], r["repeated"]) for r in files.image_inventory(spark, str(tmp_path / "ly")).collect()}
    assert images[".png"] == (2, 1)
    assert files.image_duplicates(spark, str(tmp_path)).first()["copies"] == 2


def test_feed_edge_cases(spark):
    def frame(payload):
        return spark.createDataFrame([("9", json.dumps(payload))], "category string, payload string")

    out = feeds.normalize_feeds({
        "opentdb": frame({"results": [{"question": "A &amp; &quot;b&quot;", "correct_answer": "x", "incorrect_answers": ["x", "a"], "difficulty": "easy"}]}),
        "quizapi": frame([{"text": "t", "answers": []}, {"text": "u", "answers": [{"text": "1"}, {"text": "2"}], "tags": ["Linux"]}]),
        "ninjas": frame({"question": "o", "answer": "z", "category": ""}),
    })
    rows = {r["source"]: r for r in out.collect()}
    assert rows["opentdb.com"]["question"] == 'A & "b"' and rows["opentdb.com"]["answer"] == "B"
    assert rows["quizapi.io"]["question"] == "u" and rows["quizapi.io"]["answer"] == "A"
    assert rows["api-ninjas.com"]["subject"] == "general" and rows["api-ninjas.com"]["question_type"] == "short_answer"


def test_list_records_in_small_ranges(spark, tmp_path):
    rng, want = random.Random(2), {}
    bits = ["a", "}", "{", "[", "]", '"', "\\", "\\\\\"", "é", "\n", ",", '"questions":[', " "]

    def text():
        return "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))

    def record():
        return {"content": text(), "n": {"x": [{}, text(), {"y": [text()]}], "questions": [{"a": text()}]}, "options": [text()]}

    for k in range(12):
        records = [record() for _ in range(rng.choice([0, 1, 3, 60]))]
        extra = {"meta": {"a": {"b": [text(), {}]}, "questions": [{"no": 1}]}, "t": text()}
        whole = [records, {**extra, "questions": [*records], "after": {"c": {"d": {}}, "e": [[{}], {"f": 1}]}}, {"questions": records}][k % 3]
        (tmp_path / f"f{k}.json").write_text(json.dumps(whole, indent=[None, 1][k % 2], ensure_ascii=k % 4 < 2))
        want[f"f{k}.json"] = records
    (tmp_path / "single.json").write_text(json.dumps({"content": "alone", "n": {}}))
    want["single.json"] = [{"content": "alone", "n": {}}]
    (tmp_path / "empty.json").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("97b", "1000b", old):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = banks.list_records(spark, str(tmp_path)).orderBy("file", "place").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        found = {}
        for r in got:
            found.setdefault(r.file.rsplit("/", 1)[1], []).append(json.loads(r.record))
        assert found == {k: v for k, v in want.items() if v}
