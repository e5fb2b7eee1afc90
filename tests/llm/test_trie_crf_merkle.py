"""Prefix trie, language field and Merkle manifest against brute force."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from corpus_cases import awkward, frame, prose
from pyspark.sql import functions as F

from examloom.llm import language_crf, merkle, prefix_trie
from examloom.llm.queries import QUERIES

# ---- prefix trie ---------------------------------------------------------------------------------------------------

TALKS = "conv_id bigint, turn bigint, role string, text string, depth bigint, path string, node string, ends string, size int"


def talks(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", "n", "e", 2) for r in rows], TALKS)


def plain_trie(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            convs[c].append((turn is not None, turn or 0, role, tie, text))
    convs = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in convs.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = (*convs.get(c - c % 100, [])[:h], *own[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = collections.Counter(n[:-1] for n in members if n)
    out = []
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), children[node], sum(not children[n] for n in below), saved, sha))
    return collections.Counter(out)


def run_trie(spark, rows):
    return collections.Counter(tuple(r) for r in prefix_trie.trie(prefix_trie.rebuilt(talks(spark, rows))).collect())


def test_trie_of_awkward_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (2, None, "user", "a"), (3, 0, None, None), (4, 0, "", ""), (5, 5, "user", "x" * 70_000)]
    rows += [(6, 0, "user", "t"), (6, 0, "bot", "t"), (6, 0, "bot", "t"), (None, 0, "user", "lost"), (-7, 0, "user", "a"), (305, 0, "user", "no base"), (10**15, 1, "u", "é漢字")]
    rows += [(100 + c, t, "user", f"{t}") for c in range(12) for t in range(c)]  # 111 and others below their bases
    assert run_trie(spark, rows) == plain_trie(rows)


def test_trie_cuts_through_copies(spark):
    """Copies of one conversation and of one first turn over many shards; members that end at inner nodes."""
    rows = [(c, t, "user", f"same {t}") for c in range(1, 700) if c % 2 for t in range(7)]
    rows += [(c, t, "user", f"same {t}" if t < c % 7 else f"own {c}") for c in range(1, 700) if c % 2 == 0 for t in range(7)]
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for shards in ("1", "29"):
            spark.conf.set("spark.sql.shuffle.partitions", shards)
            assert run_trie(spark, rows) == plain_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])


def test_trie_of_one_long_conversation(spark):
    rows = [(1, t, "user", f"turn {t % 50}") for t in range(8000)] + [(2, t, "user", f"turn {t}") for t in range(20)]
    paths = []
    for c, n in ((1, 8000), (2, 20)):  # conversation 0 is absent, so that the first turns are lost
        paths.append([f"turn {t % 50}" for t in range(n)][zlib.crc32(str(c).encode()) % 6 :])
    common = next(k for k, (a, b) in enumerate(zip(*paths)) if a != b) if paths[0][: len(paths[1])] != paths[1] else len(paths[1])
    got = run_trie(spark, rows)
    assert sum(got.values()) == 1 + len(paths[0]) + len(paths[1]) - common
    assert sorted(k[1] for k in got)[-1] == len(paths[0])


def test_trie_without_rows(spark):
    assert not run_trie(spark, [])
    assert not run_trie(spark, [(None, 0, "user", "a")])


# ---- language field ------------------------------------------------------------------------------------------------


def plain_marginals(scores, transitions):
    step, e = np.exp(transitions), np.exp(scores)
    ahead, behind = np.zeros_like(e), np.zeros_like(e)
    m = np.ones(e.shape[1])
    for t in range(len(e)):
        m = (m @ step) * e[t]
        ahead[t] = m = m / m.sum()
    m = np.ones(e.shape[1])
    for t in range(len(e) - 1, -1, -1):
        behind[t] = m
        m = step @ (e[t] * m)
        m = m / m.sum()
    both = ahead * behind
    return both / both.sum(axis=1, keepdims=True)


def test_marginals_in_lanes_are_exact():
    r = np.random.default_rng(1)
    counts = np.array([1, 63, 64, 65, 200, 3, 128, 5000])
    scores, transitions = r.normal(0, 2, (counts.sum(), 3)), r.normal(0, 1, (3, 3))
    got, at = language_crf.marginals(scores, counts, transitions), 0
    for c in counts:
        assert np.allclose(got[at : at + c], plain_marginals(scores[at : at + c], transitions), atol=1e-9)
        at += c


def test_gradient_of_transitions():
    """The pair sums are the slope of the logarithm of the partition sum."""
    r = np.random.default_rng(2)
    scores, transitions = r.normal(0, 1, (2, 5, 3)), r.normal(0, 1, (3, 3))

    def partition(t):
        total = 0.0
        for row in scores:
            m = np.ones(3)
            for e in np.exp(row):
                m = (m @ np.exp(t)) * e
            total += np.log(m.sum())
        return total

    _, pairs = language_crf._pair_marginals(scores, transitions)
    for i in range(3):
        for j in range(3):
            up = transitions.copy()
            up[i, j] += 1e-5
            assert (partition(up) - partition(transitions)) / 1e-5 == pytest.approx(pairs[i, j], abs=1e-3)


LATIN = {"en": "the of and to in is that with".split(), "de": "der und das nicht zu ein mit für".split(), "ru": "и в не на что он как это".split()}


def sentence(lang, seed, n=30):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(LATIN[lang], n))


def test_languages_of_words_and_texts(spark):
    rows = [(i, sentence(lang, i), lang, "s") for i, lang in enumerate([*LATIN] * 40)]
    docs = frame(spark, rows)
    model = language_crf.fit(docs)
    assert model.languages == ["de", "en", "ru"]
    mixed = sentence("en", 1) + " | " + sentence("de", 2) + " — " + sentence("ru", 3, 60)
    new = frame(spark, [(1, mixed), (2, None), (3, "12 +- 7"), (4, ""), (None, sentence("de", 9)), (5, "漢字"), (6, "in"), (7, sentence("ru", 5) * 400)])
    out = language_crf.tagged(new, model)
    assert {"key", "bucket", "_bad", "quality_score"} <= set(out.columns) and "text" not in out.columns
    got = {r["doc_id"]: r for r in out.collect()}
    runs = got[1]["runs"]
    assert [r["lang"] for r in runs] == ["en", "de", "ru"] and got[1]["lang_pred"] == "ru"
    assert [mixed[r["start"] : r["end"]] for r in runs] == [sentence("en", 1), sentence("de", 2), sentence("ru", 3, 60)]
    assert all((got[i]["lang_pred"], got[i]["score"], got[i]["runs"]) == ("und", 0.0, []) for i in (2, 3, 4))
    assert got[None]["lang_pred"] == "de" and got[7]["lang_pred"] == "ru" and got[5]["lang_pred"] in model.languages
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_languages_do_not_come_from_held_out_rows(spark):
    rows = [(i, sentence("en", i), "en", "s") for i in range(30)] + [(i, sentence("ru", i), "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else None, "s") for i in range(30, 90)]
    model = language_crf.fit(frame(spark, rows))
    assert model.languages == ["en"]
    assert {r["lang_pred"] for r in language_crf.tagged(frame(spark, rows), model).collect()} == {"en"}
    assert language_crf.fit(frame(spark, [])) is None
    assert [r["lang_pred"] for r in language_crf.tagged(frame(spark, [(1, "word")]), None).collect()] == ["und"]
    assert language_crf.tagged(frame(spark, []), model).count() == 0
    assert language_crf.tagged(frame(spark, awkward()), model).count() == len(awkward())


def test_sample_bounds_rows_of_a_repeated_id(spark):
    rows = [(1, sentence("en", 1), "en", "s")] * 3000 + [(2, sentence("de", 2), "de", "s")] * 5
    docs = frame(spark, rows).select("doc_id", "text", "lang")
    sample = language_crf._sample(docs, {"de": 5, "en": 3000})
    assert sum(k == "en" for k, _ in sample) <= language_crf.SAMPLE


def test_op12_on_held_out_languages(spark):
    folder = "/root/testdata/sf0.1"
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op12_language_crf"](spark, folder).collect()
    assert len(got) == len(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in got if r["held_out"]]) > 0.995


# ---- Merkle manifest -----------------------------------------------------------------------------------------------

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def joined(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return joined(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels_of(level):
    out = [level]
    while len(level) > 1:
        level = [joined(*level[i : i + 8]) for i in range(0, len(level), 8)]
        out.append(level)
    return out


def sides(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 8 * 8 : i // 8 * 8 + 8]
        out.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        i //= 8
    return out


def plain_proofs(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_of([leaf for *_, leaf in sorted(groups[g])]) for g in names}
    top = levels_of([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (_, _, leaf) in enumerate(sorted(groups[g])):
            path = sides(trees[g], i) + sides(top, k)
            out.append((leaf, trees[g][-1][0], top[-1][0], joined(*[a + b for a, b in path])))
    return collections.Counter(out)


def proofs(manifest, requests=None):
    path = F.col("path")
    return manifest.prove(requests).select(
        "key", "leaf", "subroot", "root", merkle.proof_digest(path).alias("proof"), merkle.folded(path, F.col("leaf")).alias("folded"), "found",
        merkle.folded(path, F.sha2(F.lit("x"), 256)).alias("forged"))


@pytest.mark.parametrize("case", ["awkward", "many", "one", "two groups of one", "one group", "eight", "nine"])
def test_proofs(spark, tmp_path, case):
    rows = {
        "awkward": [(*r, "en", "s")[:4] for r in awkward()] + [(20, "x", "é", None), (21, "y", "", ""), (22, "z", "-", "s")],
        "many": [(i, prose(i, 3), "en" if i % 3 else "de", "s") for i in range(700)] + [(5, "same", "fr", "s")] * 20,
        "one": [(1, "t", "en", "s")], "two groups of one": [(1, "t", "en", "s"), (1, "t", None, "s")],
        "one group": [(i, "t", "en", "s") for i in range(65)], "eight": [(i, "t", "en", "s") for i in range(8)], "nine": [(i, "t", "en", "s") for i in range(9)],
    }[case]
    docs = frame(spark, rows)
    manifest = merkle.write_manifest(docs, f"{tmp_path}/m", FIELDS, "doc_id", "lang")
    got = proofs(manifest).collect()
    plain = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()]
    assert collections.Counter((r["leaf"], r["subroot"], r["root"], r["proof"]) for r in got) == plain_proofs(plain)
    assert all(r["folded"] == r["root"] and r["found"] == r["leaf"] and r["forged"] != r["root"] for r in got)


def test_some_proofs(spark, tmp_path):
    docs = frame(spark, [(i, prose(i, 3), "en" if i % 3 else "de", "s") for i in range(300)])
    manifest = merkle.write_manifest(docs, f"{tmp_path}/m", FIELDS, "doc_id", "lang")
    some = manifest.leaves().where("key in (0, 7, 299)")
    got = {r["key"]: r for r in proofs(manifest, some).collect()}
    every = {r["key"]: r for r in proofs(manifest).collect()}
    assert got == {k: every[k] for k in (0, 7, 299)}


def test_no_proofs_without_rows(spark, tmp_path):
    manifest = merkle.write_manifest(frame(spark, []), f"{tmp_path}/m", FIELDS, "doc_id", "lang")
    assert manifest.prove().count() == 0 and manifest.root().count() == 0


def test_lower_case_is_ascii(spark):
    row = spark.createDataFrame([("AZÉ aé",), (None,)], "t string").select(merkle.ascii_lower(F.col("t"))).collect()
    assert [r[0] for r in row] == ["azÉ aé", None]
