"""Operators across documents, against brute force: decontamination, suffix dedup, classifier, Jaccard join, pipeline."""

import collections
import hashlib
import random

import corpus_cases as cases
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from examloom.llm import bytes as byte_tools
from examloom.llm import components, decontaminate, jaccard_join, quality_classifier, suffix_dedup

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return cases.frame(spark, cases.awkward()).cache()


def edited(text, seed, n):
    """The text with n words replaced."""
    r, w = random.Random(seed), text.split()
    for k in r.sample(range(len(w)), n):
        w[k] = f"new{seed}{k}"
    return " ".join(w)


def family(seed, size, words=200, edits=3):
    base = cases.prose(seed, words)
    return [edited(base, seed * 1000 + k, k % (edits + 1)) for k in range(size)]


# Bytes


def test_words_and_shingles_of_bytes():
    texts = [t or "" for _, t, *_ in cases.awkward()]
    column = pa.array([None if t == "" else t for t in texts])[1:]
    for limit in (1, 1000, 1 << 20):
        seen = []
        for first, end, data, starts in byte_tools.pieces(column, limit):
            s, e = byte_tools.word_spans(data, starts)
            row = np.searchsorted(starts, s, "right") - 1
            got = collections.defaultdict(list)
            for k, a, b in zip(row, s, e):
                got[first + k].append(bytes(data[a:b]))
            for k in range(first, end):
                assert got[k] == texts[k + 1].encode().split()
            seen += range(first, end)
            hashes, rows = byte_tools.shingle_hashes(data, starts)
            for k in range(first, end):
                w = texts[k + 1].encode().split()
                n = len({tuple(w[j : j + 5]) for j in range(len(w) - 4)}) if len(w) >= 5 else bool(w)
                assert len(set(hashes[rows == k - first].tolist())) == n
        assert seen == list(range(len(column)))


def test_equal_words_have_equal_hashes_everywhere():
    a, b = b"ab cde ab", b"x ab\ncde"
    h1, _ = byte_tools.word_hashes(np.frombuffer(a, np.uint8), np.array([0, len(a)]))
    h2, _ = byte_tools.word_hashes(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
    assert h1[0] == h1[2] == h2[1] and h1[1] == h2[2] and len({*h1.tolist(), *h2.tolist()}) == 3


# Decontamination


def plain_matches(rows, bench):
    shingles = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)]
    lower = lambda t: (t or "").lower().encode().split()
    out = set()
    for i, text in rows:
        w = lower(text)
        for item, t in bench:
            own = lower(t)
            for s in range(len(w)) if own else ():
                if w[s] not in own and len(own) > 6:
                    continue
                a, b = collections.Counter(shingles(w[s : s + len(own)])), collections.Counter(shingles(own))
                if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                    out.add((i, item))
                    break
    return out


def test_decontamination(spark):
    bench = [(1, cases.prose(300, 40)), (2, cases.prose(301, 25)), (3, "Two Words"), (4, cases.prose(302, 90)), (5, None), (6, ""), (7, "the same " * 12), (None, cases.prose(303, 30)), (1, cases.prose(300, 40))]
    filler = lambda k: cases.prose(400 + k, 60)
    rows = [(1, filler(1) + " " + bench[0][1].upper() + " " + filler(2)), (2, edited(bench[0][1], 1, 1)), (3, edited(bench[3][1], 2, 2) + filler(3)), (4, filler(4)), (5, filler(5) + " two  words " + filler(6)),
            (6, bench[1][1]), (None, filler(7) + " " + bench[7][1]), (7, bench[3][1][: len(bench[3][1]) // 2]), (8, "the same " * 50), (9, bench[1][1] + " " + bench[1][1]), (9, bench[1][1] + " " + bench[1][1]), (10, edited(bench[3][1], 3, 20))]
    frame = cases.frame(spark, rows)
    items = spark.createDataFrame([(*b, "w", 3, "h") for b in bench], "item_id long, text string, w string, n int, hash string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(frame, items).collect()}
    assert set(got) == plain_matches(rows, bench)
    assert got[1, 1]["start_word"] == 60 and got[1, 1]["similarity"] == 1.0
    dirty = {i for i, _ in got}
    kept = decontaminate.clean(frame, items)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in rows if i is not None and i not in dirty)
    assert decontaminate.contaminated(frame, items.limit(0)).count() == 0 and decontaminate.contaminated(frame.limit(0), items).count() == 0


def test_decontamination_of_awkward_documents(spark, docs):
    items = spark.createDataFrame([(1, "one two"), (2, cases.prose(3, 80)), (3, "漢字 é ñ 漢字 é ñ 漢字")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(7, 1), (8, 1), (None, 2), (11, 3)}


def test_items_that_share_an_id_are_compared_one_by_one(spark):
    """Texts of one id, or of no id, that differ in case, in white space or in words only."""
    a, b, c = cases.prose(310, 40), cases.prose(311, 40), cases.prose(312, 40)
    bench = [(1, a), (1, a.upper()), (1, a.replace(" ", "\n ")), (1, b), (None, c), (None, cases.prose(313, 40)), (2, "two words"), (2, "Two other")]
    docs = [(1, cases.prose(314, 30) + " " + a), (2, b), (3, c + " " + cases.prose(315, 30)), (4, edited(a, 6, 1)), (5, "my two other words"), (6, cases.prose(316, 50))]
    found = decontaminate.contaminated(cases.frame(spark, docs), spark.createDataFrame(bench, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in found}
    assert len(got) == len(found) and set(got) == plain_matches(docs, bench) >= {(1, 1), (2, 1), (3, None), (5, 2)}
    assert all(got[k] == 1.0 for k in ((1, 1), (2, 1), (3, None), (5, 2)))


def test_fingerprints_of_similar_windows_lie_within_the_radius(spark):
    """Windows at the threshold: share of pairs beyond the radius, over many sizes and edits."""
    r, pairs = random.Random(5), []
    for k in range(600):
        w = cases.prose(2000 + k, r.randint(15, 80)).split()
        v = w[:]
        v[r.choice([0, -1]) if len(w) < 50 else r.randrange(len(w))] = "changed"
        pairs.append((" ".join(w), " ".join(v)))
    print_ = lambda c: decontaminate.fingerprint(decontaminate.words(c))
    frame = spark.createDataFrame(pairs, "a string, b string")
    from pyspark.sql import functions as F

    far = frame.where(F.bit_count(print_(F.col("a")).bitwiseXOR(print_(F.col("b")))) > decontaminate.RADIUS).count()
    assert far == 0


def test_hamming_blocks_find_every_pair_within_the_radius(spark):
    from pyspark.sql import functions as F

    r = random.Random(1)
    rows = []
    for k in range(300):
        a, flips = r.getrandbits(64), r.sample(range(64), k % (decontaminate.RADIUS + 1))
        b = a
        for f in flips:
            b ^= 1 << f
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    frame = spark.createDataFrame(rows, "a long, b long")
    blocks = frame.select(decontaminate.hamming_blocks(F.col("a")).alias("x"), decontaminate.hamming_blocks(F.col("b")).alias("y"))
    assert blocks.where(F.arrays_overlap("x", "y")).count() == len(rows)


# Suffix dedup


def plain_removed(rows):
    order = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            first[s] = min(first.get(s, order(i)), order(i))
    out = collections.Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < order(i):
                gone[k : k + 50] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def suffix_rows():
    passage = cases.prose(500, 30)
    rows = [(i, t) for i, t, *_ in cases.awkward() if i not in (9, 10)]
    rows += [(50 + k, cases.prose(510 + k, 40) + "\n" + passage[k : len(passage) - k] + " " + cases.prose(530 + k, 20)) for k in range(12)]
    rows += [(80, "ab" * 120), (81, "ab" * 60 + "c"), (82, "x" * 49), (83, "x" * 50), (84, "é" * 60), (85, passage * 3), (40, passage[:49]), (41, passage[:50])]
    return rows


@pytest.mark.parametrize("chunk, frequent", [(2 << 20, 2000), (700, 2000), (700, 1), (1, 0)])
def test_suffix_dedup(spark, monkeypatch, chunk, frequent):
    """Whatever the size of chunks, and whether anchors count as frequent or not."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rows = suffix_rows()
    original = suffix_dedup._shared_anchors

    def patched(work, limit=frequent):
        suffix_dedup.FREQUENT = limit
        return original(work)

    monkeypatch.setattr(suffix_dedup, "_shared_anchors", patched)
    prepared = suffix_dedup._chunk_rows

    def small(batches, size=chunk):
        suffix_dedup.CHUNK = size
        return prepared(batches)

    monkeypatch.setattr(suffix_dedup, "_chunk_rows", small)
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffix_dedup.remove_repeats(cases.frame(spark, rows)).collect())
    assert got == plain_removed(rows)


def test_suffix_dedup_of_nothing(spark, docs):
    assert not suffix_dedup.remove_repeats(docs.limit(0)).collect()
    assert suffix_dedup.remove_repeats(docs).count() == docs.count()


def test_interval_tree():
    text = b"mississippi$"
    order = sorted(range(len(text)), key=lambda k: text[k:])
    common = [0]
    for a, b in zip(order, order[1:]):
        n = 0
        while text[a + n : a + n + 1] == text[b + n : b + n + 1] and a + n < len(text) and b + n < len(text):
            n += 1
        common.append(n)
    low, high, length = suffix_dedup.interval_tree(np.array(common), 1)
    got = {(text[order[a] : order[a] + n], tuple(sorted(order[a:b]))) for a, b, n in zip(low, high, length)}
    assert got == {(b"i", (1, 4, 7, 10)), (b"issi", (1, 4)), (b"p", (8, 9)), (b"s", (2, 3, 5, 6)), (b"si", (3, 6)), (b"ssi", (2, 5))}


def test_repeat_groups_hold_every_occurrence(spark):
    passage = cases.prose(600, 30)[:60]
    rows = [(1, "a" + passage + "b" + cases.prose(601, 30)), (2, "c" + passage + "d"), (3, cases.prose(602, 20) + passage), (4, cases.prose(603, 60)), (2, "e" + passage)]
    got = collections.defaultdict(set)
    for r in suffix_dedup.repeat_groups(cases.frame(spark, rows)).collect():
        got[r["repeat"]].add((r["n_bytes"], r["doc_id"], r["start"]))
    assert got and {d for places in got.values() for _, d, _ in places} == {1, 2, 3}
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append(t.encode())
    for name, places in got.items():
        for n, d, s in places:
            assert any(hashlib.sha256(t[s : s + n]).hexdigest() == name for t in texts[d])
        n = next(iter(places))[0]
        one = next(t[s : s + n] for _, d, s in places for t in texts[d] if hashlib.sha256(t[s : s + n]).hexdigest() == name)
        every = {(n, d, k) for d, ts in texts.items() for t in ts for k in range(len(t)) if t.startswith(one, k)}
        assert places == every


def plain_repeats(rows):
    """(digest, length, document, start) of every occurrence of every maximal repeat, from sorted whole suffixes."""
    texts = [(i, t.encode()) for i, t in rows]
    suffixes = sorted((t[k:], t[k - 1] if k else -1, i, k) for i, t in texts for k in range(len(t) - 49))
    common = [0]
    for (a, *_), (b, *_) in zip(suffixes, suffixes[1:]):
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        common.append(n if n >= 50 else 0)
    out = collections.Counter()
    for a, b, n in zip(*suffix_dedup.interval_tree(np.array(common), 50)):
        own = suffixes[a:b]
        if (len({x[1] for x in own}) > 1 or own[0][1] < 0) and len({x[2] for x in own}) > 1:
            out.update((hashlib.sha256(own[0][0][:n]).hexdigest(), int(n), i, k) for _, _, i, k in own)
    return out


@pytest.mark.parametrize("chunk, frequent", [(2 << 20, 2000), (700, 2000), (700, 1), (1, 0)])
def test_repeat_groups_are_whole(spark, monkeypatch, chunk, frequent):
    """Repeats longer than a tile come whole, whatever the size of chunks and whether anchors count as frequent or not."""
    chunks, shared = suffix_dedup._chunk_rows, suffix_dedup._shared_anchors

    def small(batches):
        suffix_dedup.CHUNK = chunk
        return chunks(batches)

    def patched(work):
        suffix_dedup.FREQUENT = frequent
        return shared(work)

    monkeypatch.setattr(suffix_dedup, "_chunk_rows", small)
    monkeypatch.setattr(suffix_dedup, "_shared_anchors", patched)
    short, long = cases.prose(610, 60)[:200], cases.prose(611, 500)[:2000]
    assert (len(short), len(long)) == (200, 2000)
    rows = [(1, "a" + short + "b" + cases.prose(612, 30)), (2, "c" + short + "d" + long), (3, cases.prose(613, 20) + "\n" + long + "e"), (4, "f" + long[500:1700] + "g" + short[:120]),
            (5, long), (6, short + short), (7, cases.prose(614, 60)), (8, "ab" * 60), (9, "ab" * 50 + "c"), (5, "h" + long[:90])]
    got = collections.Counter(map(tuple, suffix_dedup.repeat_groups(cases.frame(spark, rows)).collect()))
    assert got == plain_repeats(rows)
    assert {200, 1200, 2000} <= {n for _, n, _, _ in got}


# Classifier


def junk(seed):
    return " ".join(w.upper() + "!!" for w in cases.prose(seed, 60).split())


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(k, cases.prose(700 + k, 80) if k % 3 else junk(700 + k)) for k in range(300)] + [(1000, None), (1001, ""), (None, cases.prose(5, 50)), (7, cases.prose(707, 80))]
    frame = cases.frame(spark, rows)
    labels = spark.createDataFrame([(k, int(k % 3 > 0), "t") for k in range(250)] + [(7, 1, "t"), (None, 1, "t"), (3, None, "t")], "doc_id long, quality int, text string")
    return rows, frame, labels, quality_classifier.scored(frame, labels).cache()


def test_classifier_on_held_out_documents(scored):
    rows, frame, _, out = scored
    assert out.columns == [c for c in frame.columns if c != "quality_score"] + ["quality_score"] and out.count() == len(rows)
    got = out.withColumn("held", quality_classifier.held_out(out["doc_id"])).collect()
    import zlib

    for r in got:
        assert 0 <= r["quality_score"] <= 1
        assert r["held"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    tested = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 300 and (r["held"] or r["doc_id"] >= 250)]
    assert len(tested) > 40
    right = sum((r["quality_score"] >= 0.3) == (r["doc_id"] % 3 > 0) for r in tested)
    assert right / len(tested) > 0.95


def test_scores_do_not_use_held_out_labels_and_repeat(spark, scored):
    _, frame, labels, out = scored
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_classifier.scored(frame.repartition(5), turned)
    key = lambda f: sorted((str(r["doc_id"]), r["text"] or "", round(r["quality_score"], 9)) for r in f.collect())
    assert key(again) == key(out)


def test_classifier_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["quality_score"] for r in quality_classifier.scored(docs, none).collect()} == {0.5}
    assert quality_classifier.scored(docs.limit(0), none).count() == 0


# Jaccard join


def test_rows_that_repeat_a_labelled_id_count_once(spark):
    rows = [(1, cases.prose(k, 30)) for k in range(300)] + [(k, cases.prose(k, 30)) for k in range(2, 30)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 30)], "doc_id long, quality int")
    seen = []
    keep = quality_classifier.Network
    try:
        quality_classifier.Network = lambda x, y: seen.append((x.copy(), y.copy()))
        source = cases.frame(spark, rows)
        vectors = quality_classifier.word_vectors(source)
        quality_classifier.fit(source, labels, vectors)
        quality_classifier.fit(source.repartition(7), labels, vectors)
    finally:
        quality_classifier.Network = keep
    usable = labels.where(~quality_classifier.held_out(F.col("doc_id"))).count()
    assert [len(y) for _, y in seen] == [usable, usable] and (seen[0][0] == seen[1][0]).all()


def plain_links(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    n = len(rows)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links, texts = [0] * n, [set() for _ in range(n)]
    for a in range(n):
        for b in range(n):
            if a == b:
                continue
            same = (rows[a][1] or "") == (rows[b][1] or "")
            both = len(sets[a] & sets[b])
            if same or both and both >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
                if not same:
                    texts[a].add(rows[b][1])
    least = {}
    for k in range(n):
        i = rows[k][0]
        least.setdefault(find(k), []).append(float("inf") if i is None else i)
    classes = [min(least[find(k)]) for k in range(n)]
    return collections.Counter((rows[k][0], None if classes[k] == float("inf") else classes[k], links[k], len(texts[k])) for k in range(n))


def jaccard_rows():
    rows = [(i, t) for i, t, *_ in cases.awkward() if i != 9]
    rows += [(200 + k, t) for k, t in enumerate(family(800, 30))] + [(300 + k, t) for k, t in enumerate(family(801, 12, 60, 1))]
    rows += [(400 + k, t) for k, t in enumerate(family(802, 12, 150, 9))] + [(500, "a b c d e"), (501, "a b c d e f"), (502, "a  b c\nd e")]
    return rows


@pytest.mark.parametrize("block", [256, 4])
def test_jaccard_join(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = jaccard_rows()
    assert collections.Counter(map(tuple, jaccard_join.similar(cases.frame(spark, rows)).collect())) == plain_links(rows)


def test_keep_one(spark):
    rows = jaccard_rows()
    frame = cases.frame(spark, rows)
    kept = jaccard_join.keep_one(frame)
    assert kept.columns == frame.columns
    classes = {c for _, c, _, _ in plain_links(rows)}
    got = [r["doc_id"] for r in kept.collect()]
    assert collections.Counter(got) == collections.Counter(c for c in classes) + collections.Counter({13: 1} if got.count(13) == 2 else {})
    assert jaccard_join.keep_one(frame.limit(0)).count() == 0 and jaccard_join.similar(frame.limit(0)).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    least = jaccard_join.least_agreements(0.8, 1e-6)
    r = np.random.default_rng(2)
    lost = 0
    for _ in range(20_000):
        agree = np.cumsum(r.random(jaccard_join.SIGNATURE) < 0.8)
        lost += any(agree[n - 1] < m for n, m in least.items())
    assert lost == 0
    unlike = sum(all(np.cumsum(r.random(jaccard_join.SIGNATURE) < 0.4)[n - 1] >= m for n, m in least.items()) for _ in range(200))
    assert unlike == 0


def test_components(spark):
    r = random.Random(4)
    pairs = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(200 + r.randrange(30), 200 + r.randrange(30)) for _ in range(25)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in components.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: find(x) for x in linked}


# Pipeline


def test_pipeline_stages_keep_columns_and_take_anything(spark, docs, tmp_path):
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, docs, str(tmp_path)).count() == docs.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_pipeline_against_brute_force(spark):
    import duckdb
    from tokenizers import Tokenizer

    from test_text_operators import plain_secrets

    source = spark.read.parquet(f"{TABLES}/documents.parquet")
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    bench = duckdb.sql(f"select item_id, text from '{TABLES}/benchmark.parquet'").fetchall()
    passed = [(r["doc_id"], r["text"]) for r in quality_classifier.scored(source, labels).collect() if r["quality_score"] >= 0.3]
    kept = {c for _, c, _, _ in plain_links(passed)}
    kept = [(i, t) for i, t in passed if i in kept]
    dirty = {i for i, _ in plain_matches(kept, bench)}
    plain = Tokenizer.from_file(corpus_pipeline.VOCABULARY)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, TABLES).collect()}
    assert set(got) == {i for i, _ in kept} - dirty
    for i, t in kept:
        if i in got and not plain_secrets(t):
            ids = plain.encode(t, add_special_tokens=False).ids
            assert bytes(got[i]["ids"]) == np.array(ids, "<u4").tobytes() and got[i]["n_tokens"] == len(ids)
