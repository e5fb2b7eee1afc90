"""The thin queries without a SQL twin, over a whole small table, against brute force."""

import base64
import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_corpus_operators import plain_removed
from test_text_operators import plain_secrets

from examloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    import duckdb

    return duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall()


def digest(raw):
    return hashlib.sha256(raw).hexdigest()


def rows_of(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


def test_op2(spark, texts):
    assert collections.Counter(tuple(r)[:5] for r in rows_of(spark, "op2_suffix_dedup")) == plain_removed(texts)


def test_op4(spark, texts):
    got = {r["doc_id"]: r for r in rows_of(spark, "op4_secret_scans")}
    assert len(got) == len(texts)
    for i, text in texts:
        spans = plain_secrets(text or "")
        listed = [f"{k}:{a}:{b}" for k, a, b in spans]
        count = collections.Counter(k for k, _, _ in spans)
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (count["assign"], count["access"], count["hex"])
        assert r["base_sha256"] == digest(",".join(listed).encode())
        assert [s for s in r["spans"].split(",") if s and not s.startswith("random")] == listed


def test_op5(spark, texts):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    total = collections.Counter()
    for r in rows_of(spark, "op5_token_counts"):
        total[r["doc_id"]] += r["n_tokens"]
    assert dict(total) == {i: len(plain.encode_ordinary(t)) for i, t in texts}


def test_op6(spark, texts):
    got = {r["doc_id"]: r for r in rows_of(spark, "op6_quality_classifier")}
    assert set(got) == {i for i, _ in texts}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_op6_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    seen = [(labels[r["doc_id"]], r["score"], r["predicted"]) for r in QUERIES["op6_quality_classifier"](spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for q, s, _ in seen if q], [s for q, s, _ in seen if not q]
    assert len(bad) > 50
    above = np.mean([np.mean(np.array(good) > b) for b in bad])
    assert above > 0.98
    assert np.mean([p for q, _, p in seen if q]) > 0.98 and np.mean([p for q, _, p in seen if not q]) < 0.1


def test_op9(spark, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: tuple(r)[1:4] for r in rows_of(spark, "op9_bpe")}
    for i, text in texts:
        ids = plain.encode(text, add_special_tokens=False).ids
        assert got[i] == (len(ids), digest(np.array(ids, "<u4").tobytes()), digest(plain.decode(ids, skip_special_tokens=False).encode()))


def test_op10(spark):
    import duckdb

    pages = duckdb.sql(f"select page_id, html from '{FOLDER}/pages.parquet'").fetchall()
    first = {}
    for i, html in pages:
        first[html] = min(first.get(html, i), i)
    want = {i: (len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if first[h] == i else "revisit", None if first[h] == i else first[h]) for i, h in pages}
    assert {r["page_id"]: tuple(r)[1:5] for r in rows_of(spark, "op10_warc")} == want
