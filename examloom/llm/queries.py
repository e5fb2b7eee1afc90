"""Queries opN_<name>: the corpus operators over their whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from examloom.functions.storage import scratch_folder
from examloom.llm import (
    bpe, decontaminate, jaccard_join, language_crf, merkle, prefix_trie, quality_classifier, quality_rules, secrets, suffix_dedup, token_counts, twins, url_filter, warc)
from examloom.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query("op1_decontaminate", twins.DECONTAMINATE)
def op1(spark, folder):
    """Benchmark items in every document."""
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op2_suffix_dedup")
def op2(spark, folder):
    """Bytes that smaller documents hold too, for every document."""
    found = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_url_filter")
def op3(spark, folder):
    """Every page URL against four rules and the template tree; labels come from the document that a path names."""
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").alias("key"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filter.judge_urls(table(spark, folder, "pages"), URL_RULES, labels)


@query("op4_secret_scans")
def op4(spark, folder):
    """Secrets in every document."""
    found = secrets.scan(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"))


@query("op5_token_counts")
def op5(spark, folder):
    """Tokens of every section of every document; a token on a boundary goes where most of it lies."""
    ranks = token_counts.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return token_counts.section_tokens(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


@query("op6_quality_classifier")
def op6(spark, folder):
    """Quality score of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    # only the score depends on the text; it is dropped after the tasks have read it
    out = quality_classifier.scored(docs, table(spark, folder, "labels"))
    return out.select(
        "doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


@query("op7_jaccard_join", twins.JACCARD)
def op7(spark, folder):
    """Class and number of links of every document at a similarity of 0.8 or more."""
    return jaccard_join.similar(table(spark, folder, "documents"))


@query("op8_quality_rules", twins.QUALITY_RULES)
def op8(spark, folder):
    """Counts, base rule and adaptive verdict for every document."""
    return quality_rules.quality_filter(table(spark, folder, "documents"))


@query("op9_bpe")
def op9(spark, folder):
    """Ids of every document, and the text that they decode to."""
    vocabulary = bpe.read_vocabulary(VOCABULARY)
    found = bpe.round_trip(table(spark, folder, "documents").select("doc_id", "text"), vocabulary)
    return found.select(
        "doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query("op10_warc")
def op10(spark, folder):
    """Every page into an archive and back."""
    place = scratch_folder(spark, "warc")
    warc.write_archive(table(spark, folder, "pages"), place)
    return warc.record_fields(warc.read_archive(spark, place))


@query("op11_prefix_trie", twins.PREFIX_TRIE)
def op11(spark, folder):
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, folder, "conversations")))


@query("op12_language_crf")
def op12(spark, folder):
    """Language of every document, learnt from three quarters of them."""
    docs = table(spark, folder, "documents")
    found = language_crf.tagged(docs.select("doc_id", "text"), language_crf.fit(docs))
    return found.select("doc_id", language_crf.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op13_merkle", twins.MERKLE)
def op13(spark, folder):
    """Proof of every document, folded again from a leaf that may have been tampered with."""
    docs = table(spark, folder, "documents")
    fields = ["doc_id", "source", "lang", "n_chars"]
    lowered = merkle.row_digest(*[F.col(c) for c in fields], merkle.ascii_lower(F.col("text")))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lowered)
    manifest = merkle.write_manifest(docs, scratch_folder(spark, "manifest"), [*fields, "text"], "doc_id", "lang", {"tampered": tampered})
    folded = merkle.folded(F.col("path"), F.coalesce("tampered", "leaf"))
    return manifest.prove().select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))
