"""Quality rules with thresholds taken from the corpus, per language and source.

Main path in DataFrame functions only.

Edge cases: a null text has no words.  Null languages or sources form groups of their own.  Texts of any
length are read whole.  Repeated rows and repeated ids are judged row by row; null ids are kept.  An empty
table gives an empty result.  A document alone in its group is its own median and stays.  Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examloom.functions.storage import checkpointed
from examloom.functions.text import let

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Shares of a document that the adaptive thresholds look at.
METRICS = ("symbol_share", "line_share", "repeat_share", "word_length")


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _windows(tokens: Column) -> Column:
    """A hash for every window of five words."""
    shifted = [F.slice(tokens, k + 1, F.greatest(F.size(tokens) - (WINDOW - 1), F.lit(0))) for k in range(WINDOW)]
    return F.transform(F.arrays_zip(*shifted), lambda z: F.xxhash64(*[z[str(k)] for k in range(WINDOW)]))


def _covered(hashes: Column) -> Column:
    """Words in windows that occur twice or more."""

    def places(pairs):
        n = F.size(pairs)
        same = lambda i: (i >= 0) & (i < n) & (F.get(pairs, i)["h"] == F.get(pairs, i + 1)["h"])
        flagged = F.filter(pairs, lambda p, i: F.coalesce(same(i), F.lit(False)) | F.coalesce((i > 0) & same(i - 1), F.lit(False)))
        return F.array_sort(F.transform(flagged, lambda p: p["i"]))

    def total(found):
        return F.aggregate(
            F.transform(found, lambda p, k: F.least(F.coalesce(F.get(found, k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))),
            F.lit(0).cast("bigint"), lambda a, x: a + x)

    def repeats(h):
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(let(pairs, places), total)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(repeats(h)))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every document; row-local, without a shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    rows = docs.select("doc_id", "lang", "source", let(words(F.col("text")), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"), _covered(_windows(w)).alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(text, SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"))).alias("x"))
    return rows.select(
        "doc_id", "lang", "source", "w.n_words", "word_chars", "n_symbols", F.col("x.dup").alias("n_dup_lines"), "w.n_repeat_words",
        F.col("x.n").alias("n_lines"))


def _metrics() -> dict[str, Column]:
    return {
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
        "word_length": F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
    }


def quantile_sketch(values: DataFrame, keys: list[str], growth: float = 1.02) -> DataFrame:
    """Counts per logarithmic bin of ``value``, for every key: a sketch that merges by adding counts.

    Bin b > 0 holds (growth^(b-1), growth^b] / 1e6, bin 0 the values up to 1e-6, so a quantile read from it is
    off by at most ``growth`` - 1 of its value.  Bins are few whatever the number of rows.
    """
    bin_of = F.greatest(F.ceil(F.log(F.greatest(F.col("value") * 1e6, F.lit(1.0))) / F.log(F.lit(growth))), F.lit(0)).cast("int")
    return values.groupBy(*keys, bin_of.alias("bin")).agg(F.count("*").alias("n"))


def sketch_quantiles(sketch: DataFrame, keys: list[str], shares: dict[str, float], growth: float = 1.02) -> DataFrame:
    """The named quantiles of every key of a sketch; a key has at most some thousand bins."""
    packed = sketch.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("n"))

    def quantile(share):
        step = F.aggregate(
            "bins", F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("at")),
            lambda a, x: F.struct(
                (a["seen"] + x["n"]).alias("seen"),
                F.coalesce(a["at"], F.when(a["seen"] + x["n"] >= F.col("n") * share, x["bin"])).alias("at")))["at"]
        return F.when(step > 0, F.pow(F.lit(growth), step) / 1e6).otherwise(0.0)

    return packed.select(*keys, "n", *[quantile(s).alias(name) for name, s in shares.items()])


#: Spreads above the median of its group that a document may lie; standard errors by which its own counts must
#: place it there; and the weight, in documents, of the wider corpus in the spread of a group.
SPREADS, ERRORS, PRIOR = 3.0, 2.0, 10.0


def certain_share(part: Column, whole: Column) -> Column:
    """The least share that ``part`` of ``whole`` supports (Wilson's lower bound); few events support little."""
    n, z = F.greatest(whole, F.lit(1.0)), F.lit(ERRORS)
    p = part / n
    root = F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(part > 0, (p + z * z / (2 * n) - z * root) / (1 + z * z / n)).otherwise(0.0)


def _certain() -> dict[str, Column]:
    """What of each metric is sure; words of repeated windows come five at a time."""
    return {
        "symbol_share": certain_share(F.col("n_symbols"), F.col("word_chars")),
        "line_share": certain_share(F.col("n_dup_lines"), F.col("n_lines")),
        "repeat_share": certain_share(F.col("n_repeat_words") / WINDOW, F.col("n_words") / WINDOW),
        "word_length": F.col("word_length"),
    }


def _spread() -> Column:
    return F.sqrt(F.greatest(F.col("s2") / F.col("n") - F.pow(F.col("s1") / F.col("n"), F.lit(2.0)), F.lit(0.0)))


def _towards(own: Column, wider: Column) -> Column:
    return (F.col("n") * own + PRIOR * wider) / (F.col("n") + PRIOR)


def adaptive_thresholds(rows: DataFrame, growth: float = 1.02) -> DataFrame:
    """The highest allowed value of each metric per (lang, source): median + SPREADS * spread.

    Medians and standard deviations are read from the sketches.  The spread of a group is drawn towards that of
    its language, and that one towards the corpus, the more the fewer documents it has.
    """
    values = rows.where("not base_failed").select(
        "lang", "source", F.explode(F.map_from_arrays(F.array(*map(F.lit, METRICS)), F.array(*METRICS))).alias("metric", "value"))
    keys = ["lang", "source", "metric"]
    sketch = quantile_sketch(values, keys, growth)
    medians = sketch_quantiles(sketch, keys, {"q50": 0.5}, growth).drop("n")
    x = F.when(F.col("bin") > 0, F.pow(F.lit(growth), F.col("bin")) / 1e6).otherwise(0.0)
    sums = lambda df, by: df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2")])
    groups = sums(sketch.select(*keys, "n", (F.col("n") * x).alias("s1"), (F.col("n") * x * x).alias("s2")), keys)
    langs = sums(groups, ["lang", "metric"])
    corpus = sums(langs, ["metric"]).select("metric", _spread().alias("corpus_spread"))
    langs = langs.join(corpus, "metric").select(
        F.col("lang").alias("l_lang"), F.col("metric").alias("l_metric"), _towards(_spread(), F.col("corpus_spread")).alias("lang_spread"))
    q = medians.withColumnsRenamed({"lang": "q_lang", "source": "q_source", "metric": "q_metric"})
    limits = groups.join(langs, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("metric") == F.col("l_metric"))).join(
        q, F.col("lang").eqNullSafe(F.col("q_lang")) & F.col("source").eqNullSafe(F.col("q_source")) & (F.col("metric") == F.col("q_metric")))
    limit = F.col("q50") + SPREADS * _towards(_spread(), F.col("lang_spread"))
    return limits.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, limit)).alias(f"max_{m}") for m in METRICS])


def quality_filter(docs: DataFrame) -> DataFrame:
    """Counts, base rule and verdict of every document.

    ``base_failed`` has less than ten words, or more than a fifth of the words in repeated windows.  The others
    are kept unless what is certain of a metric exceeds the threshold of their language and source.  Counts are stored once;
    thresholds come from sketches that merge in the map tasks, so a source with most of the rows is no hot key,
    and the join carries numbers only.
    """
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = measured(docs)
    rows = checkpointed(rows.withColumn("base_failed", base).withColumns(_metrics()))
    limits = adaptive_thresholds(rows).withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    near = F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))
    beyond = F.lit(False)
    for m, sure in _certain().items():
        beyond = beyond | F.coalesce(sure > F.col(f"max_{m}"), F.lit(False))
    return rows.join(limits, near, "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~beyond).alias("kept"))
