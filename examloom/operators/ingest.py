"""Getting parsed questions into the bank: duplicates, subjects, grades, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examloom.functions.ranking import top_n
from examloom.functions.storage import stored
from examloom.functions.text import let, question_key, strip
from examloom.functions.urls import file_name, host

DEFAULTS = {
    "subject": "general",
    "grade": "",
    "answer": "",
    "source": "",
    "difficulty": "medium",
    "question_type": "mcq",
}


DIGEST = "content_digest"


def _digest(col: Column) -> Column:
    return F.unhex(F.sha2(col, 256))


def content_digests(bank: DataFrame) -> DataFrame:
    """Digest of the trimmed content of each row, as kept or worked out."""
    held = F.col(DIGEST) if DIGEST in bank.columns else _digest(strip(F.col("content")))
    return bank.select(held.alias(DIGEST))


def with_defaults(accepted: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Missing columns and missing values take their defaults."""
    for column, value in (DEFAULTS | (defaults or {})).items():
        if column not in accepted.columns:
            accepted = accepted.withColumn(column, F.lit(value))
        elif column == "subject":
            # An empty subject counts as missing too.
            accepted = accepted.withColumn(
                column, F.coalesce(F.when(F.col(column) != "", F.col(column)), F.lit(value))
            )
        else:
            accepted = accepted.withColumn(column, F.coalesce(F.col(column), F.lit(value)))
    return accepted


def ingest_dedup(batch: DataFrame, bank: DataFrame, defaults: dict | None = None, keep_digest: bool = False):
    """New rows of a batch, and how many rows were saved and skipped.

    A row is skipped when its trimmed content is in the bank already or came
    earlier in the batch (``seq`` gives the order).  Contents travel as
    digests.  Copies are reduced to their first ``seq`` before the shuffle, and the
    bank to distinct digests, so a content repeated millions of times costs one
    row per task.  A bank that keeps the column ``content_digest``
    (``keep_digest``) is not read for its contents at all.
    """
    rows = batch.withColumn("content", strip(F.col("content"))).filter(F.col("content") != "")
    keyed = rows.select(_digest(F.col("content")).alias("_digest"), "seq")
    firsts = keyed.groupBy("_digest").agg(F.min("seq").alias("seq"))
    known = content_digests(bank).select(F.col(DIGEST).alias("_digest")).distinct()
    fresh = firsts.join(known, "_digest", "left_anti").select("seq", "_digest")
    # a repeated seq brings neither another content in nor the same one twice
    accepted = rows.withColumn("_digest", _digest(F.col("content"))).join(fresh, ["seq", "_digest"], "left_semi")
    accepted = accepted.dropDuplicates(["seq", "_digest"])
    accepted = accepted.withColumnRenamed("_digest", DIGEST) if keep_digest else accepted.drop("_digest")
    accepted = with_defaults(accepted, defaults)
    flags = rows.select(F.lit(1).alias("row"), F.lit(0).alias("new")).unionByName(
        fresh.select(F.lit(0).alias("row"), F.lit(1).alias("new"))
    )
    totals = flags.agg(
        F.coalesce(F.sum("new"), F.lit(0)).alias("saved"),
        F.coalesce(F.sum("row") - F.sum("new"), F.lit(0)).alias("skipped"),
    )
    return accepted, totals


def history_append(history: DataFrame, rows: DataFrame, key: str = "timestamp", order: str = "seq") -> DataFrame:
    """Insert rows whose key is not there yet; the first of equal keys wins."""
    columns = [c for c in history.columns]
    first = (
        rows.groupBy(key)
        .agg(F.min_by(F.struct(*columns), order).alias("_row"))
        .select("_row.*")
    )
    return history.unionByName(first.join(history.select(key), key, "left_anti").select(*columns))


def history_list(history: DataFrame, history_type: str | None = None, limit: int = 100) -> DataFrame:
    """Newest entries first."""
    rows = history if history_type is None else history.filter(F.col("history_type") == history_type)
    return rows.orderBy(F.col("timestamp").desc()).limit(limit)


def history_delete(history: DataFrame, key_value: str, key: str = "timestamp") -> DataFrame:
    return history.filter(~F.coalesce(F.col(key) == key_value, F.lit(False)))


# Slugs met in page addresses and the subjects they mean.
SUBJECT_SLUGS = {
    "toan": "math",
    "ngu-van": "literature",
    "van": "literature",
    "vat-ly": "physics",
    "vat-li": "physics",
    "hoa-hoc": "chemistry",
    "hoa": "chemistry",
    "sinh-hoc": "biology",
    "sinh": "biology",
    "tieng-anh": "english",
    "lich-su": "history",
    "dia-li": "geography",
    "dia": "geography",
    "gdcd": "civic_education",
    "cong-nghe": "technology",
    "tin-hoc": "informatics",
}


def _first_hit(text: Column, pairs: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for slug, value in reversed(pairs):
        out = F.when(text.contains(slug), value).otherwise(out)
    return out


def subject_by_slug(
    pages: DataFrame, slugs: dict[str, str] | DataFrame | None = None, mode: str = "longest",
    title: str | None = None, use_url: bool = True,
) -> DataFrame:
    """Tag rows with the subject whose slug their address or title holds.

    "longest": the longest slug wins, looked up in the file name, then the
    title, then the whole address, else ``general``.  "first": the first slug of
    the map found in address and title together, else empty.  A map becomes a
    chain of conditions inside the scan; a table of slugs (slug, subject and, for
    "first", rank) of any size is joined, see :func:`slug_matches`.
    """
    heading = F.lower(F.coalesce(F.col(title), F.lit(""))) if title else F.lit("")
    fields = [F.concat(F.lower("url"), F.lit(" "), heading)] if mode == "first" else [
        file_name(F.col("url")), heading, *([F.lower("url")] if use_url else [])]
    missing = "" if mode == "first" else "general"
    if isinstance(slugs, DataFrame):
        return _subject_from_table(pages, slugs, mode, title, fields, missing)
    pairs = list((slugs or SUBJECT_SLUGS).items())
    if mode != "first":
        pairs = sorted(pairs, key=lambda p: len(p[0]), reverse=True)
    return pages.withColumn("subject", F.coalesce(*[_first_hit(f, pairs) for f in fields], F.lit(missing)))


def _subject_from_table(pages: DataFrame, slugs: DataFrame, mode: str, title: str | None, fields: list[Column], missing: str) -> DataFrame:
    """Equal addresses with equal titles are looked up once."""
    names = ["url", *([title] if title else [])]
    asked = pages.select(*names).distinct().select(
        *names, F.explode(F.array(*[F.struct(F.lit(i).alias("place"), f.alias("text")) for i, f in enumerate(fields)])).alias("f"))
    asked = asked.select(*names, "f.place", "f.text").where("text <> ''")
    best = slug_matches(asked.select("text").distinct(), slugs, mode)
    told = asked.join(best, "text").groupBy(*names).agg(F.min_by("subject", "place").alias("_subject"))
    told = told.select(*[F.col(n).alias(f"_by_{n}") for n in names], "_subject")
    same = [F.col(n).eqNullSafe(F.col(f"_by_{n}")) for n in names]
    found = pages.drop("subject").join(told, same, "left")
    return found.withColumn("subject", F.coalesce("_subject", F.lit(missing))).drop("_subject", *[f"_by_{n}" for n in names])


#: Lengths of the stretches that texts and slugs meet by, the longest that fits; a shorter slug is met as a whole.
SLUG_STRETCHES = (8, 4)


def _stretches(text: Column, n: int) -> Column:
    """Hashes of the distinct stretches of ``n`` characters; none in a shorter text."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.substring(text, i, F.lit(n))))))


def _filed(table: DataFrame, n: int, below: int | None) -> DataFrame:
    """Slugs of ``n`` characters and more, but fewer than ``below``, with the hash of the rarest of their stretches."""
    length = F.length("slug")
    mine = table.where((length >= n) & (length < below) if below else length >= n)
    cut = mine.select("slug", "rank", F.explode(_stretches(F.col("slug"), n)).alias("key"))
    often = cut.groupBy("key").agg(F.count("*").alias("n"))
    return cut.join(often, "key").groupBy("slug", "rank").agg(F.min(F.struct("n", "key")).alias("k")).select("slug", "rank", "k.key")


def slug_candidates(named: DataFrame, table: DataFrame) -> DataFrame:
    """id, slug and rank for every text (``id``, ``text``) that has the stretch under which the slug is filed."""
    lengths = sorted(SLUG_STRETCHES)
    classes = [(tuple(range(1, lengths[0])), None, table.where(F.length("slug") < lengths[0]).select("slug", "rank", F.xxhash64("slug").alias("key")))]
    classes += [((n,), n, _filed(table, n, below)) for n, below in zip(lengths, [*lengths[1:], None])]
    out = None
    for sizes, name, filed in classes:
        own = F.flatten(F.array_compact(F.array(*[_stretches(F.col("text"), n) for n in sizes])))
        met = named.select("id", F.explode(own).alias("key")).join(stored(filed, f"slugs-{name or 'short'}"), "key").select("id", "slug", "rank")
        out = met if out is None else out.unionByName(met)
    return out


def slug_matches(texts: DataFrame, slugs: DataFrame, mode: str = "longest") -> DataFrame:
    """text and subject for every text (column ``text``, distinct) that holds a slug of the table.

    A contains join without a nested loop: every slug is filed under the rarest of its stretches, counted over
    the slugs, and a text looks up each of its own stretches once.  Stretches grow with the slug, as a table of many
    long slugs would crowd the few short ones.  Only hashes of texts and stretches travel; texts that share one
    are compared whole, so that it costs a comparison and no more.  Tables are stored before they are joined:
    Spark then knows their sizes.  The longest slug wins, then the smallest; with "first" the smallest ``rank``.
    Empty slugs match nothing; of a slug given twice the row with the smallest rank, else the smallest subject, counts.
    """
    rank = F.col("rank").cast("bigint") if "rank" in slugs.columns else F.lit(0).cast("bigint")
    table = stored(slugs.where("slug <> ''").select("slug", "subject", rank.alias("rank")).groupBy("slug").agg(
        F.min(F.struct("rank", "subject")).alias("s")).select("slug", "s.subject", "s.rank"), "slugs")
    named = stored(texts.select(F.xxhash64("text").alias("id"), "text"), "slug-texts")
    held = slug_candidates(named, table).join(named, "id").where(F.col("text").contains(F.col("slug")))
    order = F.struct("rank", "slug") if mode == "first" else F.struct((-F.length("slug")).alias("n"), "slug")
    best = held.groupBy("id", "text").agg(F.min_by("slug", order).alias("slug"))
    return best.join(table, "slug").select("text", "subject")


# Sites with a layout of their own.
SITE_ROUTES = {"vietjack.com": "vietjack", "hoc247.net": "hoc247", "loigiaihay.com": "loigiaihay"}


def route_by_domain(pages: DataFrame, domains: dict[str, str] | None = None, fallback: str = "generic") -> DataFrame:
    """Name of the page layout by host; the first domain found in the host wins."""
    pairs = list((domains or SITE_ROUTES).items())
    return pages.withColumn("route", F.coalesce(_first_hit(host(F.col("url")), pairs), F.lit(fallback)))


def grade_from_url(pages: DataFrame, style: str = "dashed", title: str | None = None) -> DataFrame:
    """Grade named in an address or title.

    "dashed": the first ``-n-`` when it is 1–12, else ``lop n``.  "dashed_any":
    the same without the range test.  "named": ``lop n``, else 12 for the
    final-exam addresses, else null.
    """
    url = F.col("url")
    both = url if title is None else F.concat_ws(" ", url, F.col(title))
    named = F.nullif(F.regexp_extract(both, r"(?iu)(?:lop|lớp)[- ]?(\d{1,2})", 1), F.lit(""))
    if style == "named":
        final = F.lower(url).contains("tot-nghiep") | F.lower(url).contains("thpt")
        return pages.withColumn("grade", F.coalesce(named, F.when(final, "12")))
    dashed = F.nullif(F.regexp_extract(url, r"-(\d{1,2})-", 1), F.lit(""))
    if style == "dashed":
        dashed = F.when(dashed.cast("int").between(1, 12), dashed)
    return pages.withColumn("grade", F.coalesce(dashed, named, F.lit("")))


def variant_leak_check(outputs: DataFrame, inputs: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Per batch: outputs, how many of them only repeat an input, and whether all do.

    Texts are compared by their question key, as distinct digests.
    """
    def keys(df):
        return df.select(batch, _digest(question_key(F.col("text"))).alias("_key")).distinct()

    marked = keys(outputs).join(keys(inputs).withColumn("_seen", F.lit(1)), [batch, "_key"], "left")
    return marked.groupBy(batch).agg(
        F.count("*").alias("outputs"), F.count("_seen").alias("repeated"),
    ).withColumn("leaked", F.col("outputs") == F.col("repeated"))


def facet_examples(requests: DataFrame, bank: DataFrame, n: int = 3) -> DataFrame:
    """Newest ``n`` bank rows for every request, written out as stem and options.

    ``requests(request_id, subject, topic, difficulty, question_type)``; a null
    topic, difficulty or type matches everything.  The bank is ranked once per
    combination of facets, not once per request: each row stands for its eight
    combinations and every map task keeps ``n`` ids of each.
    """
    facets = ["topic", "difficulty", "question_type"]
    shapes = [
        F.struct(*[
            (F.col(c) if mask >> i & 1 else F.lit(None).cast("string")).alias(c)
            for i, c in enumerate(facets)
        ])
        for mask in range(8)
    ]
    rows = bank.select("id", "subject", *facets, "created_at").select(
        "id", "subject", "created_at", F.explode(F.array_distinct(F.array(*shapes))).alias("f")
    ).select("id", "subject", "created_at", "f.*")
    newest = [F.col("created_at").desc(), F.col("id").desc()]
    ranked = top_n(rows, ["subject", *facets], newest, n, "place").drop("created_at")
    r = requests.select("request_id", *[F.col(c).alias(f"_{c}") for c in ("subject", *facets)])
    fits = F.col("subject") == F.col("_subject")
    for c in facets:
        fits = fits & F.col(c).eqNullSafe(F.col(f"_{c}"))
    winners = ranked.select("id").distinct()
    texts = bank.join(winners, "id").select(
        "id", example_text(F.col("content"), F.col("options")).alias("example")
    )
    return r.join(ranked, fits).join(texts, "id").select("request_id", "place", "id", "example")


def shape_similar(samples: DataFrame, bank: DataFrame, k: int = 3) -> DataFrame:
    """For each sample the ``k`` best of the newest ``2 * k`` rows of its subject.

    ``samples(sample_id, subject, text)``.  Length within half of the sample's
    length scores 2, within its whole length 1; having options like the sample
    scores 2.  Equal scores stay newest first.  The ``2 * k`` rows of a subject
    form one array, so samples meet one row each.
    """
    newest = top_n(
        bank.select("id", "subject", "created_at", "content", "options"),
        ["subject"], [F.col("created_at").desc(), F.col("id").desc()], 2 * k, "_rn",
    )
    pool = newest.groupBy("subject").agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("_rn").alias("rn"), "id", F.length("content").alias("len"),
            F.coalesce(F.size("options") > 0, F.lit(False)).alias("has"),
            example_text(F.col("content"), F.col("options")).alias("example"),
        ))).alias("_pool")
    )
    traits = F.struct(F.length("text").alias("length"), F.col("text").rlike(r"[ABCD][).]").alias("has"))

    def scored(row, sample):
        off = F.abs(row["len"] - sample["length"]) / F.greatest(sample["length"], F.lit(1))
        near = F.when(off < 0.5, 2).when(off < 1.0, 1).otherwise(0)
        score = near + F.when(row["has"] == sample["has"], 2).otherwise(0)
        return F.struct((-score).alias("neg"), row["rn"].alias("rn"), row["id"].alias("id"), row["example"].alias("example"))

    ranked = let(traits, lambda sample: F.transform("_pool", lambda row: scored(row, sample)))
    best = F.slice(F.array_sort(ranked), 1, k)
    return (
        samples.join(pool, "subject")
        .select("sample_id", F.posexplode(best).alias("_i", "_r"))
        .select("sample_id", (F.col("_i") + 1).alias("place"), F.col("_r.id").alias("id"),
                (-F.col("_r.neg")).alias("score"), F.col("_r.example").alias("example"))
    )


def example_text(content: Column, options: Column) -> Column:
    """Stem followed by its options, five at most, as ``A) …`` lines."""
    lines = F.transform(
        F.slice(options, 1, 5), lambda o, i: F.concat(F.char(i + F.lit(65)), F.lit(") "), o)
    )
    return F.when(F.size(options) > 0, F.concat(content, F.lit("\n"), F.array_join(lines, "\n"))).otherwise(content)
