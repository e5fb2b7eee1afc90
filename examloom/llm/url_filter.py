"""URL filter: listed rules first, then a tree of path templates judged by labelled pages.

Main path in DataFrame functions only.

Edge cases: a null URL or one without ``://`` has an empty host and path; such pages form the template of
the empty host.  Null ids are kept.  Repeated rows are judged row by row.  An empty table gives an empty
result.  Other columns of the input are not read.  Paths of any length are used whole: segments beyond
``max_depth`` form one last branch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examloom.functions.storage import checkpointed
from examloom.functions.text import let

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule of (verdict, host, path) and its verdict; null where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1], r[2]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decided, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name = F.when(fits, F.lit(f"{h}{p}")).otherwise(name)
        verdict = F.when(fits, F.lit(decided)).otherwise(verdict)
    return name, verdict


def shaped_segments(path: Column, max_depth: int) -> Column:
    """Segments of a path with runs of digits as ``{n}`` and long hexadecimal names as ``{x}``.

    A hexadecimal name has eight characters or more and a digit.  Segments from ``max_depth`` on form one.
    """
    hexed = F.regexp_replace(path, r"(?<=/)(?=[0-9a-fA-F-]*\d)(?=[0-9a-fA-F-]*[a-fA-F])[0-9a-fA-F-]{8,}(?=[/.]|$)", "{x}")
    shape = F.regexp_replace(hexed, r"\d+", "{n}")
    return F.split(F.regexp_replace(shape, r"^/", ""), "/", max_depth)


def template_tree(shapes: DataFrame, max_depth: int = 6, fan_out: int = 16, similar_z: float = 1.96) -> DataFrame:
    """Give every (host, segments) row of ``shapes`` its template.

    ``shapes`` has host, segs, n (pages), good and bad (labelled pages).  The tree is walked from the root,
    one level at a time, over branches that carry the template of their ancestors:

    * children whose labels tell them from their siblings (two-sided test of the smoothed share of bad labels
      against the share of all siblings) keep their name, however many there are;
    * of the others, a parent with more than ``fan_out`` children holds a variable: those with less than
      1/``fan_out`` of its pages become ``*``;
    * the rest, which labels do not tell apart, merge into ``~``; unlabelled ones too.

    Levels are tables of distinct templates, cut by a checkpoint each, so no plan repeats an earlier level.
    """
    rows = shapes.withColumn("template", F.lit(""))
    for level in range(max_depth):
        seg = F.get("segs", F.lit(level))
        rows = rows.withColumn("seg", seg)
        inner = rows.where(F.col("seg").isNotNull())
        children = inner.groupBy("host", "template", "seg").agg(
            F.sum("n").alias("c_n"), F.sum("good").alias("c_good"), F.sum("bad").alias("c_bad"))
        parents = children.groupBy("host", "template").agg(
            F.count("*").alias("k"), F.sum("c_n").alias("p_n"), F.sum("c_good").alias("p_good"), F.sum("c_bad").alias("p_bad"))
        share = (F.col("p_bad") + 1) / (F.col("p_bad") + F.col("p_good") + 2)
        own = (F.col("c_bad") + 2 * share) / (F.col("c_bad") + F.col("c_good") + 2)
        labelled = F.col("c_bad") + F.col("c_good")
        distance = F.abs(own - share) / F.sqrt(share * (1 - share) / F.greatest(labelled, F.lit(1)))
        variable = (F.col("k") > fan_out) & (F.col("c_n") * fan_out < F.col("p_n"))
        similar = (F.col("k") > 1) & (distance <= similar_z)
        step = F.when(similar & variable, "*").when(similar, "~").otherwise(F.col("seg"))
        decided = children.join(parents, ["host", "template"]).select(
            "host", "template", "seg", F.concat("template", F.lit("/"), step).alias("longer"))
        rows = checkpointed(
            rows.join(decided, ["host", "template", "seg"], "left")
            .select("host", "segs", "n", "good", "bad", F.coalesce("longer", "template").alias("template")))
    return rows


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    labels: DataFrame,
    max_depth: int = 6,
    reject_at: float = 0.5,
    prior: float = 4.0,
) -> DataFrame:
    """Columns page_id, host, path, rule, verdict, template, purity for every row of ``pages``.

    ``labels`` has key and bad (boolean): the number in a path names the key of its label, when both exist.
    A template is blocked when its smoothed share of bad labels, (bad + prior * overall share) /
    (labelled + prior), is at least ``reject_at``; one without labels is allowed.  Labels repeated for a key count once, as bad if one of
    them is.  Verdicts of rules stand.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("segs", shaped_segments(F.col("path"), max_depth))
    key = F.expr("try_cast(nullif(regexp_extract(path, '/([0-9]+)(?:[/.]|$)', 1), '') as bigint)")
    marks = labels.where("key is not null and bad is not null").groupBy("key").agg(F.max("bad").alias("bad"))
    tallies = urls.select("host", "segs", key.alias("key")).groupBy("host", "segs", "key").agg(F.count("*").alias("n"))
    shapes = checkpointed(
        tallies.join(marks, "key", "left").groupBy("host", "segs").agg(
            F.sum("n").alias("n"),
            F.sum(F.when(~F.col("bad"), F.col("n")).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("bad")))
    tree = template_tree(shapes, max_depth)
    totals = shapes.agg(F.sum("bad").alias("bad"), F.sum(F.col("bad") + F.col("good")).alias("n")).first()  # two numbers
    share = ((totals["bad"] or 0) + 1) / ((totals["n"] or 0) + 2)
    purity = (F.col("t_bad") + prior * share) / (F.col("t_n") + prior)
    groups = tree.groupBy("host", "template").agg(F.sum("bad").alias("t_bad"), F.sum(F.col("bad") + F.col("good")).alias("t_n"))
    judged = groups.select("host", "template", purity.alias("purity"), (F.col("t_n") > 0).alias("labelled"))
    found = tree.select("host", "segs", "template").join(judged, ["host", "template"])
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_tree = F.when(F.col("labelled") & (F.col("purity") >= reject_at), "block").otherwise("allow")
    return urls.join(found, ["host", "segs"], "left").select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, by_tree).alias("verdict"), "template", "purity")
