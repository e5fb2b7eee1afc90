"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from examloom.functions.text import let


def host(url) -> Column:
    """Lower-case host without a leading ``www.``."""
    name = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.regexp_replace(F.coalesce(name, F.lit("")), r"^www\.", "")


def file_name(url) -> Column:
    """Part after the last slash, lower case."""
    return F.lower(F.substring_index(url, "/", -1))


def without_fragment(url) -> Column:
    return F.regexp_replace(url, r"#.*$", "")


def base_parts(base) -> Column:
    """What is needed of a page address to resolve its links; worth working out once per page."""
    plain = without_fragment(base)
    origin = F.regexp_extract(plain, r"^([A-Za-z][\w+.\-]*://[^/?#]*)", 1)
    bare = F.regexp_replace(plain, r"\?.*$", "")
    path = F.substring(bare, F.length(origin) + 1, F.length(bare))
    return F.struct(
        base.alias("whole"), plain.alias("plain"), bare.alias("bare"), origin.alias("origin"),
        F.regexp_extract(plain, r"^([A-Za-z][\w+.\-]*):", 1).alias("scheme"),
        # Up to the last slash of the path; a bare host gets one.
        F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", "")).alias("folder"),
    )


def resolve_from(base, href) -> Column:
    """Absolute form of ``href`` on a page given by its :func:`base_parts`."""
    target = (
        F.when(href == "", base["whole"])
        .when(href.rlike(r"^[A-Za-z][\w+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(base["scheme"], F.lit(":"), href))
        .when(href.startswith("/"), F.concat(base["origin"], href))
        .when(href.startswith("?"), F.concat(base["bare"], href))
        .when(href.startswith("#"), F.concat(base["plain"], href))
        .otherwise(F.concat(base["origin"], base["folder"], href))
    )
    return let(target, lambda x: F.when(x.rlike(r"/\.{1,2}(/|$|[?#])"), _fold_dots(x)).otherwise(x))


def resolve(base, href) -> Column:
    """Absolute form of ``href`` found on page ``base``."""
    return let(base_parts(base), lambda b: resolve_from(b, href))


def _fold_dots(url) -> Column:
    """Resolve ``.`` and ``..`` segments of the path."""
    origin = F.regexp_extract(url, r"^([A-Za-z][\w+.\-]*://[^/?#]*)", 1)
    rest = F.substring(url, F.length(origin) + 1, F.length(url))
    tail = F.regexp_extract(rest, r"([?#].*)$", 1)
    path = F.regexp_replace(rest, r"[?#].*$", "")
    steps = F.split(F.regexp_replace(path, "^/", ""), "/")

    def step(acc, part):
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", acc).otherwise(F.concat(acc, F.array(part)))

    kept = F.aggregate(steps, F.array().cast("array<string>"), step)
    closed = F.when(path.rlike(r"/\.{1,2}$") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.concat(origin, F.lit("/"), F.array_join(kept, "/"), closed, tail)
