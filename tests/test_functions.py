"""Column functions against Python's own, on generated texts."""

import html
import random
import unicodedata
from urllib.parse import urljoin

from pyspark.sql import functions as F

from examloom.functions import text as T
from examloom.functions.urls import resolve

ALPHABET = list("ab Z.é\n\t\r") + ["\r\n", "\x0b", "\x0c", "\x1c", "\x85", " ", " ", " ", "　", "Đ", "ệ", "é", "ñ"]


def texts(n=300, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 12))) for _ in range(n)]


def applied(spark, values, fn):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string").repartition(4)
    return [r[1] for r in sorted(df.select("i", fn(F.col("x"))).collect())]


def test_strip_and_lines(spark):
    values = texts()
    assert applied(spark, values, T.strip) == [v.strip() for v in values]
    assert applied(spark, values, T.squeeze) == [" ".join(v.split()) for v in values]
    want = [[x.strip() for x in v.splitlines() if x.strip()] for v in values]
    assert applied(spark, values, T.lines) == want


def test_fold_accents(spark):
    def folded(v):
        return "".join(c for c in unicodedata.normalize("NFD", v) if unicodedata.category(c) != "Mn")

    values = texts(seed=5) + ["Trường ĐẠI HỌC Bách khoa", "ÅÄÖ ßøł", "ǻ Ǯ"]
    assert applied(spark, values, T.fold_accents) == [folded(v) for v in values]


def test_unescape(spark):
    values = ["a &amp; b &lt;c&gt; &quot;d&quot; &#039;e&#39; &eacute;", "&amp;lt; &hellip;", "plain", "R&D", "Espa&ntilde;a it&#8217;s &#xE9;", "&lt &notit; &copy2 &unknown; & &; &#; &#x; &#128; &#0; &#55296; &#x110000; &#99999999999; &#x1F600;x &#1; &#x81; &NotEqualTilde; &fjlig;"]
    assert applied(spark, values, T.unescape_html) == [html.unescape(v) for v in values]


def test_resolve(spark):
    bases = ["http://h.com", "http://h.com/", "https://h.com/a/b.html?q=1#f", "http://h.com/a/b/", "http://h.com/a?x=/y/z"]
    hrefs = ["", "c", "/c", "../c", "../../../c", "./c", "c/./d/../e", "?p=1", "#top", "//o.org/x", "https://o.org/y", "..", ".", "c?d=../e", "mailto:a@b", "/a/../b/"]
    pairs = [(b, h) for b in bases for h in hrefs]
    df = spark.createDataFrame([(i, b, h) for i, (b, h) in enumerate(pairs)], "i int, b string, h string")
    got = [r[1] for r in sorted(df.select("i", resolve(F.col("b"), F.col("h"))).collect())]
    for (base, href), url in zip(pairs, got):
        assert url == urljoin(base, href), (base, href)
