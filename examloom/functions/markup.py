"""Elements of stored pages, each with its own closing tag, as arrays inside the row.

A page is cut into pieces: tags, texts, comments, scripts.  Tags get a depth by running sums, and an element ends
at the first tag after it that brings its depth down again: events of one name and depth, sorted by place, alternate
between opening and closing, so that the next event is the end.  Two elements close by what follows: a list item at
the next item or the end of its list, a paragraph at the next paragraph, item or the end of its block.  What is
never closed runs to the end of the page.  Everything is built from array functions: no shuffle, no Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examloom.functions.text import let, squeeze, unescape_html

# Elements without content, lists, and blocks that end a paragraph (public standard of the language).
VOID_TAGS = "area base br col embed hr img input link meta param source track wbr".split()
LIST_TAGS = ["ul", "ol"]
BLOCK_TAGS = "article aside blockquote body div footer form header main nav ol section table tbody td th tr ul".split()

# A tag may hold ">" between quotes; a quote that is never closed does not swallow the page.
_TAG = r"</?[a-z][^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>|</?[a-z][^>]*+>"
_HIDDEN = r"<!--.*?(?:-->|\z)|<(?:script|style)\b[^>]*+>.*?(?:</(?:script|style)\s*+>|\z)"
_PIECE = rf"(?is){_HIDDEN}|{_TAG}|[^<]++|<"
_CHUNK = 64


def running_sums(xs: str, levels: int = 2) -> str:
    """SQL for the sums so far, the element itself included, of an array of integers.

    Sums run inside chunks, and chunks are carried over in two further levels, so that no fold copies more than a
    chunk's worth of results.
    """
    along = lambda x: (
        f"aggregate({x}, struct(cast(array() AS array<bigint>) AS done, 0L AS total), "
        "(a, v) -> struct(array_append(a.done, a.total + v) AS done, a.total + v AS total), a -> a.done)")
    if levels == 0:
        return along(xs)
    chunk, before, ends = f"c{levels}", f"b{levels}", f"t{levels}"
    chunked = f"transform(sequence(0, int((size({xs}) - 1) div {_CHUNK})), i -> {along(f'slice({xs}, i * {_CHUNK} + 1, {_CHUNK})')})"
    totals = _let(f"transform({chunk}, c -> element_at(c, -1))", ends, running_sums(ends, levels - 1))
    carried = _let(totals, before, f"flatten(transform({chunk}, (c, i) -> transform(c, x -> x + coalesce(get({before}, i - 1), 0L))))")
    return f"CASE WHEN size({xs}) <= {_CHUNK} THEN {along(xs)} ELSE {_let(chunked, chunk, carried)} END"


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``value`` worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def page_pieces(html) -> Column:
    """Tags and texts of a page in order; comments, scripts and styles become empty."""
    found = F.regexp_extract_all(html, F.lit(_PIECE), F.lit(0))
    return F.transform(found, lambda x: F.when(x.rlike("(?is)^<(?:!--|script|style)"), "").otherwise(x))


def _listed(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _event(name: str, level: str, opens: str) -> str:
    return f"struct({name} AS name, int({level}) AS level, t.at AS at, t.j AS j, {opens} AS opens)"


#: Three sums in one number: opening tags, lists and blocks that are open (these two may fall below zero).
_LISTS, _BLOCKS, _HALF = 1 << 24, 1 << 44, 1 << 19
_IS_LIST, _IS_BLOCK = f"t.name IN ({_listed(LIST_TAGS)})", f"t.name IN ({_listed(BLOCK_TAGS)})"

_TAG_FIELDS = f"""CASE WHEN n <> '' THEN struct(i AS at, n AS name,
  CASE WHEN startswith(x, '</') THEN -1 WHEN endswith(x, '/>') OR n IN ({_listed(VOID_TAGS)}) THEN 0 ELSE 1 END AS step, x AS tag) END"""
_TAG_NAME = r"lower(regexp_extract(x, r'^</?([a-zA-Z][a-zA-Z0-9]*)', 1))"
_ADDED = f"if(t.step = 1, 1L, 0L) + if({_IS_LIST}, t.step, 0) * {_LISTS}L + if({_IS_BLOCK}, t.step, 0) * {_BLOCKS}L"
_LEVELS = (
    f"struct(t.name AS name, t.at AS at, j AS j, t.step AS step, int(o) AS opens, int(l) AS lists, "
    f"int(shiftright(get(_sums, j) - o - l * {_LISTS}L, 44)) AS blocks)")
_OPEN_LISTS = f"((shiftright(get(_sums, j) - o, 24) + {_HALF}) & {2 * _HALF - 1}) - {_HALF}"
_PLACED = f"""CASE
  WHEN t.name = 'li' THEN array({_event("'li'", 't.lists', 't.step = 1')}, {_event("'p'", 't.blocks', 'false')})
  WHEN t.name = 'p' THEN array({_event("'p'", 't.blocks', 't.step = 1')})
  WHEN {_IS_LIST} THEN array({_event("'li'", 't.lists + 1', 'false')}, {_event("'p'", 't.blocks + 1', 'false')})
  ELSE array({_event("'p'", 't.blocks + 1', 'false')}) END"""
_CLOSING = f"t.step <> 0 AND (t.name IN ('li', 'p') OR (t.step = -1 AND ({_IS_LIST} OR {_IS_BLOCK})))"
_ELEMENT = """struct(e.at AS at, if(ends, after.at, _most) AS to, e.name AS name, get(_tags, e.j).tag AS tag,
  coalesce(get(_tags, e.j - 1).step = 1, false) AS first, get(_counted, e.j).opens - 1 AS k,
  get(_counted, if(ends, after.j, size(_tags)) - 1).opens - get(_counted, e.j).opens AS n)"""
_ENDED = _let("get(_events, i + 1)", "after", _let("coalesce(after.name = e.name AND after.level = e.level, false)", "ends", _ELEMENT))

# Steps from pieces to elements: column, the columns that it is made of, SQL.
_STEPS = [
    # place in the pieces, name, step (1 opens, -1 closes, 0 is empty) and source of every tag
    ("_tags", ["_pieces"], f"""filter(transform(_pieces, (x, i) -> CASE WHEN startswith(x, '<') AND length(x) > 2
      THEN {_let(_TAG_NAME, 'n', _TAG_FIELDS)} END), t -> t IS NOT NULL)"""),
    ("_sums", ["_tags"], _let(f"transform(_tags, t -> {_ADDED})", "steps", running_sums("steps"))),
    # tags with the lists and blocks open after them, and the opening tags so far
    ("_counted", ["_tags", "_sums"], f"transform(_tags, (t, j) -> {_let(f'get(_sums, j) & {_LISTS - 1}', 'o', _let(_OPEN_LISTS, 'l', _LEVELS))})"),
    # tags of elements that close by name alone, name by name, and how many of the name are open
    ("_named", ["_counted"], "sort_array(filter(_counted, t -> t.step <> 0 AND t.name NOT IN ('li', 'p')))"),
    ("_depths", ["_named"], _let("transform(_named, t -> bigint(t.step))", "steps", running_sums("steps"))),
    # what opens and closes, by name, depth and place; the end of a list ends its last item, that of a block its last paragraph
    ("_events", ["_counted", "_named", "_depths"], f"""sort_array(concat(
      transform(_named, (t, i) -> {_event('t.name', 'get(_depths, i) + if(t.step = -1, 1, 0)', 't.step = 1')}),
      flatten(transform(filter(_counted, t -> {_CLOSING}), t -> {_PLACED}))))"""),
    ("_most", ["_pieces"], "size(_pieces)"),
    # at and to: places of both tags in the pieces; first: nothing stands between the parent's tag and this one but text;
    # k: own place in this array; n: elements inside
    ("_elements", ["_tags", "_counted", "_events", "_most"], f"""sort_array(filter(
      transform(_events, (e, i) -> CASE WHEN e.opens THEN {_ENDED} END), x -> x IS NOT NULL))"""),
]


class Markup:
    """A page as pieces, their texts, and elements."""

    def __init__(self, pieces, texts, elements):
        self.pieces, self.texts, self.elements = pieces, texts, elements

    def _within(self, what, e) -> Column:
        return F.slice(what, e["at"] + 2, e["to"] - e["at"] - 1)

    def source(self, e) -> Column:
        """What stands between the two tags of an element."""
        return F.array_join(self._within(self.pieces, e), "")

    def tags(self, e, name: str) -> Column:
        """Source of the tags of one name inside an element, those without content too."""
        return F.filter(self._within(self.pieces, e), lambda x: x.rlike(rf"(?i)^<{name}\b"))

    def text(self, e) -> Column:
        """Text of an element: a blank for every tag in it, spaces squeezed."""
        return squeeze(F.array_join(self._within(self.texts, e), ""))

    def inside(self, e) -> Column:
        """Elements inside an element."""
        return F.slice(self.elements, e["k"] + 2, e["n"])

    def direct_text(self, e) -> Column:
        """Text that stands in an element itself, in none of those inside it."""
        places = F.sequence(e["at"] + 1, F.greatest(e["to"] - 1, e["at"] + 1))
        free = lambda inside: F.filter(places, lambda i: ~F.exists(inside, lambda c: (c["at"] <= i) & (i <= c["to"])))
        own = let(self.inside(e), free)
        return F.when(e["to"] > e["at"] + 1, squeeze(F.array_join(F.transform(own, lambda i: F.get(self.texts, i)), " "))).otherwise("")


def page_texts(pieces) -> Column:
    """Texts of the pieces, entities resolved; a tag is a blank."""
    return F.transform(pieces, lambda x: F.when(x.rlike("^</?[a-zA-Z!?]"), " ").otherwise(unescape_html(x)))


def page_text(pieces, separator: str = "\n") -> Column:
    """All texts of a page, entities resolved."""
    texts = F.filter(pieces, lambda x: (x != "") & ~x.rlike("^</?[a-zA-Z!?]"))
    return unescape_html(F.array_join(texts, separator))


def _attribute_test(tag, name: str, word: str) -> Column:
    return tag.contains("=") & tag.rlike(rf"(?is)\s{name}\s*=\s*[\"']{word}[\"']")


def selector(css: str) -> Callable[[Column], Column]:
    """Test of an element for simple forms, alone or together: ``tag``, ``#id``, ``.class``, ``[class*='part']``, ``:first-child``."""
    tag, own_id, name, part, first = re.fullmatch(r"(\w+)?(?:#([\w-]+))?(?:\.([\w-]+))?(?:\[class\*='([^']+)'\])?(:first-child)?", css).groups()

    def test(e):
        out = F.lit(True) if tag is None else e["name"] == tag
        if own_id:
            out = out & _attribute_test(e["tag"], "id", re.escape(own_id))
        if name:
            out = out & _attribute_test(e["tag"], "class", rf"(?:[^\"']*\s)?{re.escape(name)}(?:\s[^\"']*)?")
        if part:
            out = out & _attribute_test(e["tag"], "class", rf"[^\"']*{re.escape(part)}[^\"']*")
        return out & e["first"] if first else out

    return test


def matching(elements, css: str) -> Column:
    """Elements that a selector takes, in order."""
    return F.filter(elements, selector(css))


def first_matching(elements, choices: tuple[str, ...]) -> Column:
    """The first element of the first selector that takes any."""
    return F.coalesce(*[F.get(matching(elements, c), 0) for c in choices])


def _bound(columns: list[str], body) -> Column:
    """``body`` on columns that are bound here: inside a lambda a bare column may be replaced by what it stands for."""
    if not columns:
        return body()
    return let(F.col(columns[0]), lambda x: _bound(columns[1:], lambda *more: body(x, *more)))


def _stepped(frame: DataFrame, name: str, columns: list[str], sql: str) -> DataFrame:
    """One more column; what it is made of is bound first, as a lambda would work a replaced column out each time."""
    for c in reversed(columns):
        sql = _let(c, c, sql)
    return frame.withColumn(name, F.expr(sql))


def with_markup(pages: DataFrame, html: str = "html", drop: list[str] | None = None) -> DataFrame:
    """Pages with their markup (``_pieces``, ``_texts``, ``_elements``), one column a step.

    Elements named in ``drop`` lose their name and tag, and all that stands in them is empty.
    """
    out = pages.withColumn("_pieces", page_pieces(F.col(html)))
    for step in _STEPS:
        out = _stepped(out, *step)
    if drop:
        covered = "exists(_gone, g -> g.at <= {0} AND {0} <= g.to)"
        bare = "named_struct('at', e.at, 'to', e.to, 'name', '', 'tag', '', 'first', e.first, 'k', e.k, 'n', e.n)"
        out = _stepped(out, "_gone", ["_elements"], f"filter(_elements, e -> e.name IN ({_listed(drop)}))")
        out = _stepped(out, "_pieces", ["_pieces", "_gone"], (
            f"CASE WHEN size(_gone) = 0 THEN _pieces ELSE transform(_pieces, (x, i) -> if({covered.format('i')}, '', x)) END"))
        out = _stepped(out, "_elements", ["_elements", "_gone"], (
            f"CASE WHEN size(_gone) = 0 THEN _elements ELSE transform(_elements, e -> if({covered.format('e.at')}, {bare}, e)) END"))
    return out.withColumn("_texts", page_texts(F.col("_pieces")))


def on_markup(body: Callable[[Markup], Column]) -> Column:
    """``body`` on the markup columns of a page."""
    return _bound(["_pieces", "_texts", "_elements"], lambda p, t, e: body(Markup(p, t, e)))
