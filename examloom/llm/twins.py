"""SQL twins of the operators that SQL can express."""

from __future__ import annotations

from examloom.llm import quality_rules

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+')"


def _shingles(words: str) -> str:
    return f"CASE WHEN len({words}) >= 5 THEN list_transform(range(1, len({words}) - 3), lambda i: {words}[i:i + 4]) WHEN len({words}) > 0 THEN [{words}] ELSE [] END"


DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_LOWER} AS w FROM documents), i AS (SELECT item_id, {_LOWER} AS w FROM benchmark),
item AS (SELECT item_id, w, len(w) AS n, {_shingles('w')} AS s FROM i WHERE len(w) > 0),
item_places AS (SELECT item_id, n, unnest(s) AS g, unnest(range(0, len(s))) AS q FROM item),
doc_places AS (SELECT doc_id, unnest({_shingles('w')}) AS g, unnest(range(0, greatest(len(w) - 4, 1))) AS p FROM d WHERE len(w) >= 5),
windows AS (SELECT DISTINCT doc_id, item_id, n, greatest(p - q, 0) AS start FROM doc_places JOIN item_places USING (g)),
cut AS (SELECT doc_id, item_id, start, w[start + 1:start + n] AS w FROM windows JOIN d USING (doc_id)),
a AS (SELECT doc_id, item_id, start, g, count(*) AS a FROM (SELECT doc_id, item_id, start, unnest({_shingles('w')}) AS g FROM cut) GROUP BY ALL),
b AS (SELECT item_id, g, count(*) AS b FROM item_places GROUP BY ALL),
w AS (SELECT doc_id, item_id, start, sum(a) AS na FROM a GROUP BY ALL), m AS (SELECT item_id, sum(b) AS nb FROM b GROUP BY ALL),
both_ AS (SELECT doc_id, item_id, start, sum(least(a, b)) AS x FROM a JOIN b USING (item_id, g) GROUP BY ALL),
judged AS (SELECT doc_id, item_id, start, x / (na + nb - x) AS similarity FROM both_ JOIN w USING (doc_id, item_id, start) JOIN m USING (item_id)),
best AS (SELECT doc_id, item_id, max(similarity) AS similarity FROM judged WHERE similarity >= 0.8 GROUP BY ALL)
SELECT doc_id, item_id, similarity::DOUBLE AS similarity, min(start)::INT AS start_word FROM best JOIN judged USING (doc_id, item_id, similarity) GROUP BY ALL"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
t AS (SELECT text, min(doc_id) AS t, count(*) AS copies, list_distinct({_shingles('any_value(w)')}) AS s FROM d GROUP BY text),
g AS (SELECT t, unnest(s) AS g FROM t), shared AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
k AS (SELECT t, g FROM g SEMI JOIN shared USING (g)),
pairs AS (SELECT a.t AS t, b.t AS u, count(*) AS x FROM k a JOIN k b ON a.g = b.g AND a.t <> b.t GROUP BY ALL),
links AS (SELECT p.t, p.u, c.copies FROM pairs p JOIN t b ON b.t = p.t JOIN t c ON c.t = p.u WHERE x >= 0.8 * (len(b.s) + len(c.s) - x)),
reach AS (SELECT t, t AS u FROM t UNION SELECT r.t, l.u FROM reach r JOIN links l ON l.t = r.u),
class AS (SELECT t, min(u) AS class_id FROM reach GROUP BY t),
counts AS (SELECT t, count(*) AS n_text_links, sum(copies) AS docs FROM links GROUP BY t)
SELECT doc_id, class_id, (coalesce(docs, 0) + copies - 1)::BIGINT AS n_links, coalesce(n_text_links, 0) AS n_text_links
FROM d JOIN t USING (text) JOIN class USING (t) LEFT JOIN counts USING (t)"""



def _certain(part: str, whole: str) -> str:
    n, z = f"greatest({whole}, 1.0)::DOUBLE", quality_rules.ERRORS
    p = f"({part} / {n})"
    return (f"CASE WHEN {part} > 0 THEN ({p} + {z * z} / (2 * {n}) - {z} * sqrt({p} * (1 - {p}) / {n} + {z * z} / (4 * {n} * {n}))) / (1 + {z * z} / {n}) ELSE 0 END")


_METRICS = ", ".join(f"('{name}', {name}, {sure})" for name, sure in (
    ("symbol_share", _certain("n_symbols", "word_chars")), ("line_share", _certain("n_dup_lines", "n_lines")),
    ("repeat_share", _certain("(n_repeat_words / 5)", "(n_words / 5)")), ("word_length", "word_length")))
_SPREAD = "sqrt(greatest(s2 / n - pow(s1 / n, 2), 0))"
_SUMS = "sum(n) AS n, sum(s1) AS s1, sum(s2) AS s2"


QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])) AS g, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
twice AS (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM g SEMI JOIN twice USING (doc_id, g), generate_series(0, 4) s(j) GROUP BY doc_id),
c AS (SELECT doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(ls) AS n_lines
  FROM d JOIN l USING (doc_id) LEFT JOIN covered USING (doc_id)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_symbols / greatest(word_chars, 1) AS symbol_share,
  n_dup_lines / greatest(n_lines, 1) AS line_share, n_repeat_words / greatest(n_words, 1) AS repeat_share, word_chars / greatest(n_words, 1) AS word_length FROM c),
v AS (SELECT doc_id, lang, source, metric, value, sure FROM m, LATERAL (VALUES {_METRICS}) x(metric, value, sure) WHERE NOT base_failed),
bins AS (SELECT lang, source, metric, greatest(ceil(ln(greatest(value * 1e6, 1.0)) / ln(1.02)), 0)::INT AS bin, count(*) AS n FROM v GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bin) AS seen, sum(n) OVER (PARTITION BY lang, source, metric) AS total FROM bins),
edges AS (SELECT *, CASE WHEN bin > 0 THEN pow(1.02, bin) / 1e6 ELSE 0 END AS x FROM cum),
g1 AS (SELECT lang, source, metric, min(CASE WHEN seen >= total * 0.5 THEN x END) AS q50, sum(n) AS n, sum(n * x) AS s1, sum(n * x * x) AS s2 FROM edges GROUP BY ALL),
l1 AS (SELECT lang, metric, {_SUMS} FROM g1 GROUP BY ALL), a1 AS (SELECT metric, {_SUMS} FROM l1 GROUP BY ALL),
a2 AS (SELECT metric, {_SPREAD} AS s FROM a1),
l2 AS (SELECT lang, metric, (n * {_SPREAD} + {quality_rules.PRIOR} * s) / (n + {quality_rules.PRIOR}) AS s FROM l1 JOIN a2 USING (metric)),
limits AS (SELECT g1.lang, source, g1.metric, q50 + {quality_rules.SPREADS} * (n * {_SPREAD} + {quality_rules.PRIOR} * s) / (n + {quality_rules.PRIOR}) AS top
  FROM g1 JOIN l2 ON g1.lang IS NOT DISTINCT FROM l2.lang AND g1.metric = l2.metric),
bad AS (SELECT DISTINCT doc_id FROM v JOIN limits x ON v.lang IS NOT DISTINCT FROM x.lang AND v.source IS NOT DISTINCT FROM x.source AND v.metric = x.metric WHERE sure > top)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept
FROM m LEFT JOIN bad USING (doc_id)"""


def _crc32(number: str) -> str:
    """Unsigned CRC-32 of a number's decimal digits, bit by bit."""
    bits = f"flatten(list_transform(string_split({number}::VARCHAR, ''), lambda ch: list_transform(range(0, 8), lambda k: (ascii(ch) >> k) & 1)))"
    step = "lambda c, b: CASE WHEN (xor(c, b) & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"xor(list_reduce(list_concat([4294967295], {bits}), {step}), 4294967295)"


PREFIX_TRIE = f"""
WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
  {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list(t ORDER BY i) AS own, {_crc32('c')} % 6 AS h FROM o GROUP BY c),
r AS (SELECT l.c, list_concat(coalesce(b.own, [])[1:l.h], l.own[l.h + 1:]) AS path FROM l LEFT JOIN l b ON b.c = l.c - l.c % 100),
p AS (SELECT c, path, unnest(range(0, len(path) + 1)) AS depth FROM r),
m AS (SELECT c, depth, depth = len(path) AS ends, path[1:depth] AS node FROM p),
n AS (SELECT node, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY node),
k AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * coalesce(length(n.node[depth].text), 0) AS own FROM n LEFT JOIN k USING (node)),
up AS (SELECT node[1:d] AS node, own, n_children FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM v)),
s AS (SELECT node, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM up GROUP BY node)
SELECT v.conv_id, v.depth, a.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
FROM v JOIN s USING (node) LEFT JOIN n a ON v.depth > 0 AND a.node = v.node[1:v.depth - 1]"""


def _framed(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def _row_digest(text: str) -> str:
    return f"sha256({' || '.join(_framed(v) for v in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _climb(level: str, name: str) -> str:
    """All nodes of the trees over ``level`` (tree, i, n, d), with the two sides of every node's run."""
    return f"""{name} AS (SELECT tree, 0 AS h, i, n, d FROM {level} UNION ALL
  SELECT tree, h + 1, i // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY tree, h, i // 8, n),
{name}_side AS (SELECT tree, h, i, n, d, coalesce(string_agg(d, '' ORDER BY i) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(d, '' ORDER BY i) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name} WHERE n > 1 WINDOW w AS (PARTITION BY tree, h, i // 8 ORDER BY i))"""


def _follow(name: str, start: str) -> str:
    return f"""{name}_walk AS (SELECT {start} UNION ALL SELECT w.doc_id, w.lang, w.tree, w.h + 1, w.i // 8, sha256(s.l || w.cur || s.r), w.proof || s.l || s.r
  FROM {name}_walk w JOIN {name}_side s ON s.tree = w.tree AND s.h = w.h AND s.i = w.i),
{name}_end AS (SELECT doc_id, lang, max_by(cur, h) AS cur, max_by(proof, h) AS proof FROM {name}_walk GROUP BY doc_id, lang)"""


MERKLE = f"""
WITH RECURSIVE f AS (SELECT doc_id, lang, coalesce('=' || lang, '-') AS tree, {_row_digest('text')} AS leaf,
  CASE WHEN {_crc32('doc_id')} % 3 = 0 THEN {_row_digest("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n, leaf AS d FROM f),
{_climb('leaves', 'sub')},
subroots AS (SELECT '' AS tree, tree AS lang_tree, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, d FROM sub WHERE n = 1),
{_climb('subroots', 'top')}, root AS (SELECT d AS root FROM top WHERE n = 1),
{_follow('sub', "doc_id, lang, tree, 0 AS h, i, coalesce(tampered, leaf) AS cur, '' AS proof FROM leaves")},
met AS (SELECT e.doc_id, e.lang, e.cur, e.proof, s.i FROM sub_end e JOIN subroots s ON s.lang_tree = coalesce('=' || e.lang, '-')),
{_follow('top', "doc_id, lang, '' AS tree, 0 AS h, i, cur, proof FROM met")}
SELECT x.doc_id, leaf, s.d AS subroot, root, sha256(e.proof) AS proof_sha256, e.cur AS folded_root, e.cur = root AS verified
FROM leaves x JOIN top_end e ON e.doc_id = x.doc_id JOIN subroots s ON s.lang_tree = x.tree, root"""
