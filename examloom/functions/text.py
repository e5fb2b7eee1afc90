"""Text expressions.  All of them are built-in Spark expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line breaks as a text reader sees them.
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85  ]"
# Every character that counts as white space, from the Unicode property.
_SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Label shapes of options and numbering.
OPTION_LABEL = r"[A-Ha-h][).\-:]\s+"
LEADING_NUMBER = r"^\s*\d{1,3}[).\-:]\s+"
QUESTION_PREFIX = (
    r"(?iuU)^\s*(Câu(\s+hỏi)?\s*\d*\s*[:.)]\s*|Question\s*\d*\s*[:.)]\s*)"
)
VIETNAMESE_CHAR = r"[À-ỹ]"
NON_ASCII_CHAR = r"[^\x00-\x7F]"


def _fold_table() -> tuple[str, str, str]:
    """Characters that lose their marks under NFD, what they become, and the marks themselves."""
    marked, plain = [], []
    for code in range(0x00C0, 0x1F00):
        ch = chr(code)
        parts = unicodedata.normalize("NFD", ch)
        kept = "".join(c for c in parts if unicodedata.category(c) != "Mn")
        if kept != ch and len(kept) == 1:
            marked.append(ch)
            plain.append(kept)
    marks = [chr(c) for c in range(0x0300, 0x0370) if unicodedata.category(chr(c)) == "Mn"]
    return "".join(marked), "".join(plain), "".join(marks)


_MARKED, _PLAIN, _MARKS = _fold_table()


def strip(col) -> Column:
    """Drop white space of every kind at both ends."""
    return F.btrim(col, F.lit(_SPACES))


def squeeze(col) -> Column:
    """Runs of white space become one blank; ends are stripped."""
    return _single_blanks(F.translate(col, _SPACES, " " * len(_SPACES)))


def _single_blanks(col) -> Column:
    return F.trim(F.regexp_replace(col, " {2,}", " "))


def let(value, body) -> Column:
    """``body(value)`` with the value worked out once; lambdas share no subexpressions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def contains_any(col, words: list[str]) -> Column:
    """True when one of the plain words occurs; the text is looked at once."""
    return col.rlike("|".join(re.escape(w) for w in words))


def unix_breaks(col) -> Column:
    """Every kind of line break as a newline; texts without the rare kinds pass untouched."""

    def cleaned(x):
        rare = F.lit(False)
        for ch in "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029":
            rare = rare | x.contains(ch)
        return F.when(rare, F.regexp_replace(x, LINE_BREAK, "\n")).otherwise(x)

    return let(col, cleaned)


def lines(col) -> Column:
    """Non-empty stripped lines of a text, in order."""
    return F.filter(F.transform(F.split(unix_breaks(col), "\n"), strip), lambda x: x != "")


def blocks(col) -> Column:
    """Non-empty stripped blocks separated by blank lines."""
    unix = F.replace(col, F.lit("\r\n"), F.lit("\n"))
    return F.filter(F.transform(F.split(unix, r"\n\s*\n"), strip), lambda x: x != "")


def fold_accents(col) -> Column:
    """Accent-free form: NFD without marks, so the letter đ stays."""
    # Characters without a partner are dropped: the marks.
    return F.translate(col, _MARKED + _MARKS, _PLAIN)


def name_key(col) -> Column:
    """Accent-free, single-spaced, lower-case name."""
    folded = F.translate(col, _MARKED + _SPACES + _MARKS, _PLAIN + " " * len(_SPACES))
    return F.lower(_single_blanks(folded))


def strip_numbering(col) -> Column:
    """Drop a leading "Câu n:" / "Question n." prefix, then a leading number."""
    return strip(
        F.regexp_replace(F.regexp_replace(col, QUESTION_PREFIX, ""), LEADING_NUMBER, "")
    )


def question_key(col) -> Column:
    """Comparison key of a question text."""
    return F.lower(strip_numbering(col))


def is_blank(col) -> Column:
    """Null or empty, as a condition that is never null."""
    return F.coalesce(col == "", F.lit(True))


def has_text(col) -> Column:
    return ~is_blank(col)


def answer_letter(answer, options=None) -> Column:
    """Letter A–E of an answer given as a letter or as the text of an option."""
    col = F.col(answer) if isinstance(answer, str) else answer
    upper = F.upper(strip(col))
    letter = F.when(upper.rlike("^[A-E]$"), upper)
    if options is None:
        return letter
    opts = F.col(options) if isinstance(options, str) else options
    place = F.array_position(opts, col)
    return F.coalesce(F.when(place > 0, letter_at(place)), letter)


def answer_text(answer, options) -> Column:
    """Text of the answer, given as the text itself or as a letter."""
    col = F.col(answer) if isinstance(answer, str) else answer
    opts = F.col(options) if isinstance(options, str) else options
    upper = F.upper(strip(col))
    index = F.ascii(upper) - F.lit(64)
    by_letter = F.when(upper.rlike("^[A-E]$"), F.try_element_at(opts, index))
    return F.coalesce(F.when(F.array_contains(opts, col), col), by_letter, col)


def letter_at(position) -> Column:
    """1 becomes A, 2 becomes B."""
    return F.char(position.cast("int") + F.lit(64))


def _named_entities() -> tuple[dict[str, str], list[str]]:
    """Names with their characters, and the old names that need no semicolon, longest first (public standard)."""
    from html.entities import html5

    full = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
    return full, sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))


_NAMED, _OLD_NAMES = _named_entities()
# Numbers of the range that the standard reads as Windows-1252.
_WINDOWS = {n: bytes([n]).decode("cp1252") for n in range(0x80, 0xA0) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def unescape_html(col) -> Column:
    """Named, decimal and hexadecimal entities of HTML to their characters, each once; ``&nbsp;`` is a blank.

    The text is cut at ampersands, and each part looks up its own entity.
    """
    listed = " ".join(f"{k}:{v.encode().hex()}" for k, v in _NAMED.items())
    names = F.str_to_map(F.lit(listed), F.lit(" "), F.lit(":"))  # a constant

    def named(name):
        return F.when(name == "nbsp", " ").otherwise(F.decode(F.unhex(F.try_element_at(names, name)), "UTF-8"))

    def numbered(digits):
        hexed = F.lower(F.substring(digits, 1, 1)) == "x"
        clean = F.regexp_replace(F.when(hexed, F.substring(digits, 2, 1 << 20)).otherwise(digits), "^0+(?=.)", "")
        code = F.when(F.length(clean) <= 8, F.when(hexed, F.conv(clean, 16, 10)).otherwise(clean).try_cast("bigint"))

        def char(n):
            out = F.translate(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"), "".join(map(chr, _WINDOWS)), "".join(_WINDOWS.values()))
            control = n.between(1, 8) | n.between(14, 31) | n.isin(11, 127)
            noncharacter = n.between(0xFDD0, 0xFDEF) | ((n % 0x10000) >= 0xFFFE)
            bad = n.isNull() | (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
            return F.when(bad, "\ufffd").when(control | noncharacter, "").otherwise(out)

        return let(code, char)

    def decoded(part):
        number = F.regexp_extract(part, r"^#([0-9]+|[xX][0-9a-fA-F]+);?", 1)
        name = F.regexp_extract(part, r"^([A-Za-z][A-Za-z0-9]*);", 1)
        old = F.regexp_extract(part, f"^({'|'.join(_OLD_NAMES)})", 1)
        by_number = F.concat(numbered(number), F.regexp_replace(part, r"^#([0-9]+|[xX][0-9a-fA-F]+);?", ""))
        by_name = F.concat(named(name), F.regexp_replace(part, r"^[A-Za-z][A-Za-z0-9]*;", ""))
        by_old = F.concat(named(old), F.substring(part, F.length(old) + 1, F.length(part)))
        return F.when(number != "", by_number).otherwise(
            F.coalesce(F.when(name != "", by_name), F.when(old != "", by_old), F.concat(F.lit("&"), part)))

    def replaced(x):
        parts = F.transform(F.split(x, "&", -1), lambda p, i: F.when(i == 0, p).otherwise(decoded(p)))
        return F.when(x.contains("&"), F.array_join(parts, "")).otherwise(x)

    return let(col, replaced)


def strip_tags(col) -> Column:
    """Text of an HTML fragment: tags out, entities resolved, spaces squeezed."""
    return let(F.regexp_replace(col, r"<[^>]*+>", " "), lambda x: squeeze(unescape_html(x)))


def seeded(seed, *parts) -> Column:
    """Reproducible random-looking sort key."""
    return F.md5(F.concat(F.lit(str(seed)), *[p.cast("string") for p in parts]))
