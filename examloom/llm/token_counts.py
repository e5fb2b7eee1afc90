"""Token counts per section, by the places of the tokens in the whole text.

A document is encoded once, whole, with a byte-level BPE vocabulary.  Every token is a stretch of the UTF-8
bytes of the text, so token lengths give spans, and an interval join on sorted starts attributes them to the
sections.  Sections cover the text without gaps or overlaps; an interval join within one document is a
binary search, so no rows are exploded.

The rule for tokens that cross a boundary is a parameter:

* ``start``: the section that holds the first byte of the token gets it;
* ``most``: the section that holds most of its bytes gets it, the earliest of equals;
* ``share``: each section gets the share of its bytes.

Whatever the rule, the counts of a document add up to its tokens.

Edge cases: a null or empty text has one section of kind ``body`` without tokens.  Texts of any length are
encoded whole.  Null and repeated ids are kept.  An empty table gives an empty result.  Other columns are not
read.  Places are code points.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from examloom.llm.bytes import pieces

RULES = ("start", "most", "share")


@lru_cache(maxsize=1)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines())}
    sizes = np.zeros(max(table.values()) + 1, np.int64)
    for piece, i in table.items():
        sizes[i] = len(piece)
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=table, special_tokens={}), sizes


def read_ranks(path: str) -> bytes:
    """A file of byte-level ranks, read on the driver and sent along with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def section_starts(raw: bytes) -> tuple[list[int], list[str]]:
    """Byte starts and kinds of the sections of a text.

    The first line is the title where other lines follow; of those, a line with a ``|`` is a table row, a
    blank line is a gap, every other line is body.  Neighbouring lines of one kind form one section.
    """
    starts, kinds, at = [], [], 0
    lines = raw.split(b"\n")
    for k, line in enumerate(lines):
        if k == 0 and len(lines) > 1:
            kind = "title"
        elif b"|" in line:
            kind = "table"
        else:
            kind = "body" if line.strip() or len(lines) == 1 else "gap"
        if not kinds or kind != kinds[-1]:
            starts.append(at)
            kinds.append(kind)
        at += len(line) + 1
    if len(starts) > 1 and starts[-1] >= len(raw):  # a last line break opens no section
        starts.pop()
        kinds.pop()
    return starts, kinds


def attribute(sizes: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens per section: ``sizes`` are token lengths in bytes, ``bounds`` section starts and the end."""
    n = len(bounds) - 1
    ends = np.cumsum(sizes)
    begins = ends - sizes
    own = np.searchsorted(bounds[1:-1], begins, "right")
    if rule == "start":
        return np.bincount(own, minlength=n).astype(float)
    last = np.searchsorted(bounds[1:-1], ends - 1, "right")
    out = np.bincount(own[own == last], minlength=n).astype(float)
    for t in np.flatnonzero(own != last):
        cover = np.diff(np.clip(bounds[own[t] : last[t] + 2], begins[t], ends[t]))
        if rule == "share":
            out[own[t] : last[t] + 1] += cover / sizes[t]
        else:
            out[own[t] + int(np.argmax(cover))] += 1
    return out


def section_tokens(docs: DataFrame, ranks: bytes, pattern: str, rule: str = "most") -> DataFrame:
    """doc_id, section (0, 1, ...), kind, start, end, n_tokens and n_crossing for every section of every text."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    schema = pa.schema([("section", pa.int32()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.float64()), ("n_crossing", pa.int64())])

    def run(batches):
        encoding, lengths = _encoding(ranks, pattern)
        for batch in batches:
            for first, end, data, starts in pieces(batch.column("text")):
                of, out = [], [[] for _ in schema]
                for row in range(end - first):
                    raw = bytes(data[starts[row] : starts[row + 1]])
                    sizes = lengths[np.array(encoding.encode_ordinary(raw.decode()), np.int64)]
                    begin, kinds = section_starts(raw)
                    bounds = np.array([*begin, len(raw)])
                    counts = attribute(sizes, bounds, rule)
                    ends = np.cumsum(sizes)
                    inner = bounds[1:-1]
                    crossing = np.zeros(len(kinds), np.int64)
                    if len(inner) and len(ends):
                        crossing[1:] = ends[np.searchsorted(ends, inner, "left")] - sizes[np.searchsorted(ends, inner, "left")] < inner
                        crossing[1:] &= ends[np.searchsorted(ends, inner, "left")] > inner
                    points = np.concatenate([[0], np.cumsum((data[starts[row] : starts[row + 1]] & 0xC0) != 0x80)])[bounds]
                    of += [first + row] * len(kinds)
                    for column, values in zip(out, (range(len(kinds)), kinds, points[:-1], points[1:], counts, crossing)):
                        column.extend(values)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(of, pa.int64())), *(pa.array(c, f.type) for c, f in zip(out, schema))], ["doc_id", *schema.names])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, section int, kind string, start bigint, end bigint, n_tokens double, n_crossing bigint")
