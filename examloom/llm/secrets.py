"""Secret scans: fixed patterns, and a battery of randomness tests with control of false discoveries.

Base spans come from three patterns.  Beside them runs of the base64 alphabets are searched for candidates of 20
or more characters: a run is split at every ``=`` that is not padding at its end, and in each part these are
candidates of their own:

* the longest stretches of every alphabet, and of letters and digits with one of ``+ / - _`` (so what a run holds
  between slashes, underscores or dashes is tested apart too),
* stretches with separators once more without plain words at their front, and at both ends.

The encoding of a candidate is inferred from its characters, and three tests ask whether it looks like
independent uniform draws from that alphabet:

* chi-squared of the symbol counts,
* runs above and below the middle of the alphabet,
* serial correlation of neighbouring symbols.

A candidate that fails one of them is text.  For the others the question is turned round: how likely is it
that ordinary text of this length, with the letter frequencies of the whole corpus, comes out so even?  These
p-values are judged per encoding and length class by the Benjamini-Hochberg rule over all candidates of the
corpus, so short runs need a smaller value where there are many of them.  Of found candidates inside one another
the widest is given.

Edge cases: a null text is empty.  Texts of any length are scanned whole.  Null and repeated ids are kept, one
result per row.  An empty table gives an empty result.  Other columns are not read by ``scan``; ``redact``
keeps them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examloom.functions.storage import checkpointed
from examloom.llm.bytes import pieces

# The base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "random")

SHORTEST = 20  # characters of a candidate
REJECT_RANDOM = 0.001  # level of each test of the battery
FALSE_DISCOVERIES = 0.01  # share of text among the spans that the method adds, per encoding and length class

_HEX = "0123456789abcdef"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ALNUM = _UPPER + _UPPER.lower() + "0123456789"
#: Alphabets from narrow to wide; the first that holds all characters of a run is its encoding.
ENCODINGS = {"hex": _HEX, "HEX": _HEX.upper(), "base32": _UPPER + "234567", "base62": _ALNUM, "base64": _ALNUM + "+/", "base64url": _ALNUM + "-_"}


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_RUN, _HEX_RUN = _table(_ALNUM + "+/_=-"), _table(_HEX)
_RANK = {name: {c: i for i, c in enumerate(sorted(chars))} for name, chars in ENCODINGS.items()}

#: What a candidate may consist of, and plain words with separators at the front of a stretch (or the end, turned round).
_STRETCHES = [re.compile(f"[{re.escape(chars)}]{{{SHORTEST},}}") for chars in dict.fromkeys([*ENCODINGS.values(), *(_ALNUM + c for c in "+/-_")])]
_FRONT = re.compile(r"(?:(?:[A-Z]?[a-z]+|[A-Z]+)?[+/_-]+)+")
_BACK = re.compile(r"(?:(?:[a-z]+[A-Z]?|[A-Z]+)?[+/_-]+)+")

_SPAN = "array<struct<kind:string,start:int,end:int>>"
_CANDIDATE = "array<struct<start:int,end:int,encoding:string,n:int,chi:double>>"
_SCANNED = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()), ("n", pa.int32()), ("chi", pa.float64())])
_FOUND = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _runs(data: np.ndarray, starts: np.ndarray, member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of at least ``least`` member bytes; a run never crosses rows."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[:-1] = member[data]
    edges = np.flatnonzero(np.diff(inside, prepend=np.int8(0)))
    begins, ends = edges[::2], edges[1::2]
    long = ends - begins >= least
    begins, ends = begins[long], ends[long]
    out = []
    for b, e in zip(begins.tolist(), ends.tolist()):
        cuts = starts[(starts > b) & (starts < e)].tolist()
        bounds = [b, *cuts, e]
        out += [(x, y) for x, y in zip(bounds, bounds[1:]) if y - x >= least]
    return np.array([x for x, _ in out], np.int64), np.array([y for _, y in out], np.int64)


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared_tail(x: float, df: int) -> float:
    """Upper tail of the chi-squared distribution by the cube-root approximation."""
    return _normal_tail(((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def candidates(run: str) -> list[tuple[int, int]]:
    """Bounds in ``run`` of the stretches to test; padding at the end of the run belongs to those that reach it."""
    size, out = len(run.rstrip("=")), set()
    for part in re.finditer("[^=]+", run):
        if part.end() - part.start() < SHORTEST:
            continue
        for pattern in _STRETCHES:
            for m in pattern.finditer(run, part.start(), part.end()):
                b, e = m.span()
                front = _FRONT.match(run, b, e)
                back = _BACK.match(m[0][::-1])
                low, high = front.end() if front else b, e - back.end() if back else e
                out.update((x, len(run) if y == size else y) for x, y in ((b, e), (low, e), (low, high)) if y - x >= SHORTEST)
    return sorted(out)


def battery(run: str) -> tuple[str, float, float] | None:
    """Encoding, chi-squared value and smallest p-value of the three tests; None if no encoding fits."""
    body = run.rstrip("=")
    name = next((k for k, ranks in _RANK.items() if all(c in ranks for c in body)), None)
    if name is None or len(body) < SHORTEST:
        return None
    ranks = np.array([_RANK[name][c] for c in body])
    n, size = len(ranks), len(_RANK[name])
    counts = np.bincount(ranks, minlength=size)
    chi = float((counts.astype(float) ** 2).sum() * size / n - n)
    p_chi = chi_squared_tail(chi, size - 1)
    high = ranks >= size / 2
    a, b = int(high.sum()), int(n - high.sum())
    if a == 0 or b == 0:
        p_runs = 2.0 ** (1 - n)
    else:
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = 1 + int((high[1:] != high[:-1]).sum())
        p_runs = 2 * _normal_tail(max(0.0, abs(runs - mean) - 0.5) / math.sqrt(max(var, 1e-9)))
    centred = ranks - ranks.mean()
    power = float((centred**2).sum())
    r = float((centred[1:] * centred[:-1]).sum()) / power if power else 1.0
    p_serial = 2 * _normal_tail(abs(r + 1 / n) * math.sqrt(n))
    return name, chi, min(p_chi, p_runs, p_serial)


def text_p_value(encoding: str, n: int, chi: float, frequencies: dict[str, float]) -> float:
    """How likely text with these letter frequencies is to be as even as ``chi`` says, over ``n`` characters.

    Normal approximation with the mean and variance that the sum of squared counts has for n draws.
    """
    chars = ENCODINGS[encoding]
    one_case = chars.lower() == chars or chars.upper() == chars  # text in one case has the letters of both
    q = np.array([sum(frequencies.get(x, 0.0) for x in ({c.lower(), c.upper()} if one_case else {c})) for c in chars])
    q = q / q.sum() if q.sum() else np.full(len(chars), 1 / len(chars))
    s2, s3 = float((q**2).sum()), float((q**3).sum())
    size = len(chars)
    mean = size * (1 + (n - 1) * s2) - n
    pairs = n * (n - 1)
    var = (size / n) ** 2 * (2 * pairs * (s2 - s2**2) + 4 * pairs * (n - 2) * (s3 - s2**2))
    return _normal_tail((mean - chi) / math.sqrt(max(var, 1e-9)))


def _length_class(n: int) -> int:
    return int(math.log2(n) * 2)


def _log_bin(p: float) -> int:
    """-10 log10 p, rounded down: the binned value is never smaller than p, which keeps the rule valid."""
    return int(min(3000.0, -10 * math.log10(max(p, 1e-300))))


def _scan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("text")
        for first, end, data, starts in pieces(column):
            base: list[list] = [[] for _ in range(first, end)]
            found: list[list] = [[] for _ in range(first, end)]
            texts: dict[int, str] = {}

            def text_of(row: int, at=first, column=column, texts=texts) -> str:
                if row not in texts:
                    texts[row] = column[at + row].as_py() or ""
                return texts[row]

            def place(row: int, b: int, e: int, data=data, starts=starts) -> tuple[int, int]:
                lead = len(bytes(data[starts[row] : b]).decode())
                return lead, lead + e - b

            for b, e in zip(*_runs(data, starts, _HEX_RUN, 32)):
                row = int(np.searchsorted(starts, b, "right")) - 1
                x, y = place(row, b, e)
                base[row].append({"kind": "hex", "start": x, "end": y})
            for b, e in zip(*_runs(data, starts, _RUN, SHORTEST)):
                row = int(np.searchsorted(starts, b, "right")) - 1
                run, at = bytes(data[b:e]).decode(), None
                for low, high in candidates(run):
                    tested = battery(run[low:high])
                    if tested and tested[2] >= REJECT_RANDOM:
                        at = place(row, b, e)[0] if at is None else at
                        found[row].append({"start": at + low, "end": at + high, "encoding": tested[0], "n": high - low, "chi": tested[1]})
            for row in range(end - first):
                raw = bytes(data[starts[row] : starts[row + 1]])
                lower = raw.lower()
                if b"AKIA" in raw:
                    base[row] += [{"kind": "access", "start": m.start(), "end": m.end()} for m in ACCESS.finditer(text_of(row)) if m.end() - m.start() >= 16]
                if any(w.encode() in lower for w in ASSIGN_WORDS):
                    base[row] += [{"kind": "assign", "start": m.start(), "end": m.end()} for m in ASSIGN.finditer(text_of(row)) if len(m[2]) >= 8]
            counts = [None] * (end - first)
            counts[0] = np.bincount(data, minlength=256)[:128].tolist()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(first, end - first) for c in batch.schema.names if c != "text"),
                 pa.array(base, pa.list_(_FOUND)), pa.array(found, pa.list_(_SCANNED)), pa.array(counts, pa.list_(pa.int64()))],
                [*(c for c in batch.schema.names if c != "text"), "base", "found", "counts"])


def _frequencies(scanned: DataFrame) -> dict[str, float]:
    """Letter frequencies of the corpus; at most 128 rows reach the driver."""
    rows = scanned.select(F.posexplode("counts").alias("c", "n")).groupBy("c").agg(F.sum("n").alias("n")).collect()
    return {chr(r["c"]): float(r["n"]) for r in rows}


def _limits(scanned: DataFrame, frequencies: dict[str, float]) -> dict[tuple[str, int], int]:
    """The least -10 log10 p that counts as a discovery, per encoding and length class.

    The p-values meet as counts per bin, at most 3000 for each of some hundred classes.
    """

    def binned(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pylist(
                [{"encoding": r["encoding"], "class": _length_class(r["n"]), "bin": _log_bin(text_p_value(r["encoding"], r["n"], r["chi"], frequencies))} for r in rows],
                pa.schema([("encoding", pa.string()), ("class", pa.int32()), ("bin", pa.int32())]))

    rows = (scanned.select(F.inline("found")).select("encoding", "n", "chi")
            .mapInArrow(binned, "encoding string, class int, bin int").groupBy("encoding", "class", "bin").agg(F.count("*").alias("n")).collect())
    by_class: dict[tuple[str, int], list] = {}
    for r in rows:
        by_class.setdefault((r["encoding"], r["class"]), []).append((r["bin"], r["n"]))
    out = {}
    for key, bins in by_class.items():
        total, seen = sum(n for _, n in bins), 0
        for b, n in sorted(bins, reverse=True):
            seen += n
            if 10 ** (-b / 10) <= FALSE_DISCOVERIES * seen / total:
                out[key] = b
    return out


def _deciding(frequencies, limits):
    def added(found: list[dict]) -> list[dict]:
        out, reached = [], -1
        for c in sorted(found, key=lambda c: (c["start"], -c["end"])):
            if c["end"] <= reached:  # inside one that was found
                continue
            limit = limits.get((c["encoding"], _length_class(c["n"])))
            if limit is not None and _log_bin(text_p_value(c["encoding"], c["n"], c["chi"], frequencies)) >= limit:
                out.append({"kind": "random", "start": c["start"], "end": c["end"]})
                reached = c["end"]
        return out

    return added


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end in code points) for every document.

    ``base`` are the pattern spans; ``spans`` adds those of the battery.  Both are ordered by start, then kind.
    """
    scanned = checkpointed(docs.select("doc_id", "text").mapInArrow(
        _scan_rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {_SPAN}, found {_CANDIDATE}, counts array<bigint>"))
    frequencies = _frequencies(scanned)
    added = _deciding(frequencies, _limits(scanned, frequencies))

    def decided(batches):
        for batch in batches:
            base, found = batch.column("base").to_pylist(), batch.column("found").to_pylist()
            order = lambda s: (s["start"], KINDS.index(s["kind"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([sorted(b, key=order) for b in base], pa.list_(_FOUND)),
                 pa.array([sorted(b + added(f), key=order) for b, f in zip(base, found)], pa.list_(_FOUND))], ["doc_id", "base", "spans"])

    return scanned.select("doc_id", "base", "found").mapInArrow(
        decided, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {_SPAN}, spans {_SPAN}")


def joined(spans) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The same rows and columns with every span of ``scan`` replaced by ``mark``; n_chars follows if present.

    Two passes: letter frequencies and limits come from a first scan, the second scans each text again and cuts
    it there, so no text is shuffled to meet its spans.  Overlapping spans give one mark.
    """
    scanned = checkpointed(docs.select("text").mapInArrow(_scan_rows, f"base {_SPAN}, found {_CANDIDATE}, counts array<bigint>"))
    frequencies = _frequencies(scanned)
    added = _deciding(frequencies, _limits(scanned, frequencies))

    def cut(batches):
        for batch in batches:
            texts, row = batch.column("text").to_pylist(), 0
            for part in _scan_rows(iter([pa.RecordBatch.from_arrays([batch.column("text")], ["text"])])):
                for base, found in zip(part.column("base").to_pylist(), part.column("found").to_pylist()):
                    spans = sorted((s["start"], s["end"]) for s in base + added(found))
                    if spans:
                        text, out, at = texts[row], [], 0
                        for b, e in spans:
                            if b >= at:
                                out += [text[at:b], mark]
                            at = max(at, e)
                        texts[row] = "".join(out) + text[at:]
                    row += 1
            yield batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), pa.array(texts, batch.schema.field("text").type))

    out = docs.mapInArrow(cut, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

