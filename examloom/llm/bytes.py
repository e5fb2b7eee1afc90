"""Array helpers for tasks: whole texts as UTF-8 bytes, words, and hashes of words and shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken together until they reach this many bytes; a longer text is taken alone, whole.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row starts (one more for the end); nulls are empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32) if column.buffers()[1] else np.zeros(1, np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, bytes and starts of runs of rows that together hold about ``limit`` bytes."""
    data, starts = text_buffers(column)
    first, n = 0, len(starts) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(starts, starts[first] + limit, "right")) - 1)
        end = min(end, n)
        yield first, end, data[starts[first] : starts[end]], starts[first : end + 1] - starts[first]
        first = end


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n at least of the hash base, and of its inverse; the longest tables so far are kept."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(PIECE, n) + 1
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size + 1, base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[:] = tables
    return _POWERS[0], _POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial; ``span_hash`` reads the hash of any stretch from it."""
    out = np.zeros(len(data) + 1, np.uint64)
    values = data.astype(np.uint64)
    values += np.uint64(1)
    values *= powers(len(data))[0][: len(data)]
    np.cumsum(values, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of bytes other than ASCII white space; a word never crosses texts."""
    solid = np.ones(len(data) + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(_SPACE[data], out=solid[1:-1])
    begins, ends = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    cuts = starts[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] |= solid[1:-1][cuts]
    ends[cuts - 1] |= solid[1:-1][cuts - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash per word, and the row of each word."""
    s, e = word_spans(data, starts)
    return span_hash(prefix_hash(data), s, e), np.searchsorted(starts, s, "right") - 1


def shingle_hashes(data: np.ndarray, starts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A hash per run of ``size`` words inside a row, and its row; a row with fewer words is one shingle.

    A row without words has none.
    """
    words, rows = word_hashes(data, starts)
    n = len(words)
    if n == 0:
        return words, rows
    first, counts = np.unique(rows, return_index=True)[1], np.unique(rows, return_counts=True)[1]
    total = np.zeros(n, np.uint64)
    for k in range(min(size, n)):
        stretch = words[k:] * np.uint64(pow(_BASE, k + 1, 1 << 64))
        total[: n - k] += stretch
    whole = np.zeros(n, bool)
    if n >= size:
        whole[: n - size + 1] = rows[: n - size + 1] == rows[size - 1 :]
    for i in np.flatnonzero(counts < size):  # short rows
        at = first[i]
        value = np.uint64(counts[i])
        with np.errstate(over="ignore"):
            for w in words[at : at + counts[i]]:
                value = value * np.uint64(_BASE) + w
        total[at], whole[at] = value, True
    return mixed(total[whole]), rows[whole]
