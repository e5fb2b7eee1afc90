"""Suffix-array dedup: maximal repeats across documents, and removal of repeated bytes.

The suffixes of a large corpus do not fit one array, so they are sampled by content first:

1. Texts are packed into chunks of some megabytes and stored in the shared folder.
2. Every 50-byte string owns an anchor: the 26-byte string in it with the smallest hash, the leftmost of equals.
   Equal strings own equal anchors.  Chunks send the hashes of their anchors to buckets, five bytes each, and
   learn which of them other chunks have too.
3. Consecutive strings with the same anchor form a tile (50 to 74 bytes).  Tiles of repeated anchors go to
   buckets by anchor, equal tiles of a chunk once, with their smallest document.  A bucket builds an enhanced
   suffix array over the suffixes of its tiles (sorted suffixes, lengths of common prefixes, preceding bytes)
   and scans it with a stack.  The scan gives the tree of common-prefix intervals.
4. The tree says for every suffix whether a smaller document holds its first 50 bytes.  Chunks turn the answers
   into removed stretches.

Maximal repeats (``repeat_groups``) may be longer than a tile.  For them buckets tell the chunks which 50-byte
strings two documents hold, and which of these follow different bytes: only there a maximal repeat may begin.  Chunks
send the suffixes from there on, up to the end of the stretch of such strings, to the bucket of their first string.
The bucket sorts them whole and scans them with the same stack: every interval is a repeat with all its occurrences,
maximal to the left if the preceding bytes differ.

An anchor that very many chunks share sends its strings one by one, each to the bucket of its own hash and
once per chunk, so no bucket gathers the surroundings of a frequent passage.  Both ways give the same result.

Edge cases: a null text is empty; texts below 50 bytes stay whole.  Texts of any length are taken whole.  Null
ids sort last and count as one document; rows with the same id do not cover each other.  An empty table gives an
empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examloom.functions.storage import checkpointed
from examloom.llm.bytes import mixed, pieces, prefix_hash, span_hash

LENGTH, ANCHOR = 50, 26
REACH = LENGTH - ANCHOR + 1  # anchors per string, and strings per tile at most
#: Chunks that share an anchor before its strings travel one by one.
FREQUENT = 2000
#: Bytes of text per chunk, about; a longer text is a chunk of its own.
CHUNK = 2 << 20
#: Bytes of text per bucket, about.
BUCKET = 8 << 20
_LAST = np.iinfo(np.int64).max  # stands for a null id
_CODEC = pa.Codec("zstd", compression_level=3)


def _pack(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _unpack(packed: bytes) -> bytes:
    return _CODEC.decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)


# Chunks


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        known = np.asarray(ids.is_valid())
        numbers = np.asarray(ids.cast(pa.int64()).fill_null(_LAST))
        for first, end, data, starts in pieces(batch.column("text"), CHUNK):
            yield pa.RecordBatch.from_arrays(
                [pa.array([numbers[first:end].tobytes()], pa.binary()), pa.array([known[first:end].tobytes()], pa.binary()),
                 pa.array([starts.tobytes()], pa.binary()), pa.array([_pack(data.tobytes())], pa.binary()), pa.array([len(data)], pa.int64())],
                ["ids", "known", "starts", "data", "n_bytes"])


class Chunk:
    """Texts of one chunk with their tiles."""

    def __init__(self, row: dict):
        self.ids, self.known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool)
        self.starts = np.frombuffer(row["starts"], np.int64)
        self.data = np.frombuffer(_unpack(row["data"]), np.uint8)
        self.prefix = prefix_hash(self.data)
        self.first, self.count, self.anchor, self.doc = self._tiles()

    def _tiles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per tile: first string start, number of strings, hash of the anchor, row of the document."""
        n = len(self.data) - LENGTH + 1
        if n <= 0:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, np.uint64), none
        at = np.arange(len(self.data) - ANCHOR + 1)
        grams = span_hash(self.prefix, at, at + ANCHOR)
        key = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
        least, span = key, 1
        while span * 2 <= REACH:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[:n], least[REACH - span : REACH - span + n])
        owner = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        doc = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        inside = doc[:n] == doc[LENGTH - 1 :]
        new = np.ones(n, bool)
        new[1:] = (owner[1:] != owner[:-1]) | ~inside[:-1] | (doc[1:n] != doc[: n - 1])
        first = np.flatnonzero(new & inside)
        last = np.ones(n, bool)
        last[:-1] = new[1:] | ~inside[1:]
        end = np.flatnonzero(last & inside)
        return first, end - first + 1, grams[owner[first]], doc[first]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors in order, the place of every tile's, and whether two documents here share it."""
        distinct, place = np.unique(self.anchor, return_inverse=True)
        ids = self.ids[self.doc]
        low, high = np.full(len(distinct), _LAST), np.full(len(distinct), -_LAST)
        np.minimum.at(low, place, ids)
        np.maximum.at(high, place, ids)
        return distinct, place, low < high

    def cut(self, tiles: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, ...]:
        """Records of the tiles: first start, number of strings, key, document; frequent tiles string by string."""
        whole, single = tiles[~frequent], tiles[frequent]
        start = np.repeat(self.first[single] - np.concatenate([[0], np.cumsum(self.count[single])[:-1]]).astype(np.int64) if len(single) else single, self.count[single])
        start = start + np.arange(len(start))
        first = np.concatenate([self.first[whole], start]).astype(np.int64)
        count = np.concatenate([self.count[whole], np.ones(len(start), np.int64)])
        key = np.concatenate([self.anchor[whole], span_hash(self.prefix, start, start + LENGTH)])
        return first, count, key, np.concatenate([self.doc[whole], np.repeat(self.doc[single], self.count[single])]).astype(np.int64)

    def before(self, first: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The byte before each start, -1 at the start of a document."""
        edge = first == self.starts[doc]
        return np.where(edge, -1, self.data[np.maximum(first - 1, 0)].astype(np.int16)).astype(np.int16)


def _bucketed(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by bucket, and (bucket, from, to) for the buckets in use."""
    own = keys % np.uint64(buckets)
    order = np.argsort(own, kind="stable")
    used, at = np.unique(own[order], return_index=True)
    return order, list(zip(used.tolist(), at.tolist(), [*at[1:].tolist(), len(order)]))


# Anchors


def _anchor_rows(buckets: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                distinct, _, _ = chunk.anchors()
                order, parts = _bucketed(distinct, buckets)
                low = np.ascontiguousarray(distinct[order] >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["chunk"]] * len(parts), pa.int64()), pa.array([p[0] for p in parts], pa.int64()),
                     pa.array([low[a:b].tobytes() for _, a, b in parts], pa.binary())], ["chunk", "bucket", "hashes"])

    return run


def _per_bucket(work):
    """Rows arrive sorted by bucket; hand them over bucket by bucket."""

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["bucket"] != held[0]["bucket"]:
                    yield from work(held)
                    held = []
                held.append(row)
        if held:
            yield from work(held)

    return run


def _shared_anchors(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """Per sent hash 0, 1 (other chunks have it) or 2 (very many have it)."""
    parts = [np.frombuffer(r["hashes"], np.uint8).reshape(-1, 5) for r in rows]
    values = np.zeros((sum(map(len, parts)), 8), np.uint8)
    values[:, :5] = np.concatenate(parts)
    _, place, n = np.unique(values.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
    state = ((n > 1).astype(np.uint8) + (n > FREQUENT).astype(np.uint8))[place]
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r["chunk"] for r in rows], pa.int64()), pa.array([r["bucket"] for r in rows], pa.int64()),
         pa.array([_pack(s.tobytes()) for s in np.split(state, cuts)], pa.binary())], ["chunk", "bucket", "reply"])


# Tiles


def _selected(chunk: Chunk, replies: list[dict]) -> tuple[np.ndarray, ...]:
    """Records of all tiles whose anchor another document may have, in a fixed order."""
    distinct, place, here = chunk.anchors()
    state = np.zeros(len(distinct), np.uint8)
    if len(distinct):
        replies = sorted(replies, key=lambda r: r["bucket"])
        order = np.argsort(distinct % np.uint64(replies[0]["buckets"]), kind="stable")
        state[order] = np.frombuffer(b"".join(_unpack(r["reply"]) for r in replies), np.uint8)
    tiles = np.flatnonzero((state[place] > 0) | here[place])
    return chunk.cut(tiles, state[place[tiles]] == 2)


def _classes(chunk: Chunk, records: tuple[np.ndarray, ...], merge: bool) -> tuple[np.ndarray, np.ndarray]:
    """Records to send (of equal ones that of the smallest document), and for every record its place among them."""
    first, count, _, doc = records
    content = span_hash(chunk.prefix, first, first + count + LENGTH - 1)
    content = mixed(content + (chunk.before(first, doc).astype(np.int64) + 2).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + count.astype(np.uint64))
    if not merge:
        return np.arange(len(first)), np.arange(len(first))
    order = np.lexsort((first, chunk.ids[doc], content))
    lead = np.ones(len(order), bool)
    lead[1:] = content[order][1:] != content[order][:-1]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(lead) - 1
    return order[lead], place


def _tile_rows(buckets: int, merge: bool):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                records = _selected(chunk, row["replies"])
                first, count, key, doc = records
                sent, _ = _classes(chunk, records, merge)
                order, parts = _bucketed(key[sent], buckets)
                out = []
                for bucket, a, b in parts:
                    own = sent[order[a:b]]
                    size = count[own] + LENGTH - 1
                    ends = np.cumsum(size)
                    data = chunk.data[np.repeat(first[own] - (ends - size), size) + np.arange(ends[-1])]
                    place = first[own] - chunk.starts[doc[own]]
                    out.append((bucket, _pack(data.tobytes()), count[own].astype(np.uint8).tobytes(), _pack(chunk.before(first[own], doc[own]).tobytes()),
                                _pack(chunk.ids[doc[own]].tobytes()), _pack(place.tobytes()) if not merge else b""))
                columns = list(zip(*out)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["chunk"]] * len(out), pa.int64()), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                    ["chunk", "bucket", "data", "count", "before", "ids", "place"])

    return run


def interval_tree(common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals (from, to, length) of a suffix array: ``common[i]`` is the common prefix of suffixes i-1 and i.

    A stack scan: an interval opens where the common prefix grows and closes where it shrinks.  Only lengths of
    ``least`` or more count; an interval comes before those that hold it.
    """
    low, high, length = [], [], []
    stack: list[tuple[int, int]] = []  # (from, length)
    values = common.tolist()
    values.append(0)
    for i in range(1, len(values)):
        c, start = values[i], i - 1
        while stack and stack[-1][1] > c:
            start, own = stack.pop()
            low.append(start)
            high.append(i)
            length.append(own)
        if c >= least and (not stack or stack[-1][1] < c):
            stack.append((start, c))
    return np.array(low, np.int64), np.array(high, np.int64), np.array(length, np.int64)


class SuffixArray:
    """Suffixes of distinct tiles, sorted so that those with equal first 50 bytes are neighbours, then by the rest."""

    def __init__(self, data: np.ndarray, first: np.ndarray, count: np.ndarray):
        self.data, self.tile = data, np.repeat(np.arange(len(first)), count)
        before = np.cumsum(count) - count
        inner = np.arange(len(self.tile)) - before[self.tile]  # string number in its tile
        self.at = first[self.tile] + inner
        self.inner = inner
        self.rest = count[self.tile] - 1 - inner  # bytes beyond the first 50
        root = span_hash(prefix_hash(data), self.at, self.at + LENGTH)
        order = np.argsort(root, kind="stable")
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = root[order][1:] == root[order][:-1]
        multiple = order[same[:-1] | same[1:]]
        #: Suffixes that no other tile shares, and the sorted array of the others.
        self.alone = order[~(same[:-1] | same[1:])]
        width = REACH - 1
        tail = np.minimum(self.at[multiple, None] + LENGTH + np.arange(width), len(data) - 1)
        tail = data[tail].astype(np.uint16) + 1
        tail[np.arange(width) >= self.rest[multiple, None]] = 0
        keys = [tail[:, k] for k in range(width - 1, -1, -1)]
        self.order = multiple[np.lexsort((*keys, root[multiple]))] if len(multiple) else multiple
        self.common = self._common(root)

    def _common(self, root: np.ndarray) -> np.ndarray:
        """Common prefix of every suffix with the one before; 0 below 50 bytes."""
        o = self.order
        out = np.zeros(len(o), np.int64)
        if len(o) < 2:
            return out
        a, b = o[:-1], o[1:]
        limit = np.minimum(self.rest[a], self.rest[b]) + LENGTH
        equal = root[a] == root[b]
        length = np.zeros(len(a), np.int64)
        for k in range(LENGTH + REACH - 1):
            hi = len(self.data) - 1
            equal = equal & (k < limit) & (self.data[np.minimum(self.at[a] + k, hi)] == self.data[np.minimum(self.at[b] + k, hi)])
            length += equal
        out[1:] = np.where(length >= LENGTH, length, 0)
        return out


def _bucket_tiles(rows: list[dict]) -> tuple:
    """All records of a bucket: bytes, starts, counts, preceding bytes, documents, and records per row."""
    count = [np.frombuffer(r["count"], np.uint8).astype(np.int64) for r in rows]
    data = np.frombuffer(b"".join(_unpack(r["data"]) for r in rows), np.uint8)
    before = np.concatenate([np.frombuffer(_unpack(r["before"]), np.int16) for r in rows])
    ids = np.concatenate([np.frombuffer(_unpack(r["ids"]), np.int64) for r in rows])
    sizes = [len(c) for c in count]
    count = np.concatenate(count)
    size = count + LENGTH - 1
    return data, np.cumsum(size) - size, count, before, ids, sizes


def _merged(data, first, count, before) -> tuple[np.ndarray, np.ndarray]:
    """A representative record per distinct tile, and the tile of every record."""
    content = mixed(span_hash(prefix_hash(data), first, first + count + LENGTH - 1) + (before.astype(np.int64) + 2).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + count.astype(np.uint64))
    _, lead, tile = np.unique(content, return_index=True, return_inverse=True)
    return lead, tile


def _answers(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """Per sent record a bit for every string that a smaller document holds."""
    data, first, count, before, ids, sizes = _bucket_tiles(rows)
    lead, tile = _merged(data, first, count, before)
    smallest = np.full(len(lead), _LAST)
    np.minimum.at(smallest, tile, ids)
    array = SuffixArray(data, first[lead], count[lead])
    of_suffix = smallest[array.tile]
    low, high, _ = interval_tree(array.common, LENGTH)
    mins = of_suffix[array.order]
    # an interval comes before those that hold it, so the last write to a suffix is that of its widest interval
    for a, b in zip(low.tolist(), high.tolist()):
        mins[a:b] = mins[a:b].min()
    of_suffix[array.order] = mins
    base = np.cumsum(count[lead]) - count[lead]
    bits = np.zeros(len(ids), np.uint32)
    for k in range(int(count.max()) if len(count) else 0):
        has = np.flatnonzero(count > k)
        bits[has] |= (of_suffix[base[tile[has]] + k] < ids[has]).astype(np.uint32) << np.uint32(k)
    cuts = np.cumsum(sizes)[:-1]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r["chunk"] for r in rows], pa.int64()), pa.array([r["bucket"] for r in rows], pa.int64()),
         pa.array([_pack(b.tobytes()) for b in np.split(bits, cuts)], pa.binary())], ["chunk", "bucket", "reply"])


def _marks(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """Per record two bits for every string: two documents hold it (low half); they do after different bytes (high half)."""
    data, first, count, before, ids, sizes = _bucket_tiles(rows)
    tile = np.repeat(np.arange(len(first)), count)
    inner = np.arange(len(tile)) - (np.cumsum(count) - count)[tile]
    at = first[tile] + inner
    left = np.where(inner > 0, data[np.maximum(at - 1, 0)].astype(np.int64), before[tile])
    _, own = np.unique(span_hash(prefix_hash(data), at, at + LENGTH), return_inverse=True)
    n = int(own.max()) + 1
    low, high, least, most = np.full(n, _LAST), np.full(n, -_LAST), np.full(n, 256), np.full(n, -1)
    np.minimum.at(low, own, ids[tile])
    np.maximum.at(high, own, ids[tile])
    np.minimum.at(least, own, left)
    np.maximum.at(most, own, left)
    twice = low < high
    begins = twice & ((least < 0) | (least < most))
    bits = np.zeros(len(ids), np.uint64)
    np.bitwise_or.at(bits, tile, (twice[own].astype(np.uint64) | begins[own].astype(np.uint64) << np.uint64(32)) << inner.astype(np.uint64))
    cuts = np.cumsum(sizes)[:-1]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r["chunk"] for r in rows], pa.int64()), pa.array([r["bucket"] for r in rows], pa.int64()),
         pa.array([_pack(x.tobytes()) for x in np.split(bits, cuts)], pa.binary())], ["chunk", "bucket", "reply"])


def _start_rows(buckets: int):
    """Places where a repeat may begin, to the bucket of their first string, with all bytes that a repeat may hold.

    A repeat in two documents ends where the strings that two documents hold end.  Of such a stretch a bucket
    gets the bytes once, from the first place in it on; equal stretches of a chunk share them.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                first, count, key, doc = _selected(chunk, row["replies"])
                if not len(first):
                    continue
                answers = sorted(row["answers"], key=lambda r: r["bucket"])
                order, _ = _bucketed(key, answers[0]["buckets"])
                bits = np.zeros(len(first), np.uint64)
                bits[order] = np.frombuffer(b"".join(_unpack(r["reply"]) for r in answers), np.uint64)
                twice, begins = np.zeros(len(chunk.data) + 1, bool), np.zeros(len(chunk.data) + 1, bool)
                for k in range(int(count.max())):
                    own = count > k
                    twice[first[own] + k] = bits[own] >> np.uint64(k) & np.uint64(1) == 1
                    begins[first[own] + k] = bits[own] >> np.uint64(k + 32) & np.uint64(1) == 1
                at = np.flatnonzero(begins)
                ends = np.flatnonzero(twice[:-1] & ~twice[1:])  # the last string of a stretch
                end = ends[np.searchsorted(ends, at)] + LENGTH if len(at) else at
                place = np.searchsorted(chunk.starts, at, "right") - 1
                before = chunk.before(at, place)
                order, parts = _bucketed(span_hash(chunk.prefix, at, at + LENGTH), buckets)
                out = []
                for bucket, a, b in parts:
                    own = np.sort(order[a:b])
                    lead = np.ones(len(own), bool)
                    lead[1:] = end[own][1:] != end[own][:-1]
                    head, tail = at[own[lead]], end[own[lead]]
                    _, pick, same = np.unique(span_hash(chunk.prefix, head, tail), return_index=True, return_inverse=True)
                    size = (tail - head)[pick]
                    offset = (np.cumsum(size) - size)[same][np.cumsum(lead) - 1] + at[own] - head[np.cumsum(lead) - 1]
                    data = b"".join(chunk.data[x:y].tobytes() for x, y in zip(head[pick].tolist(), tail[pick].tolist()))
                    out.append((bucket, _pack(data), *(_pack(x.astype(np.int64).tobytes()) for x in (
                        offset, end[own] - at[own], before[own], chunk.ids[place[own]], at[own] - chunk.starts[place[own]]))))
                columns = list(zip(*out)) if out else [[]] * 7
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                    ["bucket", "data", "offset", "size", "before", "ids", "place"])

    return run


def _common_prefix(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Equal bytes from ``a`` and ``b`` on, ``most`` at most: a binary search over hashes."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while (low < high).any():
        half = (low + high + 1) // 2
        same = span_hash(prefix, a, a + half) == span_hash(prefix, b, b + half)
        low, high = np.where(same, half, low), np.where(same, high, half - 1)
    return low


def _groups(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """Maximal repeats that begin in a bucket, whole, with every occurrence."""
    parts = [_unpack(r["data"]) for r in rows]
    shift = np.cumsum([0, *map(len, parts)])
    raw = b"".join(parts)
    read = lambda name: [np.frombuffer(_unpack(r[name]), np.int64) for r in rows]
    at = np.concatenate([o + x for o, x in zip(read("offset"), shift)])
    size, before, ids, place = (np.concatenate(read(name)) for name in ("size", "before", "ids", "place"))
    prefix = prefix_hash(np.frombuffer(raw, np.uint8))
    first = span_hash(prefix, at, at + LENGTH)
    # equal suffixes are sorted once; those with one first string at a time, so that few bytes are copied
    _, lead, own = np.unique(np.stack([first, span_hash(prefix, at, at + size)]), axis=1, return_index=True, return_inverse=True)
    own = own.ravel()
    by_first = lead[np.argsort(first[lead], kind="stable")]
    bounds = [0, *(np.flatnonzero(np.diff(first[by_first])) + 1).tolist(), len(by_first)] if len(by_first) > 1 else [0, len(by_first)]
    rank, n = np.zeros(len(at), np.int64), 0
    for a, b in zip(bounds, bounds[1:]):
        for k in sorted(by_first[a:b].tolist(), key=lambda k: raw[at[k] : at[k] + size[k]]) if b - a > 1 else by_first[a:b].tolist():
            rank[k], n = n, n + 1
    order = np.argsort(rank[lead[own]], kind="stable")
    at, size, before, ids, place = at[order], size[order], before[order], ids[order], place[order]
    common = np.zeros(len(at), np.int64)
    common[1:] = _common_prefix(prefix, at[:-1], at[1:], np.minimum(size[:-1], size[1:]))
    common[common < LENGTH] = 0
    out: list[list] = [[], [], [], []]

    def batch():
        known = [None if d == _LAST else d for d in out[2]]
        return pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(known, pa.int64()), pa.array(out[3], pa.int64())],
            ["repeat", "n_bytes", "doc_id", "start"])

    for a, b, n in zip(*(x.tolist() for x in interval_tree(common, LENGTH))):
        left, docs = before[a:b], ids[a:b]
        if ((left < 0).any() or (left != left[0]).any()) and (docs != docs[0]).any():
            name = hashlib.sha256(raw[at[a] : at[a] + n]).hexdigest()
            for column, values in zip(out, ([name] * (b - a), [n] * (b - a), docs.tolist(), place[a:b].tolist())):
                column.extend(values)
            if len(out[0]) > 100_000:
                yield batch()
                out = [[], [], [], []]
    yield batch()


def _removed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            chunk = Chunk(row)
            records = _selected(chunk, row["replies"])
            first, count, key, doc = records
            sent, place = _classes(chunk, records, True)
            bits = np.zeros(len(sent), np.uint32)
            if len(sent):
                answers = sorted(row["answers"], key=lambda r: r["bucket"])
                order, _ = _bucketed(key[sent], answers[0]["buckets"])
                bits[order] = np.frombuffer(b"".join(_unpack(r["reply"]) for r in answers), np.uint32)
            own = bits[place]
            later = chunk.ids[doc] > chunk.ids[doc[sent]][place] if len(sent) else np.zeros(0, bool)
            own = np.where(later, np.uint32(0xFFFFFFFF), own)
            cover = np.zeros(len(chunk.data) + 1, np.int32)
            for k in range(int(count.max()) if len(count) else 0):
                at = first[(count > k) & ((own >> np.uint32(k)) & 1 == 1)] + k
                np.add.at(cover, at, 1)
                np.add.at(cover, at + LENGTH, -1)
            gone = np.cumsum(cover[:-1]) > 0
            n = len(chunk.starts) - 1
            out: list[list] = [[], [], [], [], []]
            for d in range(n):
                a, b = chunk.starts[d], chunk.starts[d + 1]
                g = gone[a:b]
                edges = np.flatnonzero(np.diff(g.astype(np.int8), prepend=0, append=0))
                kept = chunk.data[a:b][~g] if len(edges) else chunk.data[a:b]
                for column, value in zip(out, (int(b - a), int(g.sum()), len(edges) // 2, kept.tobytes(), edges.tolist())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunk.ids, pa.int64(), mask=~chunk.known), *(pa.array(c, pa.int64()) for c in out[:3]),
                 pa.array(out[3], pa.binary()), pa.array(out[4], pa.list_(pa.int64()))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "edges"])


_CHUNK = "ids binary, known binary, starts binary, data binary, n_bytes bigint"
_TILES = "chunk bigint, bucket bigint, data binary, count binary, before binary, ids binary, place binary"
_STARTS = "bucket bigint, data binary, offset binary, size binary, before binary, ids binary, place binary"


def _exchange(rows: DataFrame, work, schema: str) -> DataFrame:
    """Bring the rows of a bucket together and work on them."""
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_per_bucket(work), schema)


def _back(replies: DataFrame, buckets: int, name: str) -> DataFrame:
    """One row per chunk with all its replies."""
    return replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "reply", F.lit(buckets).alias("buckets"))).alias(name))


def _prepared(docs: DataFrame, merge: bool) -> tuple[DataFrame, DataFrame, int]:
    """Chunks with the replies about their anchors; the records of their tiles; the number of buckets."""
    chunks = docs.select("doc_id", "text").mapInArrow(_chunk_rows, _CHUNK)
    chunks = checkpointed(chunks.withColumn("chunk", F.monotonically_increasing_id()))
    total = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = max(64, -(-total // BUCKET))
    sent = chunks.mapInArrow(_anchor_rows(buckets), "chunk bigint, bucket bigint, hashes binary")
    shared = _exchange(sent, _shared_anchors, "chunk bigint, bucket bigint, reply binary")
    told = checkpointed(_back(shared, buckets, "replies"))
    with_replies = chunks.join(told, "chunk", "left")
    return with_replies, with_replies.mapInArrow(_tile_rows(buckets, merge), _TILES), buckets


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and edges of every document.

    A byte is removed if a 50-byte string that covers it also starts in a document with a smaller id, in the
    text as it came.  ``edges`` are the bounds of the removed stretches, from and to in turn.
    """
    chunks, tiles, buckets = _prepared(docs, merge=True)
    answers = _back(_exchange(tiles, _answers, "chunk bigint, bucket bigint, reply binary"), buckets, "answers")
    # in one plan with the tiles, so that the chunks are shuffled once and read twice
    return chunks.join(answers, "chunk", "left").mapInArrow(
        _removed_rows, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, edges array<bigint>")


def repeat_groups(docs: DataFrame) -> DataFrame:
    """repeat (SHA-256 of its bytes), n_bytes, doc_id, start: every occurrence of every maximal repeat.

    Repeats are those of 50 bytes or more, of any length, in two or more documents, whose occurrences differ in
    the byte before and in the byte after them (an end of a text differs from everything).
    """
    chunks, tiles, buckets = _prepared(docs, merge=False)
    marks = _back(_exchange(tiles, _marks, "chunk bigint, bucket bigint, reply binary"), buckets, "answers")
    starts = chunks.join(marks, "chunk", "left").mapInArrow(_start_rows(buckets), _STARTS)
    return _exchange(starts, _groups, "repeat string, n_bytes bigint, doc_id bigint, start bigint")
