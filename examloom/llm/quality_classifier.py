"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

1. Random indexing.  A word owns a sparse random index vector (``NONZERO`` entries of +1 or -1 out of ``DIM``,
   drawn from its hash).  Its context vector is the sum of the index vectors of its neighbours up to ``REACH``
   words away, over all occurrences in all documents.  Words are folded into ``ROWS`` rows by hash, so the table
   has a fixed size (``ROWS`` x ``DIM`` integers, 1 MB) whatever the corpus, and may be sent to every task.  Beside
   each word its shape (case, marks at its end, length, equality with an earlier word nearby) takes part as a
   second word.
2. Pooling.  A document is the mean of the unit context vectors of its words, the mean of those of its shapes,
   the spread of both, and its length on a log scale.
3. A network with one hidden layer, trained with numpy on the driver on at most ``SAMPLE`` labelled documents
   (chosen by the hash of the id), then a temperature fitted on a part that training left out.

Sums are integers, so word vectors do not depend on the order of tasks, and the fit uses a fixed seed and order:
a score can be repeated after a lost executor.

Edge cases: a null or empty text has no words; its pooled vector is zero and its score that of such a vector.
Texts of any length are read whole.  Null or repeated ids are scored row by row; a null id is never held out.
Labels repeated for an id count once, as the lowest.  Without two classes of labels every document scores the
share of label 1 (0.5 without labels).  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examloom.llm.bytes import mixed, pieces, prefix_hash, span_hash, word_spans

ROWS, DIM, NONZERO, REACH = 1 << 13, 32, 4, 2
SHAPE_ROWS = 1 << 10
#: Labelled documents that the network is fitted on, at most.
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, RATE, SEED = 24, 40, 128, 0.02, 11
FEATURES = 4 * DIM + 1

_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True


def _counts(member: np.ndarray, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(member[data], out=total[1:])
    return total[e] - total[s]


def tokens(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the word table, row of the shape table, and document of every word."""
    s, e = word_spans(data, starts)
    row = np.searchsorted(starts, s, "right") - 1
    h = span_hash(prefix_hash(data), s, e)
    length = e - s
    upper, letters, digits = (_counts(m, data, s, e) for m in (_UPPER, _LETTER, _DIGIT))
    marks = length - letters - digits
    last = np.where(_LETTER[data[e - 1]] | _DIGIT[data[e - 1]], 0, data[e - 1]) if len(s) else np.zeros(0, np.uint8)
    again = np.zeros(len(s), bool)
    for k in (1, 2, 3):
        again[k:] |= (h[k:] == h[:-k]) & (row[k:] == row[:-k])
    shape = np.minimum(length, 15).astype(np.uint64)
    for part in ((upper > 1) & (upper == letters), upper > 0, digits > 0, np.minimum(marks, 3), last, again):
        shape = shape * np.uint64(131) + part.astype(np.uint64)
    return (h % np.uint64(ROWS)).astype(np.int64), (mixed(shape) % np.uint64(SHAPE_ROWS)).astype(np.int64), row


def _index_table(rows: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the index vector of every row."""
    r = np.random.default_rng(salt)
    places = np.argsort(r.random((rows, DIM)), axis=1)[:, :NONZERO]
    return places, r.choice([-1, 1], (rows, NONZERO))


WORD_PLACES, WORD_SIGNS = _index_table(ROWS, 1)
SHAPE_PLACES, SHAPE_SIGNS = _index_table(SHAPE_ROWS, 2)


def _add_contexts(total: np.ndarray, ids: np.ndarray, row: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Add the index vectors of the neighbours of every word to its row."""
    size = total.size
    for k in range(1, REACH + 1):
        if len(ids) <= k:
            break
        near = row[k:] == row[:-k]
        left, right = ids[:-k][near], ids[k:][near]
        for a, b in ((left, right), (right, left)):
            pairs, n = np.unique(a * len(places) + b, return_counts=True)
            a, b = pairs // len(places), pairs % len(places)
            for j in range(NONZERO):
                total += np.bincount(a * DIM + places[b, j], signs[b, j] * n, size).astype(np.int64)


def _context_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, shapes = np.zeros(ROWS * DIM, np.int64), np.zeros(SHAPE_ROWS * DIM, np.int64)
    for batch in batches:
        for _, _, data, starts in pieces(batch.column("text")):
            w, s, row = tokens(data, starts)
            _add_contexts(words, w, row, WORD_PLACES, WORD_SIGNS)
            _add_contexts(shapes, s, row, SHAPE_PLACES, SHAPE_SIGNS)
    both = np.concatenate([words, shapes]).reshape(-1, DIM)
    used = np.flatnonzero(both.any(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(both[used].ravel()), DIM).cast(pa.list_(pa.int64()))], ["row", "v"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors of all rows of the word table, then of the shape table, from every document.

    Each task sends one partial table; they are added by row in a shuffle, and the fixed-size sum is collected.
    """
    parts = docs.select("text").mapInArrow(_context_batches, "row int, v array<bigint>")
    summed = parts.groupBy("row").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIM)])
    out = np.zeros((ROWS + SHAPE_ROWS, DIM))
    for r in summed.collect():
        out[r[0]] = r[1:]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.maximum(norm, 1)).astype(np.float32)


def pooled(data: np.ndarray, starts: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """One feature vector per document."""
    w, s, row = tokens(data, starts)
    n_docs = len(starts) - 1
    n = np.bincount(row, minlength=n_docs).astype(np.float64)
    out = np.zeros((n_docs, FEATURES))
    first = np.searchsorted(row, np.arange(n_docs))
    some = n > 0
    for k, ids in enumerate((w, s + ROWS)):
        if len(ids):
            v = vectors[ids].astype(np.float64)
            sums = np.add.reduceat(v, np.minimum(first, len(ids) - 1), axis=0)
            squares = np.add.reduceat(v * v, np.minimum(first, len(ids) - 1), axis=0)
            mean = sums[some] / n[some, None]
            out[some, 2 * k * DIM : (2 * k + 1) * DIM] = mean
            out[some, (2 * k + 1) * DIM : (2 * k + 2) * DIM] = np.sqrt(np.maximum(squares[some] / n[some, None] - mean**2, 0))
    out[:, -1] = np.log1p(n) / 10
    return out


class Network:
    """Two layers on standardised features, with a temperature on the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-6
        r = np.random.default_rng(SEED)
        z = (x - self.mean) / self.std
        part = r.random(len(y)) < 0.2  # left out for the temperature
        fit, held = np.flatnonzero(~part), np.flatnonzero(part)
        self.parts = [r.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        share = min(max(y[fit].mean(), 1e-3), 1 - 1e-3)
        self.parts[3][0] = np.log(share / (1 - share))
        first, second = [np.zeros_like(p) for p in self.parts], [np.zeros_like(p) for p in self.parts]
        step = 0
        for epoch in range(EPOCHS):
            order = r.permutation(fit)
            rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS)) + 1e-4
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                step += 1
                grads = self._gradients(z[rows], y[rows])
                for p, g, m, v in zip(self.parts, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.temperature = 1.0
        if len(held):
            logits = self._logits(z[held])
            grid = np.geomspace(0.25, 8, 61)
            loss = [np.mean(np.logaddexp(0, np.where(y[held] == 1, -1, 1) * logits / t)) for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def _hidden(self, z):
        return np.tanh(z @ self.parts[0] + self.parts[1])

    def _logits(self, z):
        return self._hidden(z) @ self.parts[2] + self.parts[3][0]

    def _gradients(self, z, y):
        h = self._hidden(z)
        d = (1 / (1 + np.exp(-(h @ self.parts[2] + self.parts[3][0]))) - y) / len(y)
        back = np.outer(d, self.parts[2]) * (1 - h * h)
        decay = 1e-3
        return [z.T @ back + decay * self.parts[0], back.sum(axis=0), h.T @ d + decay * self.parts[2], np.array([d.sum()])]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8)
        return 1 / (1 + np.exp(-self._logits(z) / self.temperature))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that no label may be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _feature_batches(vectors: np.ndarray):
    def run(batches):
        for batch in batches:
            rest = [c for c in batch.schema.names if c != "text"]
            for first, end, data, starts in pieces(batch.column("text")):
                x = pooled(data, starts, vectors).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, end - first) for c in rest), pa.array(list(x), pa.list_(pa.float32()))], [*rest, "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray) -> Network | float:
    """The network, or the share of label 1 where there is nothing to tell apart."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    usable = marks.where(~held_out(F.col("doc_id")))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most SAMPLE short rows
    features = rows.select("doc_id", "quality", "text").mapInArrow(
        _feature_batches(vectors), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, x array<float>")
    # rows that repeat an id count once, by their smallest features, so that SAMPLE bounds what is collected
    got = features.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x")).collect()
    got.sort(key=lambda r: (r["doc_id"], r["quality"], r["x"]))
    y = np.array([r["quality"] for r in got], float)
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    return Network(np.array([r["x"] for r in got], float), y)


def scored(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """All columns of ``docs`` and ``quality_score``; labels belong to rows of ``learn_from`` (default: docs)."""
    source = docs if learn_from is None else learn_from
    vectors = word_vectors(source)
    model = fit(source, labels, vectors)
    name = "quality_score"

    def run(batches):
        for batch in batches:
            for first, end, data, starts in pieces(batch.column("text")):
                part = batch.slice(first, end - first)
                s = np.full(len(part), model) if isinstance(model, float) else model.scores(pooled(data, starts, vectors))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s.astype(float))], [*part.schema.names, name])

    docs = docs.drop(name)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, {name} double")
