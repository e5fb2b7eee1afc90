"""Language of every word of a text by a linear-chain conditional random field, and of the text as a whole.

A word is a run of letters (with their marks).  Its features are its place in a lexicon (how often each language
uses the word, over all documents that may be learnt from), its first and last one to three letters, and its pairs
and triples of letters, ends included.  Labels of neighbouring words are tied by learned transitions.  Forward and
backward messages give the probability of every language for every word; a text takes the language with the
largest mean, and that mean is its score.  ``tagged`` also gives the runs of words of one language, so that text
which switches languages is cut where it switches.

Learning.  Languages and word counts come from all documents that may be learnt from (one partial table per task
goes through a shuffle; its size is ``LEXICON`` rows however large the corpus).  Weights and transitions are fitted
with numpy on the driver on a bounded sample: of at most ``SAMPLE`` documents per language, chosen by hash, one
stretch of ``STRETCH`` characters at a place chosen by hash.  Stretches of all languages are spliced into
sequences whose runs last ``RUN`` words on average, so that transitions see switches.  At most ``LANGUAGES``
languages are learnt, the most frequent ones.  Seeds and orders are fixed.

Messages are exact for texts of any length: a text is cut into lanes of ``LANE`` words, the products of their
matrices link the lanes, and all lanes run side by side.

Edge cases: a null text, or one without a letter, is ``und`` with score 0 and no runs.  Texts of any length are read
whole.  Null and repeated ids are labelled row by row; a null id is never held out.  Rows without a language teach
nothing.  Equal scores go to the first language by name; a language that is the only one learnt is given to every
text with letters, and without any learnt language all are ``und``.  An empty table gives an empty result.  Other
columns are kept.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examloom.functions.ranking import top_n
from examloom.llm.bytes import mixed, pieces, prefix_hash, span_hash

#: Rows of the hashed weights and of the lexicon.
ROWS, LEXICON = 1 << 15, 1 << 15
LANGUAGES = 64
#: Documents per language that the weights are fitted on, at most, and characters of each.
SAMPLE, STRETCH = 400, 400
RUN, SEQUENCE, BATCH, EPOCHS, RATE, SEED = 12, 40, 64, 6, 0.2, 5
LANE = 64
UNKNOWN = "und"
_PREFIXES = _SUFFIXES = 3
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def held_out(doc_id: Column) -> Column:
    """True for the fourth of the ids whose language may not be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: 2 for a letter, 1 for a mark, else 0; and its lower case."""
    kind, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            kind[i] = 2
            small = c.lower()
            if len(small) == 1:
                lower[i] = ord(small)
        elif i > 0x2FF and unicodedata.category(c)[0] == "M":
            kind[i] = 1
    return kind, lower


def words_of(data: np.ndarray, starts: np.ndarray):
    """Lower-cased code points of the texts, start and end of every word in them, its row, and where rows start."""
    kind, lower = _characters()
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=place[1:])
    starts = place[starts]
    inside = np.zeros(len(points) + 2, bool)
    kinds = kind[points]
    inside[1:-1] = kinds > 0
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = starts[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(points))]
    begins[cuts] |= inside[1:-1][cuts]
    ends[cuts - 1] |= inside[1:-1][cuts - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if len(s):
        real = np.maximum.reduceat(kinds, s) == 2 if len(s) == 1 or (s[1:] >= e[:-1]).all() else np.ones(len(s), bool)
        s, e = s[real], e[real]
    return lower[points], s, e, np.searchsorted(starts, s, "right") - 1, starts


def _bucket(*parts: np.ndarray, salt: int) -> np.ndarray:
    h = np.full(len(parts[0]), np.uint64(salt * 0x632BE59BD9B4E019 & (2**64 - 1)))
    for p, m in zip(parts, _MULTIPLIERS):
        h = (h + p) * m
    return (mixed(h) % np.uint64(ROWS)).astype(np.int32)


def features(points: np.ndarray, s: np.ndarray, e: np.ndarray):
    """Rows of the affixes of every word (ROWS where it is too short), rows of its pairs and triples, and their starts."""
    size = e - s
    # words one after another, a zero ahead of each and one at the end
    begin = np.concatenate([[0], np.cumsum(size + 1)]).astype(np.int64)
    z = np.zeros(int(begin[-1]) + 2, np.uint64)
    at = np.arange(int(size.sum())) + np.repeat(np.arange(len(s)), size) + 1
    z[at] = points[np.repeat(s - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))]
    first, last = begin[:-1], begin[:-1] + size
    affixes = []
    for k in range(1, _PREFIXES + 1):
        row = _bucket(*[z[np.minimum(first + 1 + j, last)] for j in range(k)], salt=k)
        affixes.append(np.where(size >= k, row, ROWS))
    for k in range(1, _SUFFIXES + 1):
        row = _bucket(*[z[np.maximum(last - j, first + 1)] for j in range(k)], salt=10 + k)
        affixes.append(np.where(size >= k, row, ROWS))
    pairs = _bucket(z[:-2], z[1:-1], salt=20)
    triples = _bucket(z[:-2], z[1:-1], z[2:], salt=21)
    triples[last] = ROWS  # would reach into the next word
    return np.stack(affixes, axis=1) if len(s) else np.zeros((0, _PREFIXES + _SUFFIXES), np.int64), pairs[: begin[-1]], triples[: begin[-1]], first


def lexicon_rows(points: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and its row of the lexicon."""
    h = span_hash(prefix_hash(points), s, e)
    return h, (h % np.uint64(LEXICON)).astype(np.int64)


@dataclass
class Model:
    """Languages, hashed weights (a zero row last), lexicon scores, their weights, and transitions, all as logarithms."""

    languages: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    mix: np.ndarray
    transitions: np.ndarray

    def emissions(self, points: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Score of every language for every word; equal words are scored once."""
        h, rows = lexicon_rows(points, s, e)
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        s, e, rows = s[first], e[first], rows[first]
        affixes, pairs, triples, begin = features(points, s, e)
        out = self.lexicon[rows] @ self.mix
        for k in range(affixes.shape[1]):
            out += self.weights[affixes[:, k]]
        size = (e - s)[:, None]
        out += np.add.reduceat(self.weights[pairs], begin, axis=0) / (size + 1)
        out += np.add.reduceat(self.weights[triples], begin, axis=0) / size
        return out[inverse]


def _scaled(m: np.ndarray, axes) -> np.ndarray:
    return m / np.maximum(m.max(axis=axes, keepdims=True), 1e-300)


def marginals(scores: np.ndarray, counts: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Probability of every label for every word; ``counts`` are the words of the sequences, none of them zero."""
    n, labels = scores.shape
    step = np.exp(transitions - transitions.max())
    e = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -60.0)).astype(np.float64)
    lanes = -(-counts // LANE)
    total = int(lanes.sum())
    first_lane = np.cumsum(lanes) - lanes
    number = np.arange(total) - np.repeat(first_lane, lanes)
    start = np.repeat(np.cumsum(counts) - counts, lanes) + number * LANE
    size = np.minimum(LANE, np.repeat(counts, lanes) - number * LANE)
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    active = np.searchsorted(-size, -np.arange(LANE), "left")  # lanes longer than t come first
    inside, outside = np.full((total, labels), 1.0), np.full((total, labels), 1.0)
    rank = np.empty(total, np.int64)
    rank[order] = np.arange(total)
    most = int(lanes.max())
    if most > 1:
        product = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
        for t in range(LANE):
            k = active[t]
            product[:k] = _scaled((product[:k] @ step) * e[start[:k] + t][:, None, :], (1, 2))
        for j in range(1, most):  # messages from lane to lane, all texts at once
            here = first_lane[lanes > j] + j
            inside[rank[here]] = _scaled(np.einsum("nl,nlm->nm", inside[rank[here - 1]], product[rank[here - 1]]), 1)
        for j in range(most - 1, 0, -1):
            here = first_lane[lanes > j] + j
            outside[rank[here - 1]] = _scaled(np.einsum("nlm,nm->nl", product[rank[here]], outside[rank[here]]), 1)
    ahead, behind = np.empty((n, labels)), np.empty((n, labels))
    for t in range(LANE):
        k = active[t]
        inside[:k] = _scaled((inside[:k] @ step) * e[start[:k] + t], 1)
        ahead[start[:k] + t] = inside[:k]
    for t in range(LANE - 1, -1, -1):
        k = active[t]
        behind[start[:k] + t] = outside[:k]
        outside[:k] = _scaled((outside[:k] * e[start[:k] + t]) @ step.T, 1)
    ahead *= behind
    return ahead / np.maximum(ahead.sum(axis=1, keepdims=True), 1e-300)


def _pair_marginals(scores: np.ndarray, transitions: np.ndarray):
    """Marginals of words and sums of those of neighbours, for sequences of one length: scores [n, t, label]."""
    n, length, labels = scores.shape
    step = np.exp(transitions - transitions.max())
    e = np.exp(np.maximum(scores - scores.max(axis=2, keepdims=True), -60.0))
    ahead, behind = np.empty((length, n, labels)), np.empty((length, n, labels))
    a, b = np.ones((n, labels)), np.ones((n, labels))
    for t in range(length):
        a = _scaled((a @ step) * e[:, t], 1)
        ahead[t] = a
    pairs = np.zeros((labels, labels))
    for t in range(length - 1, -1, -1):
        behind[t] = b
        before = ahead[t - 1] if t else np.ones((n, labels))
        joint = before[:, :, None] * step[None] * (e[:, t] * b)[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = _scaled((b * e[:, t]) @ step.T, 1)
    both = ahead * behind
    return (both / both.sum(axis=2, keepdims=True)).transpose(1, 0, 2), pairs


def _lexicon_counts(languages: list[str]):
    def run(batches):
        n = len(languages)
        numbers = {name: i for i, name in enumerate(languages)}
        counts = np.zeros(LEXICON * n, np.int64)
        for batch in batches:
            lang = np.array([numbers.get(v, -1) for v in batch.column("lang").to_pylist()], np.int64)
            for first, end, data, starts in pieces(batch.column("text")):
                points, s, e, row, _ = words_of(data, starts)
                label = lang[first:end][row]
                known = label >= 0
                _, at = lexicon_rows(points, s[known], e[known])
                counts += np.bincount(at * n + label[known], minlength=len(counts))
        table = counts.reshape(-1, n)
        used = np.flatnonzero(table.any(axis=1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * n, pa.int32()), pa.array(table[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), lists], ["row", "n"])

    return run


def _lexicon(known: DataFrame, languages: list[str]) -> np.ndarray:
    """Centred logarithm of how often each language uses the words of a row, over all of ``known``."""
    n = len(languages)
    parts = known.select("lang", "text").mapInArrow(_lexicon_counts(languages), "row int, n array<bigint>")
    summed = parts.groupBy("row").agg(*[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(n)])
    counts = np.zeros((LEXICON, n))
    for r in summed.collect():  # LEXICON rows at most
        counts[r[0]] = r[1:]
    share = (counts + 0.5) / (counts.sum(axis=0) + 0.5 * LEXICON)
    logs = np.log(share)
    return (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)


def _sample(known: DataFrame, sizes: dict[str, int]) -> list[tuple[str, str]]:
    """Language and stretch of at most ``SAMPLE`` documents per language."""
    h = F.xxhash64("doc_id", "text")
    # a first choice by hash alone leaves about twice the sample, so that little is ranked
    odds = F.element_at(F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, 2 * SAMPLE / v))]), F.col("lang"))
    place = (F.pmod(h, F.greatest(F.length("text") - STRETCH, F.lit(1)).cast("bigint")) + 1).cast("int")
    few = known.withColumn("h", h).where(F.shiftrightunsigned("h", 11) / float(1 << 53) < odds)
    few = few.select("lang", "h", F.substring(F.col("text"), place, F.lit(STRETCH)).alias("piece"))
    rows = top_n(few, ["lang"], ["h", "piece"], SAMPLE).select("lang", "piece").collect()
    return sorted((r["lang"], r["piece"]) for r in rows)


def _spliced(labels: list[np.ndarray], r: np.random.Generator, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and labels of ``n`` sequences; ``labels[k]`` are the stretches of language k."""
    words, marks = np.zeros((n, SEQUENCE), np.int64), np.zeros((n, SEQUENCE), np.int64)
    for i in range(n):
        at = 0
        while at < SEQUENCE:
            k = int(r.integers(len(labels)))
            stretch = labels[k][int(r.integers(len(labels[k])))]
            take = min(int(r.geometric(1 / RUN)), SEQUENCE - at, len(stretch))
            begin = int(r.integers(len(stretch) - take + 1))
            words[i, at : at + take], marks[i, at : at + take] = stretch[begin : begin + take], k
            at += take
    return words, marks


def fit(docs: DataFrame) -> Model | None:
    """Learn from text and language of the documents of ``docs`` that are not held out."""
    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    found = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    sizes = {r["lang"]: r["n"] for r in sorted(found)}
    if not sizes:
        return None
    languages, count = list(sizes), len(sizes)
    known = known.where(F.col("lang").isin(languages))
    lexicon = _lexicon(known, languages)
    model = Model(languages, np.zeros((ROWS + 1, count), np.float32), lexicon, np.eye(count, dtype=np.float32), np.zeros((count, count)))
    stretches: list[list[np.ndarray]] = [[] for _ in languages]
    texts = _sample(known, sizes)
    joined = "\n".join(t for _, t in texts)
    data = np.frombuffer(joined.encode(), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t.encode()) + 1 for _, t in texts])]) if texts else np.zeros(1, np.int64)
    points, s, e, row, _ = words_of(data, np.minimum(starts, len(data)))
    for i, (name, text) in enumerate(texts):
        mine = np.flatnonzero(row == i)
        mine = mine[1:-1] if len(text) == STRETCH else mine  # words that the stretch may have cut
        if len(mine):
            stretches[languages.index(name)].append(mine)
    taught = [k for k in range(count) if stretches[k]]
    if len(taught) < 2:
        return model
    _train(model, points, s, e, [stretches[k] for k in taught], np.array(taught))
    return model


def _train(model: Model, points, s, e, stretches, taught) -> None:
    """Stochastic ascent of the conditional likelihood of spliced sequences, with a step size per weight."""
    r = np.random.default_rng(SEED)
    count = len(model.languages)
    affixes, pairs, triples, begin = features(points, s, e)
    size = e - s
    _, lex_row = lexicon_rows(points, s, e)
    weights, mix = model.weights.astype(np.float64), model.mix.astype(np.float64)
    seen = [np.full_like(weights, 1e-2), np.full_like(mix, 1e-2), np.full((count, count), 1e-2)]
    words, marks = _spliced(stretches, r, 400 * len(taught))
    marks = taught[marks]
    for _ in range(EPOCHS):
        for at in range(0, len(words), BATCH):
            w, y = words[at : at + BATCH], marks[at : at + BATCH]
            flat = w.ravel()
            length = size[flat] + 1  # letters and the end of a word
            grams = np.repeat(begin[flat] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
            owner = np.repeat(np.arange(len(flat)), length)
            rows = np.concatenate([affixes[flat].ravel(), pairs[grams], triples[grams]])
            owners = np.concatenate([np.repeat(np.arange(len(flat)), affixes.shape[1]), owner, owner])
            values = np.concatenate([np.ones(affixes[flat].size), 1 / length[owner], 1 / size[flat][owner]])
            lex = model.lexicon[lex_row[flat]].astype(np.float64)
            scores = lex @ mix
            for k in range(count):
                scores[:, k] += np.bincount(owners, weights[rows, k] * values, len(flat))
            found, joint = _pair_marginals(scores.reshape(*w.shape, count), model.transitions)
            given = np.eye(count)[y]
            gap = (given - found).reshape(-1, count) / len(w)
            grads = [np.zeros_like(weights), lex.T @ gap]
            for k in range(count):
                grads[0][:, k] = np.bincount(rows, gap[owners, k] * values, ROWS + 1)
            grads[0][ROWS] = 0
            # a first word follows any label, as likely as the transitions say
            step = np.exp(model.transitions)
            first = step / step.sum(axis=0) * np.bincount(y[:, 0], minlength=count)
            pairs_given = given[:, :-1].reshape(-1, count).T @ given[:, 1:].reshape(-1, count)
            grads.append((pairs_given + first - joint) / len(w))
            for p, g, q in zip((weights, mix, model.transitions), grads, seen):
                q += g * g
                p += RATE * g / np.sqrt(q)
    model.weights, model.mix = weights.astype(np.float32), mix.astype(np.float32)


_RUNS = "array<struct<start:int,end:int,lang:string,score:double>>"


def _tagging(model: Model | None, rest: list[str]):
    names = model.languages if model else []

    def run(batches):
        for batch in batches:
            for first, end, data, starts in pieces(batch.column("text")):
                n = end - first
                lang, score = np.full(n, -1), np.zeros(n)
                runs_at, runs = np.zeros(n + 1, np.int64), [[], [], [], []]
                points, s, e, row, origin = words_of(data, starts)
                if model and len(s):
                    rows, begin, counts = np.unique(row, return_index=True, return_counts=True)
                    chance = marginals(model.emissions(points, s, e), counts, model.transitions)
                    mean = np.add.reduceat(chance, begin, axis=0) / counts[:, None]
                    lang[rows], score[rows] = mean.argmax(axis=1), np.clip(mean.max(axis=1), 0, 1)
                    label = chance.argmax(axis=1)
                    turn = np.ones(len(s), bool)
                    turn[1:] = (label[1:] != label[:-1]) | (row[1:] != row[:-1])
                    at = np.flatnonzero(turn)
                    to = np.append(at[1:], len(s))
                    sure = np.add.reduceat(chance[np.arange(len(s)), label], at) / (to - at)
                    runs = [s[at] - origin[row[at]], e[to - 1] - origin[row[at]], label[at], sure]
                    runs_at = np.searchsorted(row[at], np.arange(n + 1))
                table = pa.array([*names, UNKNOWN], pa.string())
                inner = pa.StructArray.from_arrays(
                    [pa.array(runs[0], pa.int32()), pa.array(runs[1], pa.int32()), table.take(pa.array(runs[2], pa.int64())), pa.array(runs[3], pa.float64())],
                    ["start", "end", "lang", "score"])
                out = [table.take(pa.array(np.where(lang < 0, len(names), lang))), pa.array(score), pa.ListArray.from_arrays(pa.array(runs_at, pa.int32()), inner)]
                kept = [batch.column(c).slice(first, n) for c in rest]
                yield pa.RecordBatch.from_arrays([*kept, *out], [*rest, "lang_pred", "score", "runs"])

    return run


def tagged(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``docs`` but the text, ``lang_pred``, ``score``, and ``runs`` of words of one language.

    A run has start and end in code points of the text, its language, and the mean probability of its words.
    """
    fields = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name not in ("text", "lang_pred", "score", "runs")}
    rest = list(fields)
    schema = ", ".join([*fields.values(), "lang_pred string, score double", f"runs {_RUNS}"])
    return docs.select(*rest, "text").mapInArrow(_tagging(model, rest), schema)
