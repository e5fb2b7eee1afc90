"""BPE encoding and decoding with a table of distinct words, over the vocabulary of a public tokenizer.

Words are runs of characters other than ASCII white space; no token of the tokenizer spans a blank, so the ids
of a text are those of its words in order.  Each task keeps a table of the distinct words of its partition:
every distinct word is encoded once by the tokenizers library, and ids are joined back by position with arrays.
Decoding joins ids with the table of pieces (one row per id of the vocabulary, a fixed size).

The table is per task, not per corpus: joining a table of all distinct words back needs a shuffle of every
word of every text with its position (see README).  A task that is lost is simply run again.

Edge cases: a null or empty text has no ids, and no ids decode to an empty text.  Texts of any length are
encoded whole.  Strings of special tokens in a text become their ids, as in the library.  Null and repeated ids
are kept, one result per row.  An empty table gives an empty result.  Other columns are kept.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from examloom.llm.bytes import pieces, prefix_hash, span_hash, word_spans

#: Distinct words that a task remembers before it starts a new table; bounds memory, not results.
TABLE_WORDS = 400_000
_ENCODE_AT_ONCE = 4096


@lru_cache(maxsize=1)
def _tokenizer(source: str):
    # a task encodes in its own thread: threads of the library would run beside the other tasks of the executor
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_str(source)
    out.no_truncation()
    out.no_padding()
    return out


def read_vocabulary(path: str) -> str:
    """The file of a tokenizer, read on the driver and sent along with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class WordTable:
    """Ids of distinct words: row numbers by word hash, and all ids in one array."""

    def __init__(self, source: str):
        self.tokenizer = _tokenizer(source)
        self.clear()

    def clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.size, self.used = np.zeros(1 << 12, np.int64), 0
        self.at = np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, np.uint32)

    def _append(self, ids: list[int]) -> None:
        row = len(self.rows)
        if row + 1 >= len(self.size):
            self.size, self.at = np.resize(self.size, 2 * len(self.size)), np.resize(self.at, 2 * len(self.at))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[row], self.at[row] = len(ids), self.used
        self.used += len(ids)

    def lookup(self, hashes: np.ndarray, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Row of every word; unknown words are encoded first, each once."""
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        if len(self.rows) + len(keys) > TABLE_WORDS:
            self.clear()
        new = [i for i, k in enumerate(keys) if k not in self.rows]
        for at in range(0, len(new), _ENCODE_AT_ONCE):
            some = new[at : at + _ENCODE_AT_ONCE]
            words = [bytes(data[s[first[i]] : e[first[i]]]).decode() for i in some]
            for i, found in zip(some, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
                self._append(found.ids)
                self.rows[keys[i]] = len(self.rows)
        rows = np.fromiter(map(self.rows.__getitem__, keys), np.int64, len(keys))
        return rows[inverse]


def _encoding(vocabulary: str, column: str, rest: list[str]):
    def run(batches):
        table = WordTable(vocabulary)
        for batch in batches:
            for first, end, data, starts in pieces(batch.column(column)):
                s, e = word_spans(data, starts)
                rows = table.lookup(span_hash(prefix_hash(data), s, e), data, s, e)
                size, at = table.size[rows], table.at[rows]
                ends = np.cumsum(size)
                total = int(ends[-1]) if len(ends) else 0
                # position k of the output reads table position at[word] + (k - start of the word)
                flat = table.ids[np.repeat(at - (ends - size), size) + np.arange(total)]
                before = np.concatenate([[0], ends])
                cuts = before[np.searchsorted(s, starts)] * 4
                offsets = pa.py_buffer(cuts.astype(np.int32).tobytes())
                ids = pa.Array.from_buffers(pa.binary(), end - first, [None, offsets, pa.py_buffer(flat.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, end - first) for c in rest), ids], [*rest, "ids"])

    return run


def piece_table(vocabulary: str) -> list[str]:
    """The piece of every id, special tokens included."""
    spec = json.loads(vocabulary)
    if spec.get("decoder"):
        raise ValueError("only tokenizers without a decoder are supported")
    by_id = {i: p for p, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [by_id.get(i, "") for i in range(max(by_id) + 1)]


def _decoding(vocabulary: str):
    def run(batches):
        by_id = pa.array(piece_table(vocabulary), pa.string())
        for batch in batches:
            ids = pc.fill_null(batch.column("ids"), b"")
            sizes = pc.binary_length(ids).to_numpy(zero_copy_only=False) // 4
            first = 0
            while first < len(batch):  # some 200,000 ids at a time, a longer text alone
                end = first + max(1, int(np.searchsorted(np.cumsum(sizes[first:]), 200_000, "right")))
                raw = ids.slice(first, end - first).to_pylist()
                cuts = np.concatenate([[0], np.cumsum(sizes[first:end])]).astype(np.int32)
                found = by_id.take(pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int64)))
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), found), " ")
                part = batch.slice(first, len(raw))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, "decoded"])
                first += len(raw)

    return run


def _fields(frame: DataFrame, *without: str) -> dict[str, str]:
    return {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields if f.name not in without}


def encode(docs: DataFrame, vocabulary: str, column: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, and ``ids``: unsigned 32-bit little-endian ids, one after another."""
    rest = _fields(docs, column, "ids", "decoded")
    return docs.select(*rest, column).mapInArrow(_encoding(vocabulary, column, list(rest)), ", ".join([*rest.values(), "ids binary"]))


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """All columns of ``encoded`` and ``decoded``: the pieces of its ids, joined by blanks.

    That is what the library does for a tokenizer without a decoder.
    """
    fields = _fields(encoded, "decoded")
    return encoded.select(*fields).mapInArrow(_decoding(vocabulary), ", ".join([*fields.values(), "decoded string"]))


def round_trip(docs: DataFrame, vocabulary: str, column: str = "text") -> DataFrame:
    """``decode(encode(docs))``, both in one pass of one worker."""
    rest = _fields(docs, column, "ids", "decoded")
    encoding, decoding = _encoding(vocabulary, column, list(rest)), _decoding(vocabulary)
    return docs.select(*rest, column).mapInArrow(
        lambda batches: decoding(encoding(batches)), ", ".join([*rest.values(), "ids binary", "decoded string"]))
