"""Bounded-space online packing of token documents into fixed-size sequences."""

from __future__ import annotations

import os
import re
import struct
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, give_back, sliced

#: Characters that end a word for the tokenizer; words are encoded one by one and kept.
_SPACES = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Of str.split()'s separators, those that the tokenizer does not take for spaces.
_NOT_SPACES = "\x1c\x1d\x1e\x1f"
#: A word that is one run of letters and one of punctuation.
_PLAIN = re.compile(r"([A-Za-z]+)([.,;:!?|#$%&*()-]*)").fullmatch
#: Words that a worker keeps; Python workers live on after a stage, and so does what they keep.
WORDS_KEPT = 300_000

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


class _Rows(dict):
    """Word to row number; a word that is asked for in vain gets the next row and waits to be encoded."""

    def __init__(self):
        super().__init__()
        self.waiting: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        self.waiting.append(word)
        return row


def _stored(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids; a list of numbers takes about five times as much memory."""
    return struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder:
    """Token ids of texts by a tokenizers file that never joins characters across spaces.

    A distinct word is encoded once, and so is what a capital or trailing punctuation adds to it: the file lower-cases
    and takes runs of letters and runs of punctuation apart. Of at most WORDS_KEPT words, and half as many parts, the ids stay in memory.
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end_id
        self.rows, self.parts = _Rows(), {}
        self.flat, self.first = np.empty(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)

    def learn(self) -> None:
        """Encodes the waiting words."""
        new = self.rows.waiting
        split = [(m[1].lower(), m[2]) if (m := _PLAIN(w)) else (w,) for w in new]
        if unknown := {p for ps in split for p in ps if p and p not in self.parts}:
            plain = [p for p in unknown if p.isascii() and p.isalpha() and p.islower()]
            other = list(unknown.difference(plain))
            self.parts.update((p, _stored([t.id for t in self.tokenizer.model.tokenize(p)])) for p in plain)  # nothing to normalise or split
            self.parts.update(zip(other, (_stored(e.ids) for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)), strict=True))
        got = [self.parts[ps[0]] + self.parts[ps[1]] if len(ps) > 1 and ps[1] else self.parts[ps[0]] for ps in split]
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        n = len(self.rows) - len(new)
        at, to = self.first[n], self.first[n] + int(sizes.sum())
        while to > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + len(new) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        self.flat[at:to] = np.frombuffer(b"".join(got), "<u4")
        self.first[n + 1 : n + 1 + len(new)] = at + np.cumsum(sizes)
        self.rows.waiting = []

    def forget(self) -> None:
        """Drops the words that came last, so that WORDS_KEPT stay."""
        while len(self.rows) > WORDS_KEPT:
            self.rows.popitem()
        while len(self.parts) > WORDS_KEPT // 2:
            self.parts.popitem()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """For each text its ids and the end id."""
        found = [np.fromiter(map(self.rows.__getitem__, ws), np.int64, len(ws)) for ws in map(self.words, texts)]
        if self.rows.waiting:
            self.learn()
        out = []
        for which in found:
            start, size = self.first[which], self.first[which + 1] - self.first[which]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(which) else 0
            ids = np.empty(total + 1, "<u4")
            ids[:total] = self.flat[np.arange(total) + np.repeat(start - (ends - size), size)]
            ids[total] = self.end
            out.append(ids)
        self.forget()
        return out

    @staticmethod
    def words(text: str) -> list[str]:
        if any(c in text for c in _NOT_SPACES):
            for c in _SPACES[1:]:
                text = text.replace(c, " ")
            return [w for w in text.split(" ") if w]
        return text.split()


class OpenWindows:
    """A fixed number of open windows. add() places a piece best-fit; when none fits it closes the fullest."""

    def __init__(self, size: int, most: int, gap: int):
        self.size, self.most, self.gap = size, most, gap
        self.free: list[tuple[int, int]] = []  # (room left, window), sorted
        self.held: dict[int, list[tuple]] = {}
        self.next = 0

    def add(self, piece: tuple[int, int, int]) -> Iterator[list[tuple]]:
        """piece: (document, start, length), length at most size. Yields windows that are closed."""
        doc, start, length = piece
        at = bisect_left(self.free, (length, -1))
        if at == len(self.free) and len(self.free) == self.most:
            room, window = self.free.pop(0)
            closed = self.held.pop(window)
            if room > self.gap:  # more room than may be padded: the document is cut to fill it
                closed.append((doc, start, room))
                start, length = start + room, length - room
            yield closed
            at = bisect_left(self.free, (length, -1))
        if at < len(self.free):
            room, window = self.free.pop(at)
            self.held[window].append((doc, start, length))
        else:
            room, window = self.size, self.next
            self.next += 1
            self.held[window] = [(doc, start, length)]
        if room == length:
            yield self.held.pop(window)
        else:
            insort(self.free, (room - length, window))

    def leftovers(self) -> Iterator[list[tuple]]:
        """The windows still open, merged: cut into full ones, and a last rest cut at powers of two, which need no padding."""
        pieces = [p for _, w in sorted(self.free) for p in self.held[w]]
        total = sum(p[2] for p in pieces)
        sizes = [self.size] * (total // self.size) + [1 << b for b in range(self.size.bit_length(), -1, -1) if (total % self.size) >> b & 1]
        at = iter(pieces)
        doc, start, length = next(at, (0, 0, 0))
        for room in sizes:
            closed = []
            while room:
                if not length:
                    doc, start, length = next(at)
                n = min(room, length)
                closed.append((doc, start, n))
                start, length, room = start + n, length - n, room - n
            yield closed
        self.free, self.held = [], {}


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 2048, open_windows: int = 128, max_gap: int = 16) -> DataFrame:
    """Packs every row of docs (doc_id, text, ...) into sequences of at most `size` tokens.

    Each task keeps `open_windows` windows open. Whole windows are cut from a document longer than `size`; the
    rest goes where it fits best. If it fits nowhere, the fullest window is emitted, first topped up with the
    document's head if more than `max_gap` tokens would be padded. At a task's end the open windows are merged into
    full ones, and the last rest is cut at powers of two, so that it takes no padding. No shuffle; a task holds a
    batch and its windows. A lost task gives the same sequences again: ids come from the input partition.

    Returns a row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary, little-endian
    unsigned 32-bit). A null text counts as empty (one piece, the end id); a null doc_id stays null; repeated rows
    are packed each; an empty table gives no rows; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(tokenizer, end_id)
        windows, sequence = OpenWindows(size, open_windows, max_gap), TaskContext.get().partitionId() << 40
        ids: dict[int, tuple] = {}  # by number of document: [doc_id, ids, tokens not yet emitted]
        number, rows = 0, []

        def emit(closed: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, length in closed:
                held = ids[doc]
                rows.append((held[0], start, length, len(held[1]), sequence, offset, held[1][start : start + length].tobytes()))
                offset += length
                held[2] -= length
                if not held[2]:
                    del ids[doc]
            sequence += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in PIECES]
            rows.clear()
            return pa.record_batch([pa.array(c, pa.binary() if f.name == "ids" else pa.int64()) for c, f in zip(columns, PIECES, strict=True)], [f.name for f in PIECES])

        for batch in batches:
            for part in sliced(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, got in zip(part.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    ids[number] = [doc_id, got, len(got)]
                    whole = len(got) // size * size
                    for start in range(0, whole, size):
                        emit([(number, start, size)])
                    if whole < len(got):
                        for closed in windows.add((number, whole, len(got) - whole)):
                            emit(closed)
                    number += 1
                if rows:
                    yield flush()
            give_back()  # between the words that stay, what went is free but not given back by itself
        for closed in windows.leftovers():
            emit(closed)
        if rows:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


_encoders: dict[tuple, WordEncoder] = {}


def _encoder(path: str, end_id: int) -> WordEncoder:
    """One for each Python worker, which keeps its words from task to task."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = WordEncoder(path, end_id)
    return _encoders[path, end_id]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_digest(pack(documents(spark, sf_dir), tokenizer_path()))


def pieces_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
