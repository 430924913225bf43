"""Removal of passages that an earlier document has, by an FM-index per shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, coefficients, discard, documents, grams, mixed, signed, sliced, small, staged
from .fm_index import FMIndex

#: Words of the runs whose hashes anchor a window; a shared line of fewer words makes no candidates.
ANCHOR_WORDS = 20
#: Windows of one segment at most; longer runs are cut.
RUN = 64
#: Words in a shard's index, about.
SHARD_WORDS = 1_000_000
#: Segments that a shard streams through its index at a time.
STREAMED = 20_000
#: An anchor with more distinct segments than this, about a shard's worth, is taken by window hashes instead of an index.
HOT_SEGMENTS = 10_000

_SEGMENT = "doc_id long, text_key long, anchor long, content long, first int, windows int"


def _runs(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts a document's windows into runs with one anchor, the least hash of the short word runs in the window.

    Equal windows have equal anchors wherever they stand. Returns anchor, first window and number of windows.
    """
    short = grams(h, ANCHOR_WORDS, seed=5)
    wide, n = window - ANCHOR_WORDS + 1, len(h) - window + 1
    pad = -len(short) % wide
    block = np.concatenate([short, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, wide)
    ahead = np.minimum.accumulate(block, 1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
    anchor = np.minimum(back[:n], ahead[wide - 1 : wide - 1 + n])
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    length = np.diff(np.append(new, n))
    pieces = -(-length // RUN)
    first = np.repeat(new, pieces) + RUN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    last = np.minimum(first + RUN, np.repeat(new + length, pieces))
    return anchor[first], first, last - first


def _window_hashes(h: np.ndarray, window: int) -> np.ndarray:
    return grams(h, window, seed=9)


def segments(docs: DataFrame, window: int) -> DataFrame:
    """Each document's runs of windows: anchor, hash of all words in the run, first window, number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coefficients(window + RUN, 11)
        for batch in batches:
            for part in sliced(batch, 1):
                w, out = Words(part.column(1).to_pylist()), []
                for i in range(len(w.first) - 1):
                    h = w.of(i)
                    if len(h) < window:
                        continue
                    anchor, first, n = _runs(h, window)
                    size = n + window - 1
                    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    content = mixed(np.add.reduceat(h[np.repeat(first, size) + inside] * c[inside], np.cumsum(size) - size) + size.astype(np.uint64))
                    out.append((np.full(len(n), i), anchor, content, first, n))
                if out:
                    row, anchor, content, first, n = (np.concatenate(x) for x in zip(*out, strict=True))
                    row = pa.array(row)
                    yield pa.record_batch([part.column(0).take(row), part.column(2).take(row), pa.array(signed(anchor)), pa.array(signed(content)), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], ["doc_id", "text_key", "anchor", "content", "first", "windows"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key")).where("doc_id is not null and text is not null").mapInArrow(run, _SEGMENT)


def _with_words(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """wanted: one row per document with `parts`, an array of (anchor, content, first, windows, ...); adds each part's word hashes."""
    asked = wanted.select(F.col("doc_id").alias("of"), F.col("text_key").alias("key"), "parts")
    text = docs.select(F.col("doc_id").cast("long"), "text").join(asked, (F.col("doc_id") == F.col("of")) & (F.xxhash64("text") == F.col("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 1):
                w, rows = Words(part.column(1).to_pylist()), {k: [] for k in ("anchor", "content", "owner", "hot", "words")}
                for i, (doc_id, asks) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    h = w.of(i)
                    for a in asks:
                        own = h[a["first"] : a["first"] + a["windows"] + window - 1]
                        for k in ("anchor", "content", "hot"):
                            rows[k].append(a[k])
                        rows["owner"].append(doc_id)
                        rows["words"].append((_window_hashes(own, window) if a["hot"] else own).tobytes())
                yield pa.record_batch([pa.array(rows[k], t) for k, t in (("anchor", pa.int64()), ("content", pa.int64()), ("owner", pa.int64()), ("hot", pa.bool_()), ("words", pa.binary()))], list(rows))

    return text.select("doc_id", "text", "parts").mapInArrow(run, "anchor long, content long, owner long, hot boolean, words binary")


def _search(window: int):
    """Builds a shard's index and streams its documents' segments through it: what an owner before theirs has of them."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["owner", "anchor", "content"]).reset_index(drop=True)
        words, owner = rows.words.tolist(), np.unique(rows.owner.to_numpy(), return_inverse=True)[1]
        index = FMIndex([np.frombuffer(w, np.uint64) for w in words], owner)
        out = []
        for at in range(0, len(words), STREAMED):
            stream = [np.frombuffer(w, np.uint64) for w in words[at : at + STREAMED]]
            which, start, end = index.repeats(stream, owner[at : at + STREAMED], window)
            out.append(pd.DataFrame({"anchor": rows.anchor.to_numpy()[at + which], "content": rows.content.to_numpy()[at + which], "start": start.astype("int32"), "end": end.astype("int32")}))
        return pd.concat(out)

    return run


_FOUND = "anchor long, content long, start int, end int"


def _by_window(hot: DataFrame, window: int) -> DataFrame:
    """The same answer for hot anchors: the least owner of each window hash, aggregated before the shuffle."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 3):
                held = [np.frombuffer(w, np.int64) for w in part.column(3).to_pylist()]
                row = pa.array(np.repeat(np.arange(len(held)), [len(x) for x in held]))
                at = np.concatenate([np.arange(len(x)) for x in held] + [np.empty(0, np.int64)]).astype(np.int32)
                yield pa.record_batch([part.column(k).take(row) for k in range(3)] + [pa.array(at), pa.array(np.concatenate([*held, np.empty(0, np.int64)]))], ["anchor", "content", "owner", "at", "hash"])

    each = hot.select("anchor", "content", "owner", "words").mapInArrow(split, "anchor long, content long, owner long, at int, hash long")
    least = each.groupBy("hash").agg(F.min("owner").alias("least"))
    return each.join(least, "hash").where("least < owner").select("anchor", "content", F.col("at").alias("start"), (F.col("at") + window).alias("end"))


def repeated_passages(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, text_key, spans): for each document, the word intervals [start, end) that matches with a smaller doc_id cover.

    Windows of `window` words are dealt to shards by their anchor, so equal windows meet in one shard. Runs of windows
    whose anchor stands in one document only are left out. A shard indexes its distinct segments, under the least
    doc_id that has each; every other document that has a segment has it from that one whole. Backward search gives, for ends from right to left, the longest match with a smaller doc_id,
    and matches of at least `window` words are reported. Anchors with very many distinct segments are compared by
    window hashes instead, which aggregate before the shuffle.
    """
    every = staged(segments(docs, window), "segments")
    anchors = every.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low != high").select("anchor")
    met = staged(every.join(anchors, "anchor"), "met")
    discard(every)
    distinct = met.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "text_key", "first", "windows")).alias("at"))
    distinct = staged(distinct.select("anchor", "content", "at.*"), "distinct")
    hot = staged(distinct.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT_SEGMENTS).select("anchor", F.lit(True).alias("hot")), "hot")
    parts = distinct.join(small(hot), "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = staged(parts.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("anchor", "content", "first", "windows", "hot")).alias("parts")), "wanted")
    held = staged(_with_words(docs, wanted, window), "words")
    total = held.where("not hot").agg(F.sum(F.length("words")) / 8).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_WORDS))
    found = held.where("not hot").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard").applyInPandas(_search(window), _FOUND)
    found = staged(found.union(_by_window(held.where("hot"), window)), "found")
    discard(held, wanted, hot)
    # of a segment's first owner what the search found, of all others the whole
    owners = distinct.select("anchor", "content", F.col("doc_id").alias("owner"))
    per = owners.join(found.groupBy("anchor", "content").agg(F.collect_list(F.struct("start", "end")).alias("spans")), ["anchor", "content"], "left")
    hits = met.join(per, ["anchor", "content"]).withColumn("others", F.col("doc_id") != F.col("owner")).where("others or spans is not null")
    whole = F.array(F.struct(F.col("first").alias("start"), (F.col("first") + F.col("windows") + (window - 1)).alias("end")))
    shifted = F.transform("spans", lambda s: F.struct((s["start"] + F.col("first")).alias("start"), (s["end"] + F.col("first")).alias("end")))
    out = staged(hits.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list(F.when(F.col("others"), whole).otherwise(shifted))).alias("spans")), "spans")
    discard(met, distinct, found)
    return out


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """Removes each word that a window of `window` words covers whose words also start in a document with a smaller doc_id.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text, unchanged; windows are judged on the input. Returns a row per input
    row: doc_id, n_words, n_removed, kept (the kept words joined by one space). A null or empty text has no words; a row
    with a null doc_id keeps all its words and removes none of others'; repeated rows keep theirs alike; an empty table
    gives no rows.
    """
    spans = repeated_passages(docs, window)
    spans = spans.select(F.col("doc_id").alias("of"), F.col("text_key").alias("key"), "spans")
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(spans, (F.col("doc_id") == F.col("of")) & (F.xxhash64("text") == F.col("key")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 1):
                w, counts, removed, kept = Words(part.column(1).to_pylist()), [], [], []
                for i, cover in enumerate(part.column(2).to_pylist()):
                    a, b = w.first[i], w.first[i + 1]
                    keep = np.ones(b - a, bool)
                    for s in cover or ():
                        keep[s["start"] : s["end"]] = False
                    counts.append(b - a)
                    removed.append(b - a - int(keep.sum()))
                    at = np.flatnonzero(keep) + a
                    kept.append(b" ".join([w.buffer[x:y] for x, y in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]).decode())
                yield pa.record_batch([part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return rows.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
