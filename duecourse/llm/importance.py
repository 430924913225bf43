"""Importance resampling towards a target distribution: hashed n-gram weights, Gumbel scores, a distributed quickselect."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duecourse.staging import with_place

from .common import Words, discard, documents, sliced, staged

#: Buckets that n-grams are hashed into.
BUCKETS = 10_000
#: Percent of the documents with at least LEAST_WORDS words that are drawn.
DRAWN_PERCENT = 25
LEAST_WORDS = 20
SEED = 7
#: Random pivot keys in a round of the quickselect.
PIVOTS = 12
#: The composite key, its least first: high scores, then small doc_ids (null last), then the text's hash.
KEY = ("falling", "no_id", "id", "text_key")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CRC = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
#: Words of so many bytes or fewer go through numpy; longer ones one by one.
_SHORT = 32


def _after(x: np.ndarray) -> np.ndarray:
    """What a CRC state becomes by one zero byte more."""
    return _CRC[x & np.uint32(255)] ^ (x >> np.uint32(8))


def _shifts() -> np.ndarray:
    """[n, k, b]: byte k of a state with value b, after n zero bytes. A state shifts by the sum (xor) of its bytes' shifts."""
    rows = [np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32)[:, None] * np.uint32(8))]
    for _ in range(_SHORT):
        rows.append(_after(rows[-1]))
    return np.stack(rows)


_SHIFT = _shifts()
_SPACE = np.uint32(zlib.crc32(b" "))


def ngram_crcs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The CRC32 of each word, and of each word, a space and its successor in the buffer (one fewer)."""
    data = _LOWER[np.frombuffer(words.buffer, np.uint8)]
    start, length = words.start, words.end - words.start
    state = np.full(len(start), 0xFFFFFFFF, np.uint32)
    at = np.flatnonzero(length <= _SHORT)
    for k in range(_SHORT):
        at = at[length[at] > k]
        if not len(at):
            break
        held = state[at]
        state[at] = _CRC[(held ^ data[start[at] + k]) & np.uint32(255)] ^ (held >> np.uint32(8))
    one = ~state
    long = np.flatnonzero(length > _SHORT)
    for i in long:
        one[i] = zlib.crc32(data[start[i] : words.end[i]].tobytes())
    head = _after(one[:-1]) ^ _SPACE
    n = np.minimum(length[1:], _SHORT)
    two = one[1:].copy()
    for k in range(4):
        two ^= _SHIFT[n, k, (head >> np.uint32(8 * k)) & np.uint32(255)]
    for i in long[long > 0]:
        two[i - 1] = zlib.crc32(data[start[i] : words.end[i]].tobytes(), int(head[i - 1]))
    return one, two


def _features(texts: list[str | None]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words, the bucket of each word, that of each word with its successor, and whether that is of the same text."""
    w = Words(texts, lower=True, marks=True)
    if not len(w.start):
        return w, *[np.empty(0, np.int64)] * 2, np.empty(0, bool)
    one, two = (x % np.uint32(BUCKETS) for x in ngram_crcs(w))
    last = np.zeros(len(w.start), bool)
    last[w.first[1:][np.diff(w.first) > 0] - 1] = True
    return w, one.astype(np.int64), two.astype(np.int64), ~last[:-1]


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n) of the features of texts(text): each task counts in an array of BUCKETS, and the arrays are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in sliced(batch, 0):
                _, one, two, inside = _features(part.column(0).to_pylist())
                held += np.bincount(one, minlength=BUCKETS) + np.bincount(two[inside], minlength=BUCKETS)
        some = np.flatnonzero(held)
        yield pa.record_batch([pa.array(some), pa.array(held[some])], ["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket floor(1000 * ln of target share over corpus share), both smoothed by one, in doubles."""
    s, t = corpus.astype(float), target.astype(float)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def gumbel(doc_id: int | None) -> int:
    """A thousand Gumbel units from a hash of seed and doc_id; a null doc_id hashes as an empty one."""
    h = int(hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, text_key, n_words, n_features, weight, score) of docs(doc_id, text): one pass, a few numbers per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 1):
                w, one, two, inside = _features(part.column(1).to_pylist())
                n = np.diff(w.first)
                each = gain[one]
                each[:-1] += np.where(inside, gain[two], 0) if len(one) else 0
                total = np.diff(np.concatenate([[0], np.cumsum(each)])[w.first])
                features = n + np.maximum(n - 1, 0)
                weight = total // np.maximum(features, 1)
                score = weight + np.array([gumbel(d) for d in part.column(0).to_pylist()], np.int64)
                yield pa.record_batch([part.column(0), part.column(2), *map(pa.array, (n, features, weight, score))], ["doc_id", "text_key", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, "doc_id long, text_key long, n_words long, n_features long, weight long, score long")


def _literal(key: tuple) -> Column:
    return F.struct(*[F.lit(x).cast("boolean" if isinstance(x, bool) else "long").alias(k) for k, x in zip(KEY, key, strict=True)])


def kth_key(rows: DataFrame, k: int) -> tuple:
    """The k-th least of the composite keys KEY of rows, 1 <= k <= their number, by a distributed quickselect.

    Each round draws random pivots among the rows that are still possible, those of the least hash under a fresh seed,
    and counts for each pivot the rows before it and equal to it. The k-th key is one of the pivots, or lies between two
    of them; so the rows in question shrink by about a factor of PIVOTS a round. Rounds are aggregates over a narrow
    table; pivots and counts alone reach the driver.
    """
    key = F.struct(*KEY)
    low = high = None
    before = rounds = 0
    while True:
        inside = rows if low is None else rows.where(key > _literal(low))
        inside = inside if high is None else inside.where(key < _literal(high))
        draws = inside.agg(*[F.min_by(key, F.xxhash64(*KEY, F.lit(rounds * PIVOTS + j))) for j in range(PIVOTS)]).first()
        pivots = sorted({tuple(p) for p in draws if p is not None})
        counts = inside.agg(*[c for p in pivots for c in (F.count_if(key < _literal(p)), F.count_if(key == _literal(p)))]).first()
        passed = before
        for p, less, equal in zip(pivots, counts[::2], counts[1::2], strict=True):
            if k <= before + less:
                high = p
                break
            if k <= before + less + equal:
                return p
            low, passed = p, before + less + equal
        before = passed
        rounds += 1


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every row of docs(doc_id, text), towards the texts of target(text).

    Features are runs of one and two words, words [0-9a-z] and all characters beyond ASCII with A-Z in lower case, in
    BUCKETS hash buckets. weight is the mean gain of a document's features and 0 without any; score adds a Gumbel number
    of its doc_id, so that the highest scores are a draw without replacement by weight. Of the documents with at least
    LEAST_WORDS words DRAWN_PERCENT are drawn and ranked; the others' rank is null.

    The bucket counts, BUCKETS numbers whatever the input, go by way of the driver into each task. A quickselect finds
    the last key that is drawn; only the winners are sorted, by ranges. A null text has no words; a null doc_id is drawn
    like another and stands behind equal scores; repeated rows have equal scores and follow each other in rank; rows that
    agree in doc_id stand in the order of their texts' hashes. An empty target leaves the smoothing alone; an empty table
    gives no rows; further columns are ignored.
    """

    def counts(texts: DataFrame) -> np.ndarray:
        out = np.zeros(BUCKETS, np.int64)
        for r in bucket_counts(texts).collect():  # BUCKETS rows at most
            out[r.bucket] = r.n
        return out

    rows = scored(docs, gains(counts(docs), counts(target)))
    order = {"falling": -F.col("score"), "no_id": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0)).cast("long")}
    rows = staged(rows.withColumns(order), "scored")
    out = ["doc_id", "n_words", "n_features", "weight", "score"]
    able = rows.where(F.col("n_words") >= LEAST_WORDS).select(*KEY)
    k = DRAWN_PERCENT * able.count() // 100
    if not k:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    won = (F.col("n_words") >= LEAST_WORDS) & (F.struct(*KEY) <= _literal(kth_key(able, k)))
    placed = with_place(rows.where(won).select(*out, *KEY), *[F.col(c) for c in KEY], name="rank", stored=lambda df: staged(df, "winners"))
    placed = placed.select(*out, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))  # of repeated rows at the end some may be left out
    return placed.unionByName(rows.where(~won).select(*out, F.lit(None).cast("long").alias("rank")))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "n_features", "weight", "score", "rank")
