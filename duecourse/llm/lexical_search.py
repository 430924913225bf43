"""Exact top-k lexical search by inner products over sparse ball trees."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Words, discard, documents, lists, sliced, staged

#: Documents that an item gets at most.
TOP = 10
#: Distinct terms that the items of a block have together; items beyond go into the next block, another pass.
BLOCK_TERMS = 16_384
#: Documents of a tree, and of a leaf.
TREE = 2048
LEAF = 32

VECTORS = "doc_id long, n long, terms array<int>, counts array<int>"


def item_blocks(items: DataFrame, most: int = BLOCK_TERMS) -> Iterator[list[tuple]]:
    """Runs of (item_id, hashes of its distinct terms) with at most `most` distinct terms together (or one item), one run at a time."""
    block, held = [], np.empty(0, np.uint64)
    for r in items.select("item_id", "text").toLocalIterator():
        own = np.unique(Words([r.text], lower=True, marks=True).hash)
        more = np.union1d(held, own)
        if block and len(more) > most:
            yield block
            block, more = [], own
        block.append((r.item_id, own))
        held = more
    if block:
        yield block


def vectors(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, counts) of docs(doc_id, text): how many terms a text has, and those of the sorted vocabulary, by position, with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 1):
                w = Words(part.column(1).to_pylist(), lower=True, marks=True)
                n = np.diff(w.first)
                at = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
                known = vocabulary[at] == w.hash
                cell, counts = np.unique((np.repeat(np.arange(len(n)), n) * len(vocabulary) + at)[known], return_counts=True)
                cut = np.searchsorted(cell, np.arange(1, len(n)) * len(vocabulary))
                split = lambda x: lists(np.split(x.astype(np.int32), cut), pa.int32())
                yield pa.record_batch([part.column(0), pa.array(n), split(cell % len(vocabulary)), split(counts)], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, VECTORS)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0, and values."""
    ends = column.offsets.to_numpy()
    return ends - ends[0], column.values.to_numpy()[ends[0] : ends[-1]]


def frequencies(table: DataFrame, size: int) -> np.ndarray:
    """How many rows of vectors() have each term; added up per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(_flat(batch.column(0))[1], minlength=size)
        some = np.flatnonzero(held)
        yield pa.record_batch([pa.array(some), pa.array(held[some])], ["term", "df"])

    out = np.zeros(size, np.int64)
    for r in table.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row per term of the block
        out[r.term] = r.df
    return out


class BallTree:
    """A binary tree over sparse integer vectors: each node has its vectors' centroid, the radius of the ball around it
    that holds them, and for each term the radius along its axis; each leaf has a run of the vectors, which are reordered.

    Vectors come as offsets, terms and values, all positive; ids are the documents' (the largest number for null).
    """

    def __init__(self, ends: np.ndarray, terms: np.ndarray, values: np.ndarray, ids: np.ndarray, size: int, leaf: int = LEAF):
        self.ends, self.terms, self.values, self.ids, self.size, self.leaf = ends, terms, values, ids, size, leaf
        self.row = np.arange(len(ids))
        self.low, self.high, self.left, self.right = [], [], [], []
        self._grow(0, len(ids))
        n = len(self.low)
        self.centroid, self.reach = np.zeros((n, size)), np.zeros((n, size))
        self.radius, self.first_id = np.zeros(n), np.zeros(n, np.int64)
        for k in reversed(range(n)):  # children come after their parents
            self._measure(k)

    def _dot(self, low: int, high: int, vector: np.ndarray) -> np.ndarray:
        a, b = self.ends[low], self.ends[high]
        return np.add.reduceat(self.values[a:b] * vector[self.terms[a:b]], self.ends[low:high] - a)

    def _dense(self, i: int) -> np.ndarray:
        out = np.zeros(self.size)
        a, b = self.ends[i], self.ends[i + 1]
        out[self.terms[a:b]] = self.values[a:b]
        return out

    def _grow(self, low: int, high: int) -> int:
        """Splits at the median along the line between a vector far from another and one far from that."""
        k = len(self.low)
        for x, v in ((self.low, low), (self.high, high), (self.left, -1), (self.right, -1)):
            x.append(v)
        if high - low <= self.leaf:
            return k
        a, b = self.ends[low], self.ends[high]
        square = np.add.reduceat(self.values[a:b].astype(float) ** 2, self.ends[low:high] - a)
        far = low + int(np.argmax(square - 2 * self._dot(low, high, self._dense(low))))
        one = self._dense(far)
        other = self._dense(low + int(np.argmax(square - 2 * self._dot(low, high, one))))
        order = np.argsort(self._dot(low, high, other - one), kind="stable")
        self._reorder(low, high, order)
        middle = (low + high) // 2
        self.left[k] = self._grow(low, middle)
        self.right[k] = self._grow(middle, high)
        return k

    def _reorder(self, low: int, high: int, order: np.ndarray) -> None:
        a, b = self.ends[low], self.ends[high]
        length = np.diff(self.ends[low : high + 1])[order]
        ends = np.concatenate([[0], np.cumsum(length)])
        take = np.repeat(self.ends[low:high][order] - ends[:-1], length) + np.arange(b - a)
        self.terms[a:b], self.values[a:b] = self.terms[take], self.values[take]
        self.ends[low : high + 1] = a + ends
        self.ids[low:high] = self.ids[low:high][order]

    def _measure(self, k: int) -> None:
        low, high = self.low[k], self.high[k]
        a, b = self.ends[low], self.ends[high]
        if self.left[k] < 0:
            self.centroid[k] = np.bincount(self.terms[a:b], self.values[a:b], self.size) / (high - low)
            np.maximum.at(self.reach[k], self.terms[a:b], self.values[a:b])
        else:
            x, y = self.left[k], self.right[k]
            share = (self.high[x] - self.low[x]) / (high - low)
            self.centroid[k] = self.centroid[x] * share + self.centroid[y] * (1 - share)
            self.reach[k] = np.maximum(self.reach[x], self.reach[y])
        centre = float(self.centroid[k] @ self.centroid[k])
        square = np.add.reduceat(self.values[a:b].astype(float) ** 2, self.ends[low:high] - a)
        apart = square - 2 * self._dot(low, high, self.centroid[k]) + centre
        # rounding takes less than 1e-11 of the squares for up to 10,000 terms, and is allowed for
        self.radius[k] = math.sqrt(max(0.0, float((apart + (square + centre) * 1e-11).max()))) * (1 + 1e-12)
        self.first_id[k] = self.ids[low:high].min()

    def bounds(self, weights: np.ndarray) -> np.ndarray:
        """[node, item]: no inner product of the node's vectors with the item's weights (terms x items, not negative) is above.

        The lesser of two: the centroid's product plus the radius times the weights' length; and along the axes the
        centroid plus the radius there, which is the largest value. The second is a sum of integers below 2^53, so exact;
        the first is rounded up.
        """
        ball = self.centroid @ weights + self.radius[:, None] * np.sqrt((weights**2).sum(0))
        return np.minimum(np.ceil(ball * (1 + 1e-9)), self.reach @ weights)

    def scores(self, k: int, weight: np.ndarray) -> np.ndarray:
        """The inner products of a leaf's vectors with an item's integer weights."""
        return self._dot(self.low[k], self.high[k], weight)


def search(tree: BallTree, weights: np.ndarray, best: list[list[tuple]], top: int = TOP) -> int:
    """Adds the tree's documents to each item's best, (-score, doc_id) in order, `top` at most and scores above 0.

    Nodes are opened best-first by their bounds, until the bound is below the item's last score, or equals it and all
    doc_ids of the node are larger. Returns how many leaves were scored.
    """
    bounds = tree.bounds(weights.astype(float))
    opened = 0
    for item, held in enumerate(best):
        weight = weights[:, item]
        open_nodes = [(-bounds[0, item], 0)]
        while open_nodes:
            bound, k = heapq.heappop(open_nodes)
            last = held[-1] if len(held) == top else (0, -1)
            if -bound < -last[0] or (-bound == -last[0] and tree.first_id[k] > last[1]):
                if -bound < -last[0]:
                    break
                continue
            if tree.left[k] >= 0:
                for x in (tree.left[k], tree.right[k]):
                    heapq.heappush(open_nodes, (-bounds[x, item], x))
                continue
            opened += 1
            score = tree.scores(k, weight)
            some = np.flatnonzero((score > 0) & (score >= -last[0]))
            if len(some):
                held += zip((-score[some]).tolist(), tree.ids[tree.low[k] + some].tolist(), strict=True)
                held.sort()
                del held[top:]
    return opened


_NO_ID = np.iinfo(np.int64).max


def _search_block(docs: DataFrame, items: list[np.ndarray]) -> DataFrame:
    """(item, doc_id, score), the best of each task, for the items, sets of terms."""
    vocabulary = np.unique(np.concatenate(items))
    table = staged(vectors(docs, vocabulary), "vectors")
    n_docs, n_terms = table.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = frequencies(table, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    weights = np.zeros((len(vocabulary), len(items)), np.int64)
    for k, own in enumerate(items):
        at = np.searchsorted(vocabulary, own)
        weights[at, k] = weight[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in items]
        for batch in batches:
            for at in range(0, batch.num_rows, TREE):
                rows = batch.slice(at, TREE)
                (ends, terms), (_, counts) = _flat(rows.column(2)), _flat(rows.column(3))
                ids, n = rows.column(0).fill_null(_NO_ID).to_numpy(), rows.column(1).to_numpy()
                m = np.repeat(10 + (90 * n * n_docs) // n_terms, np.diff(ends))
                tf = counts.astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(np.diff(ends))]).astype(np.int64)
                search(BallTree(ends, terms.copy(), 1_000_000_000 * tf // (1000 * tf + 8 * m), ids.copy(), len(vocabulary)), weights, best)
        out = [(k, None if d == _NO_ID else d, -s) for k, held in enumerate(best) for s, d in held]
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item", "doc_id", "score"])

    found = staged(table.where(F.size("terms") > 0).mapInArrow(run, "item int, doc_id long, score long"), "found")
    discard(table)
    return found


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items(item_id, text) its `top` best rows of docs(doc_id, text) with score above 0.

    Terms are runs of 0-9, a-z (A-Z in lower case) and all characters beyond ASCII, in whole texts. The score is an
    inner product of integer weights of an item's terms and integer values that grow with a term's occurrences and fall
    with the text's length (see _search_block); equal scores stand in the order of doc_id.

    Items go in blocks with a bounded vocabulary. A block is one pass over the texts for the terms' occurrences, a few
    sums, and a search in which each task builds ball trees over a few thousand documents at a time, goes through them
    best-first and keeps each item's best from tree to tree; the tasks' best meet by item. A text or an item without
    terms, or null, is ranked nowhere and gets nothing; null doc_ids stand last among equal scores; repeated rows are
    ranked each; repeated items get their rows each; empty tables give no rows; further columns are ignored.
    """
    kind = items.schema["item_id"].dataType
    named = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)])
    schema = T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    out = None
    for block in item_blocks(items):
        block = [(i, own) for i, own in block if len(own)]
        if not block:
            continue
        found = _search_block(docs, [own for _, own in block])
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = docs.sparkSession.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], named)
        part = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # a block's items
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
#: The same in DuckDB, for tables whose ids are unique.
ORACLE = f"""
WITH terms AS (SELECT doc_id, {_TERMS} FROM documents),
sought AS (SELECT DISTINCT item_id, {_TERMS} FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
sums AS (SELECT count(*) AS docs, sum(n)::BIGINT AS all_terms FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, sums WHERE term IN (SELECT term FROM sought) GROUP BY term),
lengths AS (SELECT doc_id, 100 - 90 + ((90 * n * docs) // all_terms) AS m FROM sizes, sums),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM sought JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id) GROUP BY ALL HAVING score > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored QUALIFY rank <= {TOP}
"""
