"""Quality classifier by co-training of a text-content and a page-metadata view."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Words, discard, documents, free, lists, released, signed, sliced, staged

#: Labelled rows that the first fit takes at most, in order of a hash of doc_id.
LABELLED = 8000
#: Words that the text view looks at: those whose presence tells most about each label, among at least so many documents.
VOCABULARY = 1024
LEAST_DOCS = 4
#: Rounds in which each view labels rows for the other: for each label so many at most, of rows it is so sure of, both
#: sides in the proportion that the labels have, so that pseudo-labels don't move what a view takes for usual.
ROUNDS = 2
PSEUDO = 300
SURE = 0.95
#: The two labels that are predicted: of low quality, toxic.
HEADS = ("poor", "toxic")
VIEWS = ("text", "page")
#: Numbers that describe a page's make-up, and buckets that a hash deals its source and its language to.
LAYOUT = 17
SOURCES, LANGS = 64, 16
PAGE = 1 + 2 * LAYOUT + SOURCES + LANGS
RIDGE = {"text": 1.0, "page": 0.05}

_FEATURES = "dealt long, present binary, page binary"
_TRAINING = f"{_FEATURES}, view string, head string, y double, weight double"


def page_numbers(text: str, words: int, distinct: int, n_chars: int | None, source: str | None, lang: str | None, buckets: tuple[int, int]) -> np.ndarray:
    """The metadata view of a page: its size as stored, the make-up and repetition of its characters, words and lines,
    its source and language, not which words it has. Null metadata has numbers of its own: no size, and the last bucket."""
    raw = np.frombuffer(text.encode(), np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=7)[:7] / max(1, len(raw))
    lines = [x for x in text.split("\n") if x.strip()]
    n = max(1, len(text))
    stored = n if n_chars is None else max(0, n_chars)
    numbers = np.array([
        np.log1p(stored) / 10, n_chars is None, n_chars is not None and n_chars != len(text), np.log1p(words) / 10, distinct / max(1, words),
        len(lines) / n, len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))) / 10, n / max(1, words) / 10, *kinds, not text,
    ])
    out = np.zeros(PAGE, np.float32)
    out[0] = 1
    out[1 : LAYOUT + 1], out[LAYOUT + 1 : 2 * LAYOUT + 1] = numbers, numbers**2
    out[2 * LAYOUT + 1 + (SOURCES - 1 if source is None else buckets[0])] = 1
    out[2 * LAYOUT + 1 + SOURCES + (LANGS - 1 if lang is None else buckets[1])] = 1
    return out


#: Lower case, upper case, digit, space, sentence mark, other ASCII mark, beyond ASCII.
_KIND = np.full(256, 6, np.int64)
_KIND[:128] = 5
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n", b".,")):
    _KIND[list(_chars)] = _k


class Dense:
    """Rows of numbers; column 0 is the intercept."""

    def __init__(self, x: np.ndarray):
        self.x, self.width = x, x.shape[1]

    def __len__(self) -> int:
        return len(self.x)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.x @ w

    def back(self, r: np.ndarray) -> np.ndarray:
        return r @ self.x

    def take(self, mask: np.ndarray) -> Dense:
        return Dense(self.x[mask])

    @staticmethod
    def read(pages: list[bytes]) -> Dense:
        return Dense(np.frombuffer(b"".join(pages), np.float32).reshape(-1, PAGE).astype(np.float64))


class Presence:
    """Rows that say which words of the vocabulary are there, by the numbers of these; an intercept comes before them."""

    def __init__(self, present: list[np.ndarray], width: int):
        self.present, self.width = present, width + 1
        self.row = np.repeat(np.arange(len(present)), [len(p) for p in present])
        self.column = np.concatenate([*present, np.empty(0, np.uint16)]).astype(np.int64) + 1

    def __len__(self) -> int:
        return len(self.present)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return w[0] + np.bincount(self.row, w[self.column], len(self))

    def back(self, r: np.ndarray) -> np.ndarray:
        out = np.bincount(self.column, r[self.row], self.width)
        out[0] = r.sum()
        return out

    def take(self, mask: np.ndarray) -> Presence:
        return Presence([p for p, m in zip(self.present, mask, strict=True) if m], self.width - 1)

    @staticmethod
    def read(present: list[bytes], width: int) -> Presence:
        return Presence([np.frombuffer(p, np.uint16) for p in present], width)


@dataclass
class View:
    """A logistic regression per head, with Platt scaling."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    scale: dict[str, tuple[float, float]] = field(default_factory=dict)

    def logit(self, head: str, x: Dense | Presence) -> np.ndarray:
        a, b = self.scale[head]
        return a * x.dot(self.weights[head]) + b


@dataclass
class Model:
    vocabulary: np.ndarray
    views: dict[str, View]
    prior: dict[str, float]

    def inputs(self, present: list[bytes], pages: list[bytes]) -> dict[str, Dense | Presence]:
        return {"text": Presence.read(present, len(self.vocabulary)), "page": Dense.read(pages)}

    def combined(self, head: str, x: dict[str, Dense | Presence]) -> np.ndarray:
        """Both views' calibrated log odds; the prior, which each has in it, counts once."""
        return sigmoid(sum(self.views[v].logit(head, x[v]) for v in VIEWS) - self.prior[head])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: Dense | Presence, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge logistic regression by Newton's method with halved steps, each solved by conjugate gradients."""
    w, penalty = np.zeros(x.width), np.full(x.width, ridge)
    penalty[0] = 1e-6
    loss = lambda w: (weight * np.logaddexp(0, -(2 * y - 1) * x.dot(w))).sum() + (penalty * w * w).sum() / 2
    now = loss(w)
    for _ in range(25):
        p = sigmoid(x.dot(w))
        curve = weight * p * (1 - p)
        step, left = np.zeros(x.width), x.back(weight * (p - y)) + penalty * w
        way, size = left.copy(), left @ left
        small = 1e-8 * size
        for _ in range(200):
            if size <= small:
                break
            bent = x.back(curve * x.dot(way)) + penalty * way
            go = size / (way @ bent)
            step, left = step + go * way, left - go * bent
            size, was = left @ left, size
            way = left + size / was * way
        part = 1.0
        while (new := loss(w - part * step)) > now and part > 1e-4:
            part /= 2
        w, gain, now = w - part * step, now - new, min(now, new)
        if gain < 1e-5 * (1 + abs(now)):
            break
    return w


def calibrated(x: Dense | Presence, y: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[np.ndarray, tuple[float, float]]:
    """Weights from all rows, and Platt's scale from scores that a fit on the other half of the rows gave each."""
    w, scores = fit(x, y, weight, ridge), np.zeros(len(y))
    half = np.arange(len(y)) % 2 == 0
    for part in (half, ~half):
        scores[part] = x.take(part).dot(fit(x.take(~part), y[~part], weight[~part], ridge))
    smooth = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    b, a = fit(Dense(np.column_stack([np.ones(len(y)), scores])), smooth, weight, 1e-3)
    return w, (max(a, 0.05), b)


def _parts(batches: Iterator[pa.RecordBatch], at: dict[str, int | None]) -> Iterator[tuple[pa.RecordBatch, Words, list[bytes]]]:
    """Runs of rows with their words and pages; `at` has the place of text, n_chars, source and lang, and of the buckets."""
    for batch in batches:
        for part in sliced(batch, at["text"]):
            blank = [None] * part.num_rows
            texts, sizes, sources, langs = (part.column(at[k]).to_pylist() if at[k] is not None else blank for k in ("text", "n_chars", "source", "lang"))
            dealt = zip(part.column(at["__source"]).to_pylist(), part.column(at["__lang"]).to_pylist(), strict=True)
            w = Words(texts, lower=True, marks=True)
            held = [w.of(i) for i in range(part.num_rows)]
            pages = [page_numbers(t or "", len(h), len(np.unique(h)), n, s, k, b).tobytes() for t, h, n, s, k, b in zip(texts, held, sizes, sources, langs, dealt, strict=True)]
            yield part, w, pages


def _present(held: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    if not len(vocabulary):
        return np.empty(0, np.uint16)
    at = np.searchsorted(vocabulary, held)
    at[at == len(vocabulary)] = 0
    return np.unique(at[vocabulary[at] == held]).astype(np.uint16)


def _presence(w: Words, vocabulary: np.ndarray) -> list[bytes]:
    return [_present(w.of(i), vocabulary).tobytes() for i in range(len(w.first) - 1)]


def _buckets(rows: DataFrame, names: tuple[str, str] = ("__source", "__lang")) -> DataFrame:
    """rows with the buckets of source and language, the last two columns."""
    deal = lambda k, n: F.pmod(F.xxhash64(F.col(k).cast("string")), F.lit(n - 1)).cast("int") if k in rows.columns else F.lit(0)
    return rows.withColumns(dict(zip(names, (deal("source", SOURCES), deal("lang", LANGS)), strict=True)))


_INPUT = ("text", "n_chars", "source", "lang")


def _inputs(docs: DataFrame) -> DataFrame:
    kinds = {"n_chars": "long"}
    present = lambda k: (F.col(k) if k in docs.columns else F.lit(None)).cast(kinds.get(k, "string")).alias(k)
    return _buckets(docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("dealt"), *[present(k) for k in _INPUT]))


def _places(rows: DataFrame) -> dict[str, int | None]:
    """Where the inputs are, and the buckets, which _buckets() put last."""
    width = len(rows.columns)
    return {k: rows.columns.index(k) if k in rows.columns else None for k in _INPUT} | {"__source": width - 2, "__lang": width - 1}


def _labelled(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, dealt, words, page, poor, toxic): a row per labelled document, with the hashes of all its words."""
    sample = rows.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    at = _places(sample)
    ids = [sample.columns.index(k) for k in ("doc_id", "dealt")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, w, pages in _parts(batches, at):
            held = [signed(np.unique(w.of(i))) for i in range(len(w.first) - 1)]
            yield pa.record_batch([*[part.column(k) for k in ids], lists(held, pa.int64()), pa.array(pages, pa.binary())], ["doc_id", "dealt", "words", "page"])

    got = sample.mapInArrow(released(run), "doc_id long, dealt long, words array<long>, page binary")
    once = got.groupBy("doc_id").agg(F.min_by(F.struct("dealt", "words", "page"), "dealt").alias("x")).select("doc_id", "x.*")  # of repeated ids one row
    return once.join(F.broadcast(known), "doc_id")


def _telling(labelled: DataFrame, total: dict[str, float], n: int) -> np.ndarray:
    """The sorted hashes of the words whose presence differs most between the sides of a head, by a z-score."""
    counts = labelled.select(F.explode("words").alias("word"), *HEADS).groupBy("word").agg(F.count("*").alias("docs"), *[F.sum(h).alias(h) for h in HEADS]).where(F.col("docs") >= LEAST_DOCS)
    counts, found = staged(counts, "counts"), set()
    for h in HEADS:
        rate = total[h] / n
        z = F.abs(F.col(h) - rate * F.col("docs")) / F.sqrt(rate * (1 - rate) * F.col("docs"))
        found |= {r.word for r in counts.select("word", z.alias("z")).where("z > 2").orderBy(F.desc("z"), "word").limit(VOCABULARY // len(HEADS)).collect()}
    discard(counts)
    return np.sort(np.array(sorted(found), np.int64).view(np.uint64))


def _fitted(training: DataFrame, width: int) -> dict[str, View]:
    """Both views' models of both heads, each fitted in a task of its own from the bounded sample; the weights are collected."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        view, head = key
        rows = rows.sort_values(["weight", "dealt"], ascending=[False, True])
        x = Presence.read(rows.present.tolist(), width) if view == "text" else Dense.read(rows.page.tolist())
        w, (a, b) = calibrated(x, rows.y.to_numpy(), rows.weight.to_numpy(), RIDGE[view])
        return pd.DataFrame({"view": [view], "head": [head], "w": [w], "a": [a], "b": [b]})

    views = {v: View() for v in VIEWS}
    for r in training.groupBy("view", "head").applyInPandas(run, "view string, head string, w array<double>, a double, b double").collect():
        views[r.view].weights[r.head], views[r.view].scale[r.head] = np.array(r.w), (r.a, r.b)
    return views


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Co-trains the two views. docs(doc_id, text, n_chars, source, lang), labels(doc_id, quality, toxic); None without usable labels.

    The first fit takes at most LABELLED labelled rows. In each round every view scores all documents; of those it is
    sure of (SURE), it gives the other view PSEUDO rows more for each label, in order of a hash, and both are fitted
    again. Pseudo-labels weigh half. Words are counted and models are fitted in tasks; the vocabulary and the weights
    alone reach the driver.
    """
    known = labels.select(F.col("doc_id").cast("long"), (F.col("quality") == 0).cast("double").alias("poor"), (F.col("toxic") == 1).cast("double").alias("toxic")).where("doc_id is not null and poor is not null and toxic is not null")
    known = staged(known.groupBy("doc_id").agg(F.max("poor").alias("poor"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED), "known")
    rows = _inputs(docs)
    labelled = staged(_labelled(rows, known), "labelled")
    n, *sums = labelled.agg(F.count("*"), *[F.sum(h) for h in HEADS]).first()
    if not n or any(s in (0, n) for s in sums):
        discard(known, labelled)
        return None
    total = dict(zip(HEADS, sums, strict=True))
    vocabulary = _telling(labelled, total, n)
    at = _places(rows)
    dealt = rows.columns.index("dealt")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, w, pages in _parts(batches, at):
            yield pa.record_batch([part.column(dealt), pa.array(_presence(w, vocabulary), pa.binary()), pa.array(pages, pa.binary())], ["dealt", "present", "page"])

    def known_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                held = [_present(np.array(x, np.int64).view(np.uint64), vocabulary).tobytes() for x in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(held, pa.binary()), *[part.column(k) for k in (2, 3, 4)]], ["dealt", "present", "page", *HEADS])

    every = staged(rows.mapInArrow(released(features), _FEATURES), "features")
    given = labelled.select("dealt", "words", "page", *HEADS).mapInArrow(released(known_features), f"{_FEATURES}, poor double, toxic double")
    per = F.explode(F.array(*[F.struct(F.lit(v).alias("view"), F.lit(h).alias("head"), F.col(h).alias("y")) for v in VIEWS for h in HEADS]))
    training = staged(given.select("dealt", "present", "page", per.alias("x")).select("dealt", "present", "page", "x.*", F.lit(1.0).alias("weight")), "training")
    held = [known, labelled, every, training]
    model = Model(vocabulary, _fitted(training, len(vocabulary)), {h: float(np.log((total[h] + 1) / (n - total[h] + 1))) for h in HEADS})
    for turn in range(ROUNDS):
        sure = _confident(every, model, turn)
        held.append(sure)
        training = training.union(sure.select(training.columns))
        model.views = _fitted(training, len(vocabulary))
    discard(*held)
    return model


def _confident(features: DataFrame, model: Model, turn: int) -> DataFrame:
    """Training rows for each view from what the other is sure of: at most PSEUDO per view and head, sides in the labels'
    proportion, the first by a hash; each task keeps its first, and so does the whole."""
    edge = float(np.log(SURE / (1 - SURE)))
    other = {"text": "page", "page": "text"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, list] = {}
        for batch in batches:
            for part in sliced(batch, 2):
                order, present, pages = (part.column(k).to_pylist() for k in range(3))
                x = model.inputs(present, pages)
                for v in VIEWS:
                    for h in HEADS:
                        z = model.views[v].logit(h, x[v])
                        for side in (0.0, 1.0):
                            new = [(order[i], present[i], pages[i]) for i in np.flatnonzero(z > edge if side else z < -edge)]
                            key = (other[v], h, side)
                            kept[key] = sorted({r[0]: r for r in kept.get(key, []) + new}.values())[:PSEUDO]
        out = [(*r, *key, 0.5) for key, rows in kept.items() for r in rows]
        if out:
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["dealt", "present", "page", "view", "head", "y", "weight"])

    few = features.withColumn("dealt", F.xxhash64("dealt", F.lit(turn))).mapInArrow(released(run), _TRAINING)
    place = F.row_number().over(Window.partitionBy("view", "head", "y").orderBy("dealt"))
    first = staged(few.dropDuplicates(["view", "head", "y", "dealt"]).withColumn("place", place).where(F.col("place") <= PSEUDO), "first")
    there = {(r.view, r.head, r.y): r["count"] for r in first.groupBy("view", "head", "y").count().collect()}  # two views, two heads, two sides
    most = F.lit(0)
    for v in VIEWS:
        for h in HEADS:
            rate = float(sigmoid(np.array(model.prior[h])))
            share = {1.0: rate, 0.0: 1 - rate}
            n = min([PSEUDO, *[there.get((v, h, y), 0) / s for y, s in share.items()]])
            for y, s in share.items():
                most = F.when((F.col("view") == v) & (F.col("head") == h) & (F.col("y") == y), round(n * s)).otherwise(most)
    out = staged(first.where(F.col("place") <= most).drop("place"), "confident")
    discard(first)
    return out


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Every row and column of docs with p_poor, p_toxic and kept (neither above the threshold).

    A null or empty text gets a score from its metadata and the lack of words; null n_chars, lang or source counts as
    unknown, as does a column that isn't there; repeated rows get equal scores; without labels of both sides nothing can
    be learnt, so the scores are null and all rows are kept; an empty table stays empty. Columns of docs that are named
    like the new ones are replaced.
    """
    docs = docs.drop("p_poor", "p_toxic", "kept")
    model = train(docs, labels)
    added = [T.StructField("p_poor", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    if model is None:
        return docs.withColumns({"p_poor": F.lit(None).cast("double"), "p_toxic": F.lit(None).cast("double"), "kept": F.lit(True)})
    rows = _buckets(docs, tuple(free(docs.columns, "__source", "__lang")))
    at, width = _places(rows), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, w, pages in _parts(batches, at):
            x = model.inputs(_presence(w, model.vocabulary), pages)
            p = {h: model.combined(h, x) for h in HEADS}
            kept = (p["poor"] <= threshold) & (p["toxic"] <= threshold)
            yield pa.record_batch([*part.columns[:width], pa.array(p["poor"]), pa.array(p["toxic"]), pa.array(kept)], [*part.schema.names[:width], "p_poor", "p_toxic", "kept"])

    return rows.mapInArrow(released(run), T.StructType([*docs.schema.fields, *added]))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(documents(spark, sf_dir), labels).select("doc_id", F.round("p_poor", 6).alias("p_poor"), F.round("p_toxic", 6).alias("p_toxic"), "kept")
