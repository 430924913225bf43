"""The co-training classifier against a plain, dense version of it."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from duecourse.llm import quality_classifier as Q
from duecourse.llm.common import Words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fit(x, y, weight, ridge):
    """Newton's method with the whole matrix of second derivatives."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], float(ridge))
    penalty[0] = 1e-6
    loss = lambda w: (weight * np.logaddexp(0, -(2 * y - 1) * (x @ w))).sum() + (penalty * w * w).sum() / 2
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (p - y)) + penalty * w)
        part = 1.0
        while loss(w - part * step) > loss(w) and part > 1e-6:
            part /= 2
        w = w - part * step
    return w


def plain_calibrated(x, y, weight, ridge):
    scores = np.zeros(len(y))
    even = np.arange(len(y)) % 2 == 0
    for part in (even, ~even):
        scores[part] = x[part] @ plain_fit(x[~part], y[~part], weight[~part], ridge)
    n = y.sum()
    smooth = np.array([(n + 1) / (n + 2) if v else 1 / (len(y) - n + 2) for v in y])
    b, a = plain_fit(np.column_stack([np.ones(len(y)), scores]), smooth, weight, 1e-3)
    return plain_fit(x, y, weight, ridge), max(a, 0.05), b


def dense(sets, width):
    out = np.zeros((len(sets), width + 1))
    out[:, 0] = 1
    for i, s in enumerate(sets):
        out[i, 1 + np.array(sorted(s), np.int64)] = 1
    return out


@pytest.mark.parametrize("ridge", [0.05, 1.0])
def test_fit_and_calibration_equal_a_dense_solver(ridge):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 30, 6)).astype(np.uint16) for _ in range(150)]
    y = np.array([float((3 in s) or (rng.random() < 0.2)) for s in sets])
    weight = np.where(np.arange(150) < 100, 1.0, 0.5)
    x = dense(sets, 30)
    assert np.allclose(Q.fit(Q.Presence(sets, 30), y, weight, ridge), plain_fit(x, y, weight, ridge), atol=0.02)
    assert np.allclose(Q.fit(Q.Dense(x), y, weight, ridge), plain_fit(x, y, weight, ridge), atol=0.02)
    (w, (a, b)), (v, c, d) = Q.calibrated(Q.Presence(sets, 30), y, weight, ridge), plain_calibrated(x, y, weight, ridge)
    assert np.allclose(w, v, atol=0.02) and abs(a - c) < 0.02 and abs(b - d) < 0.02


def documents():
    rng = random.Random(11)
    good, bad, foul, usual = (["".join(rng.choices("abcdefghijk", k=5)) for _ in range(n)] for n in (25, 25, 12, 60))
    rows, labels = [], []
    for i in range(200):
        poor, toxic = i % 3 == 0, i % 5 == 0
        words = rng.choices(usual, k=20) + rng.choices(bad if poor else good, k=rng.randint(1, 4)) + (rng.choices(foul, k=2) if toxic else [])
        rng.shuffle(words)
        text = (", " if poor else " ").join(words) + ("!!\n#" if poor and rng.random() < 0.6 else ".")
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["web", "books"]) if not poor else rng.choice(["web", "feed", None]), len(text) if i % 7 else None))
        if i < 120:
            labels.append((i, int(not poor), int(toxic)))
    return rows, labels


def test_a_round_of_co_training_equals_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(Q, "ROUNDS", 1)
    monkeypatch.setattr(Q, "PSEUDO", 12)
    rows, labels = documents()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    hashes = {r.doc_id: r for r in df.select("doc_id", F.xxhash64("doc_id", "text").alias("dealt"), F.xxhash64(F.xxhash64("doc_id", "text"), F.lit(0)).alias("turn"), F.pmod(F.xxhash64(F.col("source")), F.lit(Q.SOURCES - 1)).alias("s"), F.pmod(F.xxhash64(F.col("lang")), F.lit(Q.LANGS - 1)).alias("g")).collect()}
    held = {d: set(re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())) for d, t, *_ in rows}
    number = {w: int(Words([w], lower=True, marks=True).hash[0]) for s in held.values() for w in s}
    page = {d: Q.page_numbers(t, len(re.findall(r"[0-9a-z]+", t)), len(held[d]), n, s, g, (hashes[d].s, hashes[d].g)).astype(float) for d, t, g, s, n in rows}
    y = {"poor": {d: float(not q) for d, q, _ in labels}, "toxic": {d: float(t) for d, _, t in labels}}
    # the words that tell most
    vocabulary = set()
    for h in Q.HEADS:
        rate, scored = sum(y[h].values()) / len(labels), []
        for w in number:
            there = [y[h][d] for d, *_ in labels if w in held[d]]
            if len(there) >= Q.LEAST_DOCS:
                z = abs(sum(there) - rate * len(there)) / (rate * (1 - rate) * len(there)) ** 0.5
                if z > 2:
                    scored.append((-z, np.array(number[w], np.uint64).view(np.int64).item(), w))
        vocabulary |= {w for *_, w in sorted(scored)[: Q.VOCABULARY // 2]}
    words = sorted(vocabulary, key=number.get)
    text = {d: dense([{words.index(w) for w in s if w in vocabulary}], len(words))[0] for d, s in held.items()}
    inputs = {"text": text, "page": page}
    training = {(v, h): [(d, y[h][d], 1.0, hashes[d].dealt) for d in y[h]] for v in Q.VIEWS for h in Q.HEADS}

    def fitted():
        out = {}
        for (v, h), given in training.items():
            given = sorted(given, key=lambda r: (-r[2], r[3]))
            x = np.stack([inputs[v][d] for d, *_ in given])
            out[v, h] = plain_calibrated(x, np.array([r[1] for r in given]), np.array([r[2] for r in given]), Q.RIDGE[v])
        return out

    logit = lambda model, v, h, d: model[v, h][1] * float(inputs[v][d] @ model[v, h][0]) + model[v, h][2]
    prior = {h: np.log((sum(y[h].values()) + 1) / (len(labels) - sum(y[h].values()) + 1)) for h in Q.HEADS}
    first = fitted()
    for v, other in (("text", "page"), ("page", "text")):
        for h in Q.HEADS:
            sure = {side: sorted((hashes[d].turn, d) for d in held if (logit(first, v, h, d) > np.log(19) if side else logit(first, v, h, d) < -np.log(19)))[:12] for side in (0.0, 1.0)}
            rate = 1 / (1 + np.exp(-prior[h]))
            n = min(12, len(sure[1.0]) / rate, len(sure[0.0]) / (1 - rate))
            for side, share in ((1.0, rate), (0.0, 1 - rate)):
                training[other, h] += [(d, side, 0.5, turn) for turn, d in sure[side][: round(n * share)]]
    last = fitted()
    assert any(len(t) > len(labels) for t in training.values())
    got = {r.doc_id: r for r in Q.classify(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    for d in held:
        for h in Q.HEADS:
            p = 1 / (1 + np.exp(-(logit(last, "text", h, d) + logit(last, "page", h, d) - prior[h])))
            assert abs(got[d][f"p_{h}"] - p) < 0.03, (d, h)
    right = sum((got[d].p_poor > 0.5) == (d % 3 == 0) for d in range(120, 200))
    assert right >= 72


def test_clashing_columns_stay(spark):
    rows, labels = documents()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"__source": F.lit("mine"), "__lang": F.lit("mine")})
    out = Q.classify(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert out.columns == [*df.columns, "p_poor", "p_toxic", "kept"]
    assert {(r["__source"], r["__lang"]) for r in out.collect()} == {("mine", "mine")}
