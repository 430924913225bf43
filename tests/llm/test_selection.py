"""Exact dedup, importance resampling and lexical search against brute force on small tables with odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, corpus

from duecourse.llm import exact_dedup, importance, lexical_search
from duecourse.llm.common import Words

LOWER = {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
#: Names that the operators use for their own columns.
CLASH = ["bucket", "bits", "n", "best_id", "_group", "_full", "_row", "_text", "_again", "keep_id", "rank", "score", "falling", "id", "terms", "term", "item", "lang", "_part", "_offset"]


def rows():
    out = [(d, t) for d, t, *_ in corpus()]
    return [*out, (90, "Éa B"), (91, "éa b"), (92, "Éa b"), (93, out[3][1].upper()), (94, "İstanbul"), (95, "i̇stanbul"), (200, "x" * 64 + "y"), (201, "x" * 64 + "z"), (202, "X" * 64 + "Y")]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    return plain.withColumns({c: F.lit("clash") for c in CLASH}).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_copies(docs, none):
    groups = collections.defaultdict(list)
    for d, t in rows():
        groups[(t or "").translate(LOWER)].append(d)
    best = {t: max((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    want = collections.Counter((d, best[(t or "").translate(LOWER)], len(groups[(t or "").translate(LOWER)]), hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest(), len(t or "")) for d, t in rows())
    got = exact_dedup.exact_copies(docs, {"text_sha256": F.sha2(exact_dedup.normalised(F.col("text")), 256), "n_chars": F.length(F.coalesce("text", F.lit("")))}).collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256, r.n_chars) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.exact_copies(none).isEmpty()


def test_exact_copies_reads_survivors_only(spark, docs):
    bitmaps = exact_dedup._repeated(spark.createDataFrame([(k,) for k in [5, 5, -7, -7, 8, 1 << 40, 1 << 40, (1 << 27) - 1, (1 << 27) - 1]], "key long"))
    passed = exact_dedup._in_filter(spark.createDataFrame([(k,) for k in [5, -7, 8, 9, 1 << 40, (1 << 27) - 1, None]], "key long"), "key", bitmaps, "again")
    assert {r.key for r in passed.where("again").collect()} == {5, -7, 1 << 40, (1 << 27) - 1}
    plan = exact_dedup.exact_copies(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def test_ngram_crcs():
    texts = ["Hello wörld a1 b2-c", "x" * 100 + " y " + "z" * 33 + " " + "q" * 32, "", None, "one"]
    w = Words(texts, lower=True, marks=True)
    one, two = importance.ngram_crcs(w)
    flat = [x for t in texts for x in terms(t)]
    assert one.tolist() == [zlib.crc32(x.encode()) for x in flat]
    assert two.tolist() == [zlib.crc32(f"{a} {b}".encode()) for a, b in zip(flat, flat[1:], strict=False)]


def plain_resample(docs, target):
    def features(t):
        w = terms(t)
        return [zlib.crc32(x.encode()) % 10000 for x in [*w, *map(" ".join, zip(w, w[1:], strict=False))]]

    s, t = (collections.Counter(b for x in texts for b in features(x)) for texts in ([t for _, t in docs], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    out = []
    for d, text in docs:
        f = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * (n_s + 10000.0) / ((s[b] + 1.0) * (n_t + 10000.0)))) for b in f) // max(1, len(f))
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(terms(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, able[: 25 * len(able) // 100]


def test_resample(spark, docs, none):
    target = [rows()[0][1], rows()[5][1], None, "", rows()[81][1]]
    got = importance.resample(docs, spark.createDataFrame([(t, 1) for t in target], "text string, n int")).collect()
    out, drawn = plain_resample(rows(), target)
    assert collections.Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == collections.Counter(out)
    won = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in won] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.score) for r in won] == [(r[0], r[4]) for r in drawn]
    assert importance.resample(none, none).isEmpty()
    assert {r["rank"] for r in importance.resample(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), none).collect()} == {None}


def test_quickselect_finds_every_place(spark):
    rng = random.Random(3)
    keys = sorted([(rng.randint(-5, 5), rng.random() < 0.2, rng.randint(0, 3), rng.randint(-9, 9)) for _ in range(300)] + [(0, False, 1, 1)] * 40)
    df = spark.createDataFrame(keys, "falling long, no_id boolean, id long, text_key long").repartition(4).cache()
    for k in (1, 2, 77, 150, 170, 339, 340):
        assert importance.kth_key(df, k) == keys[k - 1]


def plain_search(docs, items, top=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    bags = [(d, collections.Counter(words(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for i, text in items:
        found = []
        for d, b in bags:
            m = 10 + (90 * sum(b.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in set(words(text)) if b[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found)[:top])]
    return out


def items():
    rng = random.Random(5)
    held = [t for _, t in rows() if t]
    return [*[(k, " ".join(rng.choices(held[k].split(), k=12))) for k in range(20)], (20, None), (21, " .,"), (22, "no such words qqqq"), (23, held[3]), (23, held[3]), (None, held[8]), (24, "éa B i̇stanbul")]


def test_ranked_equals_brute_force(spark, docs, none, monkeypatch):
    sought = spark.createDataFrame([(i, t, "x") for i, t in items()], "item_id long, text string, rank string")
    want = collections.Counter(plain_search(rows(), items()))
    got = lambda: collections.Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical_search.ranked(docs, sought).collect())
    assert got() == want
    monkeypatch.setattr(lexical_search, "TREE", 16)
    monkeypatch.setattr(lexical_search, "LEAF", 2)
    monkeypatch.setattr(lexical_search.item_blocks, "__defaults__", (40,))
    assert got() == want
    assert lexical_search.ranked(none, sought).isEmpty() and lexical_search.ranked(docs, none.selectExpr("doc_id as item_id", "text")).isEmpty()


def test_ball_tree_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    size, n = 300, 600
    rare = [np.unique(np.concatenate([rng.integers(0, 20, 8), rng.integers(20 + 10 * (k % 28), 30 + 10 * (k % 28), 6)])) for k in range(n)]
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rare])])
    values = rng.integers(1, 1_000_000, int(ends[-1]))
    tree = lexical_search.BallTree(ends, np.concatenate(rare), values, np.arange(n), size, leaf=8)
    weights = np.zeros((size, 5), np.int64)
    for k in range(5):
        weights[rng.integers(20 + 50 * k, 70 + 50 * k, 12), k] = rng.integers(1, 20_000, 12)
    bounds = tree.bounds(weights.astype(float))
    for k in range(len(tree.low)):
        for q in range(5):
            assert tree._dot(tree.low[k], tree.high[k], weights[:, q]).max() <= bounds[k, q]
    best = [[] for _ in range(5)]
    opened = lexical_search.search(tree, weights, best)
    everything = [sorted((-int(s), int(d)) for s, d in zip(tree._dot(0, n, weights[:, q]), tree.ids, strict=True) if s > 0)[:10] for q in range(5)]
    assert best == everything
    assert opened < 5 * sum(x < 0 for x in tree.left) / 2
