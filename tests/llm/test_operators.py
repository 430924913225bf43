"""The operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import dataclasses
import hashlib
import os
import random
import re
import sys
import uuid
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from duecourse.llm import common, fm_index, license_scan, line_dedup, mixing, ngram_join, packing, quality_classifier, quality_rules, secret_scan, substring_dedup, telephony_audio

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, template string, kept string, size long"


def corpus():
    """Rows with copies, near copies, shared passages and recurring lines; then the odd cases."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, long = text(70), text(6000)
    rows = []
    for i in range(60):
        t = "\n".join(text(rng.randint(5, 40)) for _ in range(4))
        if i % 5 == 0:
            t += "\n" + passage + "\n" + text(20)
        if i % 3 == 0:
            t = f"Share this page now\nposted on day {i} by the whole team of writers\n" + t
        rows.append([i, t])
    for i in range(60, 75):
        words = rows[3][1].split(" ")
        if i % 2:
            words[rng.randrange(len(words))] = "changed"
        rows.append([i, " ".join(words)])
    rows += [[75, None], [76, ""], [77, " \n\t "], [78, "one"], [79, "one two"], [80, "ONE two"], [81, long], [82, long], [83, "x" * 50000], [None, rows[3][1]], [None, None], [84, "sym ### $$$"], [84, "sym ### $$$"], [3, rows[3][1]]]
    return [(d, t, [None, "en", "de"][k % 3], [None, "a", "a", "b"][k % 4], None, "clash", None, 1) for k, (d, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def test_packing_keeps_each_id_once(docs, none):
    rows = packing.pack(docs, packing.tokenizer_path(), size=256, open_windows=4).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = collections.Counter((d, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for d, t, *_ in corpus())
    per = collections.defaultdict(list)
    for r in rows:
        per[r.sequence_id].append(r)
    padded = 0
    for s in per.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length * 4 == len(r.ids)
            at += r.length
        assert at <= 256
        padded += 0 if at & (at - 1) == 0 else 256 - at
    assert padded <= 16 * len(per)
    assert sum(r.length for r in rows) == sum(len(i) // 4 * n for (_, i), n in want.items())
    whole = collections.defaultdict(list)
    for r in rows:
        whole[r.doc_id].append(r)
    for (d, ids), n in want.items():
        if n == 1 and sum(d == x for x, _ in want) == 1:
            assert b"".join(r.ids for r in sorted(whole[d], key=lambda r: r.start)) == ids
    assert packing.pack(none, packing.tokenizer_path()).isEmpty()


def test_word_encoder_equals_the_tokenizer():
    e = packing.WordEncoder(packing.tokenizer_path(), 1)
    texts = ["Hello, World's été   it's 12a3!!", "a\x1cb \x85c​d", "", "İstanbul ΣΣ <|endoftext|>x", "don't STOP...now"]
    for t, got in zip(texts, e.encode(texts), strict=True):
        assert got.tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_near_groups(docs, none, n, percent):
    def shingles(t):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset({tuple(w)} if w else ())

    rows = [(d, shingles(t)) for d, t, *_ in corpus()]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, s) in enumerate(rows):
        if s and d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = collections.Counter((d, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(rows))
    got = ngram_join.near_groups(docs, n, percent).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert sum(r.first for r in got) == len({find(i) for i, (_, s) in enumerate(rows) if s}) + sum(not s for _, s in rows)
    assert ngram_join.near_groups(none).isEmpty()


def test_near_groups_hands_small_batches_to_python(spark, monkeypatch):
    def held(run):
        def wrapped(batches):
            def small():
                for batch in batches:
                    assert batch.nbytes <= 5 << 20, batch.nbytes
                    yield batch

            yield from run(small())

        return wrapped

    monkeypatch.setattr(ngram_join, "released", held)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(900)), lambda k: (F.col("doc_id") * F.lit(1000) + k).cast("string")), " ")
    docs = spark.range(0, 1200, 1, 1).select((F.col("id") % 1100).alias("doc_id")).withColumn("text", words)  # 7 MB in one task
    assert ngram_join.near_groups(docs).where("component_id = doc_id").count() == 1200
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    common.small_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"  # less stays
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_scans_decode_few_rows_at_a_time(spark, docs):
    rows = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.unset(rows)
    ngram_join.near_groups(docs.limit(3))
    assert int(spark.conf.get(rows)) <= 512
    spark.conf.set(rows, "100")
    common.small_batches(spark)
    assert spark.conf.get(rows) == "100"  # less stays
    spark.conf.unset(rows)


def test_verified_shuffles_the_features_of_pairs_alone(spark):
    sets = {k: list(range(k % 2, 10 + k % 3)) for k in range(200)}
    features = common.staged(spark.createDataFrame([(k, len(s), s) for k, s in sets.items()], "id long, n_shingles long, features array<long>"), "features")
    pairs = common.staged(spark.createDataFrame([(1, 3), (1, 3), (1, 5), (2, 4), (6, 7)], "a long, b long"), "pairs")
    got = ngram_join._verified(pairs, features, 80)
    alike = lambda a, b: len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.8
    assert sorted(map(tuple, got.collect())) == [(a, b, alike(a, b)) for a, b in ((1, 3), (1, 5), (2, 4), (6, 7))]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 2
    common.discard(features, pairs)


def test_word_encoder_keeps_ids_compactly():
    encoder = packing.WordEncoder(packing.tokenizer_path(), 1)
    texts = ["Recurring words, recurring! x7f3kq9 naïve", "recurring WORDS (again) x7f3kq9"]
    whole = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids in encoder.encode(texts)] == [[*ids, 1] for ids in whole]
    assert all(sys.getsizeof(ids) <= 40 + 4 * len(encoder.tokenizer.encode(p, add_special_tokens=False).ids) for p, ids in encoder.parts.items())


def test_signatures_meet_for_every_similar_pair():
    rng = np.random.default_rng(1)
    for size in (1, 5, 9, 10, 19, 20, 40, 200, 1500):
        for percent in (80, 90):
            for _ in range(20):
                a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
                spare = (100 - percent) * len(a) // 100
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[spare // 2 :]], rng.integers(0, 2**63, max(0, spare // 3)).astype(np.uint64)]))
                both = len(np.intersect1d(a, b))
                if both * 100 >= (len(a) + len(b) - both) * percent:
                    assert np.intersect1d(ngram_join.signatures(a, percent), ngram_join.signatures(b, percent)).size


@pytest.mark.parametrize("few", [0, 400])
def test_fm_index_finds_all_matches(monkeypatch, few):
    monkeypatch.setattr(fm_index.FMIndex, "FEW", few)
    rng = np.random.default_rng(3)
    seqs = [rng.integers(0, 3, rng.integers(5, 40)).astype(np.uint64) for _ in range(30)]
    owners = np.arange(30)
    index = fm_index.FMIndex(seqs, owners)
    which, start, end = index.repeats(seqs, owners, 4)
    covered = [np.zeros(len(s), bool) for s in seqs]
    for q, a, b in zip(which, start, end, strict=True):
        covered[q][a:b] = True
    for q, s in enumerate(seqs):
        want = np.zeros(len(s), bool)
        earlier = {tuple(t[i : i + 4]) for t in seqs[:q] for i in range(len(t) - 3)}
        for i in range(len(s) - 3):
            if tuple(s[i : i + 4]) in earlier:
                want[i : i + 4] = True
        assert (covered[q] == want).all()


def test_fm_index_is_compressed():
    rng = np.random.default_rng(4)
    seqs = [rng.zipf(1.3, 120).astype(np.uint64) for _ in range(3000)]
    index = fm_index.FMIndex(seqs, np.arange(3000))
    assert index.nbytes <= 8 * index.size
    low = rng.integers(0, index.size - 1, 500)
    high = np.minimum(index.size, low + rng.integers(1, 400, 500))
    assert index.owner.least(low, high).tolist() == [index.owner.values[a:b].min() for a, b in zip(low, high, strict=True)]
    strange = [np.array([10**9, 10**9 + 1] * 40, np.uint64)]  # words that the index lacks
    assert not len(index.repeats(strange, np.array([3000]), 50)[0])


@pytest.mark.parametrize("hot", [10_000, 0])
def test_substring_dedup(docs, none, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT_SEGMENTS", hot)
    first = {}
    for d, t, *_ in sorted((r for r in corpus() if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    want = collections.Counter()
    for d, t, *_ in corpus():
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if d is not None and first[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        want[d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)] += 1
    got = substring_dedup.remove_repeats(docs).collect()
    assert collections.Counter(tuple(r) for r in got) == want
    assert sum(r.n_removed for r in got) > 1000
    assert substring_dedup.remove_repeats(none).isEmpty()


def test_quality_rules(docs, none):
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(corpus())
    want = collections.Counter()
    for d, t, *_ in corpus():
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        want[d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)] += 1
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)
    assert quality_rules.quality_rules(none).isEmpty()


def test_line_dedup_equals_sql(spark, docs, none):
    rows = [(d, t) for d, t, *_ in corpus() if d is not None and d != 84][:-1]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.drop_recurring_lines(df, line_dedup.MIN_DOCS).select("doc_id", "lines_dropped", F.coalesce("text", F.lit("")).alias("text")).collect()
    duck = duckdb.connect()
    held_rows = df.toPandas()  # noqa: F841
    want = duck.sql(line_dedup.LINE_DEDUP_SQL.format(docs="held_rows") + "SELECT doc_id, lines_dropped, text FROM done").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    dropped = {r.doc_id: r.lines_dropped for r in got}
    assert dropped[0] == 0 and dropped[6] == 2  # the first keeps the template, with another number in it
    every = line_dedup.drop_recurring_lines(docs)
    assert every.count() == len(corpus()) and every.columns[: len(docs.columns)] != [] and set(docs.columns) <= set(every.columns)
    assert line_dedup.drop_recurring_lines(none).isEmpty()


def test_a_shared_longest_line_is_no_copy(spark):
    footer, notice = "we use cookies and " + "similar means " * 20 + "on this site", "Contact the team here"
    pages = [(i, f"page{chr(97 + i)} {'abcdefgh'[i % 8] * 3} title\n{notice}\n{footer}") for i in range(10)]
    copies = [(20 + i, "all of this text is\ncopied as it stands today") for i in range(10)]
    got = {r.doc_id: r for r in line_dedup.drop_recurring_lines(spark.createDataFrame(pages + copies, "doc_id long, text string")).collect()}
    assert got[0].text == pages[0][1] and [got[i].text for i in range(1, 10)] == [t.split("\n")[0] for _, t in pages[1:]]
    assert all(got[d].lines_dropped == 0 for d, _ in copies)


def test_fields_vary_by_place_within_a_leaf(spark):
    names, places = ["Ann", "Bo", "Cy", "Di", "Ed", "Flo", "Gus", "Hal", "Ida", "Jo"], ["News", "Sport", "Art"]
    text = lambda i: f"{chr(97 + i % 26)}{chr(97 + i // 26)} some words of a page alone\nPosted by {names[i % 10]} in {places[i // 40]}\nOK\n- -"
    pages = [(i, text(i)) for i in range(120)]
    other = [(500 + i, f"Posted by {w} {w}b {w}c") for i, w in enumerate(["x", "y", "z"])]
    got = {r.doc_id: r for r in line_dedup.drop_recurring_lines(spark.createDataFrame(pages + other, "doc_id long, text string")).collect()}
    assert got[0].text == text(0)
    assert all(got[i].text.split("\n")[0] == text(i).split("\n")[0] and got[i].text.endswith("\n- -") for i in range(1, 120))
    assert sum("Posted" in got[i].text for i in range(120)) <= len(names) + len(places) and sum("OK" in got[i].text for i in range(120)) == 1
    assert all(got[d].lines_dropped == 0 for d, _ in other)


def test_thin_pages_lose_their_shared_longest_line(spark):
    pages = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}\n" + "the same long footer stands on every thin page of the site") for i in range(100)]
    got = line_dedup.drop_recurring_lines(spark.createDataFrame(pages, "doc_id long, text string")).collect()
    assert sum(r.lines_dropped for r in got) == 99


def test_mixing(spark, docs, none):
    got = mixing.copies(docs).collect()
    assert len(got) == len(corpus()) and all(r.copies in (int(r.rate), int(r.rate) + 1) and r.copies <= 3 for r in got)
    sizes = collections.defaultdict(int)
    for _, t, _, s, *_ in corpus():
        sizes[s] += len(words(t))
    order = [*sorted(k for k in sizes if k is not None), None]
    weight, room, total = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}, {k: 3 * v for k, v in sizes.items()}, sum(sizes.values())
    target, open_ = {}, set(order)
    while open_:
        level = (total - sum(target.values())) / sum(weight[k] for k in open_)
        full = {k for k in open_ if room[k] < level * weight[k]}
        target.update({k: room[k] if full else level * weight[k] for k in full or open_})
        open_ -= full or open_
    assert all(abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source] for r in got)
    assert sorted((str(r.doc_id), r.copies) for r in got) == sorted((str(r.doc_id), r.copies) for r in mixing.copies(docs).collect())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(none).isEmpty()
    many = spark.range(30000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"), (F.col("id") % 4).cast("string").alias("source"))
    taken = mixing.copies(many).groupBy("source").agg((F.sum(F.col("size") * F.col("copies")) / F.first("target")).alias("x")).collect()
    assert all(abs(r.x - 1) < 0.05 for r in taken)


def test_secrets_and_the_ledger(spark, none, tmp_path):
    texts = [(1, 'password = "hunter22" x'), (2, "AKIA" + "Q7" * 9), (3, "f" * 30 + " " + "e" * 23), (4, None), (5, 'password = "hunter22" x'), (6, "passwoŗd: abcdefg ToKen=abcdefgh API_KEY:abcdef1"), (7, "token=short"), (None, "secret: 0123456789")]
    df = spark.createDataFrame(texts, "path long, text string")
    spans = lambda d: {r.path: [(x.kind, x.start, x.end) for x in r.found] for r in d.collect()}
    fresh = lambda d, rules=secret_scan.RULES: secret_scan.scan_secrets(d, str(tmp_path / uuid.uuid4().hex), rules)
    got = spans(fresh(df))
    assert got[1] == got[5] == [("assign", 0, 20)] and got[2] == [("access", 0, 22)] and got[3] == [("hex", 0, 30)] and got[4] == got[7] == [] and got[None] == [("assign", 0, 18)]
    assert [k for k, *_ in got[6]] == ["assign"]
    ledger = str(tmp_path / "ledger")
    assert spans(secret_scan.scan_secrets(df, ledger)) == got
    rows = spark.read.parquet(ledger)
    before = rows.count()
    assert before == 7 and spans(secret_scan.scan_secrets(df, ledger)) == got and spark.read.parquet(ledger).count() == before
    newer = (*secret_scan.RULES, secret_scan.Rule("word", 1, "hunter[0-9]+", "hunter"))
    assert [x[0] for x in spans(secret_scan.scan_secrets(df, ledger, newer))[1]] == ["assign", "word"]
    assert spark.read.parquet(ledger).where(F.array_contains("rules", "word@1")).count() == before
    stricter = tuple(dataclasses.replace(r, version=2, least=40) if r.kind == "hex" else r for r in secret_scan.RULES)
    assert spans(secret_scan.scan_secrets(df, ledger, stricter)) == spans(fresh(df, stricter)) and spans(fresh(df, stricter))[3] == []
    assert spans(secret_scan.scan_secrets(df, ledger)) == got
    more = df.union(spark.createDataFrame([(20, "token: 1234567"), (21, "nothing")], "path long, text string"))
    before = spark.read.parquet(ledger).count()
    assert spans(secret_scan.scan_secrets(more, ledger)) == spans(fresh(more)) and spark.read.parquet(ledger).count() == before + 2
    assert fresh(none.select("text")).isEmpty()


def test_secrets_equal_plain_patterns(spark):
    sf = "/root/testdata/sf0.01"
    plain = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))
    got, seen = {r.doc_id: r for r in secret_scan.op9_secret_scan(spark, sf).collect()}, 0
    for d, t in duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall():
        found = [[m.span() for m in find.finditer(t or "") if len(m[group]) >= least] for _, find, group, least in plain]
        base = ",".join(f"{plain[k][0]}:{a}:{b}" for a, k, b in sorted((a, k, b) for k, x in enumerate(found) for a, b in x))
        r = got.pop(d)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(len, found)) and r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
        seen += sum(map(len, found))
    assert not got and seen > 10


def test_audio_round_trip(docs, none):
    got = telephony_audio.decode_media(telephony_audio.encode_media(docs)).select("text", "stored", "codec", "pcm", "n_samples", "error").collect()
    assert {r.codec for r in got} == {"mulaw", "alaw", "adpcm"} and not any(r.error for r in got)
    for r in got:
        raw = (r.text or "").encode()
        assert bytes(r.stored) == raw + b"\xff" * (-len(raw) % 576 if raw else 576) and len(r.pcm) == 2 * r.n_samples
    assert zlib.crc32(telephony_audio.MULAW.tobytes()) and telephony_audio.MULAW[0] == -32124 and telephony_audio.MULAW[255] == 0 and telephony_audio.ALAW[0x55] == -8 and telephony_audio.ALAW[0xAA] == 32256
    broken = docs.select(F.lit(b"RIFFxxxx").alias("media")).limit(1)
    assert telephony_audio.decode_media(broken).first().error
    assert telephony_audio.decode_media(telephony_audio.encode_media(none)).isEmpty()


def test_adpcm_blocks_equal_a_plain_decoder():
    blocks = np.random.default_rng(2).integers(0, 256, (5, 64)).astype(np.uint8)
    for block, got in zip(blocks, telephony_audio.decode_adpcm(blocks), strict=True):
        value, index = int.from_bytes(bytes(block[:2]), "little", signed=True), min(int(block[2]), 88)
        want = [value]
        for code in (c for b in block[4:] for c in (b & 15, b >> 4)):
            step = int(telephony_audio.STEPS[index])
            change = step // 8 + (step if code & 4 else 0) + (step // 2 if code & 2 else 0) + (step // 4 if code & 1 else 0)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            want.append(value)
        assert got.tolist() == want


def test_licenses_are_found_wherever_they_stand(spark, none):
    rng = random.Random(5)
    fill = lambda n: " ".join("".join(rng.choices("abcdef", k=4)) for _ in range(n))
    rows, want = [], set()
    for i, (name, text) in enumerate((n, t) for n, t in license_scan.TEMPLATES.items() for _ in range(12)):
        rows.append((i, fill(rng.randint(0, 40)) + " " + text + " " + fill(rng.randint(0, 40))))
        want.add((i, name))
    rows += [(900, None), (901, ""), (902, "License"), (None, "All rights reserved.")]
    got = license_scan.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.license) for r in got} == want | {(None, "reserved")} and len(got) == len(want) + 1
    assert license_scan.license_matches(none).isEmpty()


def test_licenses_equal_brute_force():
    rng = random.Random(8)
    held, seen = license_scan.Templates(license_scan.TEMPLATES), 0
    for _ in range(150):
        name = rng.choice(held.names)
        body = [w for w in license_scan.TEMPLATES[name].split() if rng.random() > rng.choice([0, 0.03, 0.1, 0.3])]
        fill = lambda: [rng.choice(["the", "of", "software", "qq", "rr", "license"]) for _ in range(rng.randint(0, 60))]
        h = license_scan._parted([" ".join(fill() + body + fill())]).of(0)
        x = license_scan.grams(h, license_scan.SHINGLE)
        want = set()
        for k, own in enumerate(held.sets):
            width = license_scan._scale(held.words[k])
            if any(len(np.intersect1d(own, x[i : i + width])) >= license_scan.CONTAINED * len(own) for i in range(len(x))):
                want.add(k)
        assert {m[0] for m in held.matches(h)} == want
        seen += len(want)
    assert seen > 80


def test_licenses_with_other_marks_and_repeated(spark):
    rng = random.Random(6)
    fill = lambda n: "".join(" " + "".join(rng.choices("abcdef", k=4)) for _ in range(n))
    rows, want = [], collections.Counter()
    for name, text in license_scan.TEMPLATES.items():
        bare = text.rstrip(".")
        for form in (bare, bare + ",", f'"{text}"', f"({bare})", f"\u201c{bare}\u201d", bare.upper() + "!"):
            d, before = len(rows), rng.randint(0, 30)
            rows.append((d, (fill(before) + " " + form + fill(rng.randint(0, 30))).strip()))
            want[d, name, before, before + len(form.split())] += 1
        for gap in (0, 1, 3, 30):
            d, n = len(rows), len(bare.split())
            rows.append((d, fill(gap).join([" " + text] * 3).strip()))
            want.update((d, name, i * (n + gap), i * (n + gap) + n) for i in range(3))
    got = license_scan.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r.doc_id, r.license, r.first_word, r.end_word) for r in got) == want


def test_classifier_on_held_out_labels(spark, docs, none):
    sf = "/root/testdata/sf0.1"
    all_docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_classifier.classify(all_docs, labels.where("doc_id % 5 <> 0")).join(labels.where("doc_id % 5 = 0"), "doc_id").groupBy((F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {(r.good, r.toxic): r.kept for r in got}
    assert kept[True, False] > 0.98 and kept[False, False] < 0.05 and kept[True, True] < 0.2
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality_classifier.classify(docs, no_labels)
    assert rows.count() == len(corpus()) and rows.where("not kept").isEmpty()
    few = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    assert quality_classifier.classify(docs, few).count() == len(corpus())
    assert quality_classifier.classify(none, few).isEmpty()


def test_pipeline_stages_on_odd_rows(spark, docs):
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5
    held = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, held, "/root/testdata/sf0.001")
        assert out.columns == held.columns, name
    kept = [r.doc_id for r in corpus_pipeline.one_of_each_group(spark, held, "").collect()]
    want = [r.doc_id for r in ngram_join.near_groups(held).where("first").collect()]
    assert collections.Counter(kept) == collections.Counter(want)


def test_pipeline_by_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    rows = []
    for i in range(60):
        t = text(60) + "\nRead our newsletter every single day\n" + text(40)
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
    rows += [(100 + i, rows[i][1].replace(rows[i][1].split(" ")[30], "other", 1), "en", "s0", rows[i][4]) for i in range(10)]  # near copies
    rows += [(200, None, None, None, None), (201, "", "en", "s1", 0)]
    folder = tmp_path / "t"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(folder / "documents.parquet"))
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    kept = corpus_pipeline.classified(spark, docs, str(folder))
    direct = quality_classifier.classify(docs, spark.read.parquet(str(folder / "labels.parquet"))).where("kept")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in direct.collect()}
    lines = {r.doc_id: r for r in corpus_pipeline.without_recurring_lines(spark, docs, str(folder)).collect()}
    assert len(lines) == 72 and sum("newsletter" in (r.text or "") for r in lines.values()) == 1 and all(r.n_chars == len(r.text) for r in lines.values() if r.text)
    once = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, str(folder)).collect()}
    assert once == {r[0] for r in rows} - set(range(100, 110))
    mixed = collections.Counter(r.doc_id for r in corpus_pipeline.mixed_sources(spark, docs, str(folder)).collect())
    assert mixed == collections.Counter({r.doc_id: r.copies for r in mixing.copies(docs).collect() if r.copies})
    packed = corpus_pipeline.packed(spark, docs, str(folder)).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in rows} and all(r.offset + r.length <= 2048 for r in packed)
    out = corpus_pipeline.run(spark, str(folder)).collect()
    left = {r.doc_id for r in out}
    assert left <= {r.doc_id for r in kept.collect()} and not any({i, 100 + i} <= left for i in range(1, 10))  # 0 keeps the recurring line and differs more
    again = corpus_pipeline.run(spark, str(folder)).collect()
    assert sum(r.length for r in out) == sum(r.length for r in again)
    nothing = docs.limit(0)
    assert all(stage(spark, nothing, str(folder)).isEmpty() for _, stage in corpus_pipeline.STAGES)


def test_sha_of_kept_words():
    assert substring_dedup.sha256("a b") == hashlib.sha256(b"a b").hexdigest()


@pytest.mark.parametrize("size", [1, 3, 100])
def test_residual_groups_may_span_batches(size):
    from duecourse.llm import ngram_join as J

    sets = [np.arange(20, dtype=np.uint64) + np.uint64(100 * (k // 4)) for k in range(12)]  # four equal sets in a row
    group = [0] * 8 + [1] * 4
    rows = pa.table({"group": group, "x": [0] * 12, "y": [0] * 12, "set_id": range(12), "component": range(12), "side": [0] * 12, "n_shingles": [20] * 12, "signature": group, "sketch": [J.sketch(s).tobytes() for s in sets]})
    out = pa.Table.from_batches(J._compare(80, True)(iter(rows.to_batches(max_chunksize=size)))).to_pylist()
    assert {(r["signature"], r["a"], r["b"]) for r in out} == {(g, 4 * q, 4 * q + j) for g, q in ((0, 0), (0, 1), (1, 2)) for j in (1, 2, 3)}


def rows_of(sf="/root/testdata/sf0.01"):
    return duckdb.sql(f"select doc_id, text, source from '{sf}/documents.parquet'").fetchall()


def test_near_groups_on_given_documents(spark):
    shingles = {}
    for d, t, _ in rows_of():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        shingles[d] = frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset({tuple(w)} if w else ())
    held_by, root = collections.defaultdict(list), {d: d for d in shingles}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in shingles.items():
        for x in s:
            held_by[x].append(d)
    for d, s in shingles.items():
        for e, both in collections.Counter(e for x in s for e in held_by[x] if e < d).items():
            if 100 * both >= 90 * (len(s) + len(shingles[e]) - both):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    got = ngram_join.op4_ngram_join(spark, "/root/testdata/sf0.01").collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(d, len(s), find(d)) for d, s in shingles.items()}
    assert any(find(d) != d for d in shingles)


def test_substring_dedup_on_given_documents(spark):
    first, rows = {}, sorted((d, words(t)) for d, t, _ in rows_of())
    for d, w in rows:
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    want = set()
    for d, w in rows:
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        want.add((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    assert {tuple(r) for r in substring_dedup.op6_substring_dedup(spark, "/root/testdata/sf0.01").collect()} == want


def test_mixing_on_given_documents(spark):
    got = {r.doc_id: r for r in mixing.op8_mixing(spark, "/root/testdata/sf0.01").collect()}
    again = {r.doc_id: r.taken for r in mixing.op8_mixing(spark, "/root/testdata/sf0.01").collect()}
    of = {d: s for d, _, s in rows_of()}
    taken, target, spread = collections.Counter(), {}, collections.Counter()
    for d, r in got.items():
        assert r.taken == again[d] <= 3 * r.size
        part = r.target / r.source_size % 1
        taken[of[d]] += r.taken
        spread[of[d]] += r.size**2 * part * (1 - part)
        target[of[d]] = r.target
    # sources of about 50 documents each, some of them long: four standard deviations of independent draws
    assert all(abs(taken[s] - target[s]) <= 4 * spread[s] ** 0.5 + 1 for s in target)
    assert abs(sum(taken.values()) / sum(r.size for r in got.values()) - 1) < 0.05


@pytest.mark.parametrize("name", ["op3_line_dedup", "op7_quality_rules", "op8_mixing", "op11_exact_dedup", "op13_lexical_search"])
def test_queries_equal_their_sql(spark, name):
    from duecourse.llm import queries

    sf = "/root/testdata/sf0.01"
    df = queries.QUERIES[name](spark, sf)
    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.sql(f"create view {table} as select * from '{sf}/{table}.parquet'")
    sql = duck.sql(queries.ORACLES[name])
    assert sorted(sql.columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*sql.columns).collect())) == sorted(sql.fetchall())


def test_columns_named_like_an_operators_own_stay(spark, docs):
    import corpus_pipeline

    names = ["row_at", "row_key", "row_drop", "Row_Drop_", "__drop", "__row", "near_at", "near_key", "__near", "mix_source", "mix_of", "mix_rate", "mix_draw", "mix_copy", "__copy"]
    held = docs.select("doc_id", "text", "lang", "source", "n_chars").withColumns({n: F.lit(n) for n in names})
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    stages = {"lines": line_dedup.drop_recurring_lines, "mix": mixing.mix, "near": lambda d: corpus_pipeline.one_of_each_group(spark, d, ""), "without": lambda d: corpus_pipeline.without_recurring_lines(spark, d, "")}
    for name, stage in stages.items():
        out = stage(held)
        assert [c for c in out.columns if c in held.columns] == held.columns, name
        assert {tuple(r) for r in out.select(*names).distinct().collect()} == {tuple(names)}, name
        assert collections.Counter(map(tuple, out.select("doc_id", "text").collect())) == collections.Counter(map(tuple, stage(plain).select("doc_id", "text").collect())), name


def test_secret_scan_leaves_no_ledger(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(secret_scan, "remove", lambda s, path: kept.append(path) or common.remove(s, path))
    rows = secret_scan.op9_secret_scan(spark, "/root/testdata/sf0.001").collect()
    assert rows and len(kept) == 1 and not os.path.exists(kept[0])


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Cluster())


@pytest.mark.parametrize("packed", [7, 1 << 20])
def test_shared_signatures_are_trees_of_all_holders(spark, monkeypatch, packed):
    monkeypatch.setattr(ngram_join, "PACKED", packed)
    monkeypatch.setattr(ngram_join, "GROUPED", 16)
    rng = random.Random(1)
    sets = [(k, [rng.choice([-(1 << 62), 5, 1 << 61]) if rng.random() < 0.3 else rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(4)] + ([77, 77] if k % 3 == 0 else [])) for k in range(60)]
    sets += [(60 + k, [k * 1000 + 1]) for k in range(3)] + [(70, [])]
    got = ngram_join.shared_signatures(spark.createDataFrame(sets, "id long, signatures array<long>").repartition(3)).collect()
    holders = collections.defaultdict(set)
    for k, sigs in sets:
        for s in sigs:
            holders[s].add(k)
    want = {(s, k) for s, ids in holders.items() if len(ids) > 1 for k in ids}
    assert len(got) == len(want) and {(r.signature, r.id) for r in got} == want
    for s in {s for s, _ in want}:
        up = {r.id: r.center for r in got if r.signature == s}
        top = {k: k for k in up}
        for k in up:
            while up[top[k]] != top[k]:
                assert up[top[k]] < top[k]
                top[k] = up[top[k]]
        assert set(top.values()) == {min(up)}
    assert ngram_join.shared_signatures(spark.createDataFrame([], "id long, signatures array<long>")).isEmpty()


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_near_groups_with_large_groups_dealt_anew(spark, docs, monkeypatch, n, percent):
    rows = lambda: collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_groups(docs, n, percent).collect())
    want = rows()
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 2)
    # without centers that link anything, all is left to the residual
    monkeypatch.setattr(ngram_join, "_nearest", lambda pairs, percent: pairs.select("a", "b", F.lit(0).cast("long").alias("differ")).where("false"))
    assert rows() == want


def test_license_bodies_and_a_table_of_templates(spark):
    known = license_scan.all_templates()
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(known)
    rng = random.Random(6)
    filler = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    rows, want = [], {}
    for k, name in enumerate(["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "MIT"]):
        body = " ".join(w for w in known[name].split() if rng.random() > 0.02)  # a word in fifty is lost
        rows.append((k, f"{filler(300)}\n{body}\n{filler(200)}"))
        want[k] = name
    rows.append((90, filler(20_000)))
    got = collections.defaultdict(set)
    for r in license_scan.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].add(r.license)
    assert all(want[k] in got[k] for k in want) and 90 not in got
    table = spark.createDataFrame([("own", "Only members of the guild may copy this page"), ("own", "The guild allows copies to apprentices"), ("none", None), (None, "a b c"), ("short", "one")], "license string, text string")
    mine = license_scan.load_templates(table)
    assert list(mine) == ["own", "own #2"]
    docs = spark.createDataFrame([(1, "x only members of the guild may copy this page y"), (2, "Permission is hereby granted")], "doc_id long, text string")
    assert [(r.doc_id, r.license, r.first_word, r.end_word) for r in license_scan.license_matches(docs, mine).collect()] == [(1, "own", 1, 10)]
    with pytest.raises(ValueError, match="bytes of templates"):
        license_scan.load_templates(table, 10)
