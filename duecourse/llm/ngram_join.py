"""Exact Jaccard self-join of documents' word shingles by PartEnum signatures, as connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, discard, documents, lists, mixed, released, shingle_set, signed, sliced, small, small_batches, staged
from .components import components

#: Second-level parts of each first-level part; a signature leaves one of them out.
PARTS = 2
#: The largest size in a band is this times the smallest.
BAND = 1.5
#: Bytes of sketches, about one per shingle, and sets that one task of the residual comparison holds for each of its two blocks.
BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 2000
#: Signatures that one task packs at a time, and about how many one group of the exchange holds; 16 bytes each.
PACKED = 1 << 18
GROUPED = 1 << 17
#: Makes another deal of the feature domain, for groups that are too large.
AGAIN = np.uint64(0x2545F4914F6CDD1D)

SETS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("text_key", T.LongType()),
        T.StructField("set_id", T.LongType()),
        T.StructField("signatures", T.ArrayType(T.LongType())),
        T.StructField("sketch", T.BinaryType()),
    ]
)


@lru_cache(4096)
def _band(band: int, percent: int) -> tuple[int, int, int, int]:
    """Of a size band: its largest size, the most differences of two similar sets in it, its first-level parts, and how
    many of these each set leaves out.

    Sets of a and b shingles with similarity s have at most (1 - s) / (1 + s) * (a + b) shingles that only one of them
    has. With that many differences at most half as many parts hold two or more, so of most // 2 + 1 + 2 * thin parts
    1 + 2 * thin hold no more than one. Each set may then leave out `thin` parts of its own choice: one such part at
    least is left out by neither. They leave out the thinnest, whose signatures say little.
    """
    low = 1
    for _ in range(band):
        low = max(low + 1, math.ceil(low * BAND))
    high = max(low + 1, math.ceil(low * BAND)) - 1
    most = (100 - percent) * 2 * high // (100 + percent)
    base = most // 2 + 1
    thin = int(base * math.exp(-low / (base * PARTS)))  # about how many halves a small set of the band leaves empty
    return high, most, base + 2 * thin, thin


def _bands(size: int, percent: int) -> list[int]:
    """The bands in which a set of this size meets all its partners: its own, and the next if a partner may be there."""
    band = 0
    while _band(band, percent)[0] < size:
        band += 1
    largest = size * 100 // percent
    return [band, band + 1] if largest > _band(band, percent)[0] else [band]


def signatures(features: np.ndarray, percent: int) -> np.ndarray:
    """PartEnum signatures of a set of 64-bit features.

    A hash deals the feature domain into first-level parts and each of these into PARTS second-level parts. Two similar
    sets differ by one feature at most in a first-level part that neither leaves out, so one of its second-level parts
    agrees: for each first-level part a signature leaves out each second-level part in turn and hashes what the set has
    in the other. Where that is nothing, all such sets would share the signature; but then the sets differ by one
    feature at most in the part that was to be left out, so one has the other's features there and at most one more:
    instead there are signatures of these features whole, and without each of them in turn.
    """
    out = []
    high, low = features >> np.uint64(32), features & np.uint64(0xFFFFFFFF)
    value = mixed(features + np.uint64(0x5851F42D4C957F2D))
    for band in _bands(len(features), percent):
        _, most, parts, thin = _band(band, percent)
        if not most:  # only equal sets
            out.append(mixed(value.sum(keepdims=True) + np.uint64(band + 1)))
            continue
        cell = (((high * np.uint64(parts)) >> np.uint64(32)) * np.uint64(PARTS) + ((low * np.uint64(PARTS)) >> np.uint64(32))).astype(np.int64)
        held = np.zeros(parts * PARTS, np.uint64)
        np.add.at(held, cell, value)
        count = np.bincount(cell, minlength=parts * PARTS)
        salt = mixed(np.arange(parts * PARTS, dtype=np.uint64) + (np.uint64(band + 1) << np.uint64(40)))
        by_part = count.reshape(parts, PARTS)
        order = np.lexsort((by_part.sum(1), by_part.min(1)))
        used = np.zeros((parts, PARTS), bool)
        used[order[thin:]] = True
        used = used.ravel()
        out.append(mixed(held[used & (count > 0)] + salt[used & (count > 0)]))
        for k in np.flatnonzero(used & (count == 0)):
            other = k ^ 1
            alone = np.concatenate([held[other : other + 1], held[other] - value[cell == other]])
            out.append(mixed(alone + mixed(salt[other : other + 1])))
    return np.concatenate(out)


def set_id(features: np.ndarray) -> int | None:
    """A 64-bit hash of a set, null when it is empty."""
    return int(signed(mixed(mixed(features).sum(keepdims=True) + np.uint64(len(features))))[0]) if len(features) else None


def shingle_sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """A row per document: number of shingles, a 64-bit id of the set (null when empty), the set's signatures and sketch.

    A null or empty text has an empty set without signatures; repeated rows get equal sets; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 1):
                w = Words(part.column(1).to_pylist(), lower=True)
                sets = [shingle_set(w.of(i), n) for i in range(len(w.first) - 1)]
                sigs = [signed(signatures(s, percent)) if len(s) else np.empty(0, np.int64) for s in sets]
                sketches = [sketch(s).tobytes() if len(s) else None for s in sets]
                yield pa.record_batch([part.column(0), pa.array([len(s) for s in sets], pa.int64()), part.column(2), pa.array([set_id(s) for s in sets], pa.int64()), lists(sigs, pa.int64()), pa.array(sketches, pa.binary())], SETS.names)

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(released(run), SETS)


def sketch(features: np.ndarray) -> np.ndarray:
    """The parity of the features in each of about 4 cells per feature, packed: two sets differ in as many features at
    least as their sketches, folded to one size, differ in bits."""
    cells = 1 << max(6, (len(features) * 4 - 1).bit_length())
    at = (mixed(features) & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=cells).astype(np.uint8) & 1, bitorder="little").view("<u8")


def folded(sketches: list[np.ndarray]) -> np.ndarray:
    """As rows of the size of the smallest; cells are dealt by low bits, so halves add up by exclusive or."""
    width = min(map(len, sketches))
    return np.stack([np.bitwise_xor.reduce(s.reshape(-1, width), 0) for s in sketches])


def _features(docs: DataFrame, n: int) -> DataFrame:
    """(id, n_shingles, features) of docs(id, set_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 2):
                w = Words(part.column(2).to_pylist(), lower=True)
                sets = [(k, s) for i, (k, given) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)) for s in [shingle_set(w.of(i), n)] if set_id(s) == given]
                yield pa.record_batch([pa.array([k for k, _ in sets], pa.int64()), pa.array([len(s) for _, s in sets], pa.int64()), lists([signed(s) for _, s in sets], pa.int64())], ["id", "n_shingles", "features"])

    return docs.select("id", "set_id", "text").mapInArrow(released(run), "id long, n_shingles long, features array<long>")


def _packed(values: np.ndarray) -> bytes:
    """64-bit numbers by planes of equal bytes, so that what neighbours have in common compresses."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(blobs: list[bytes]) -> np.ndarray:
    planes = [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T) for b in blobs]
    return np.concatenate([p.view("<u8").ravel() for p in planes]) if planes else np.empty(0, np.uint64)


def _starts(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.empty(0, np.int64)


def _dealt(buckets: int):
    """Of sets(id, signatures), in rows (bucket, signatures, ids, centers): each signature of the sets that a task packs
    at a time, once, with the least id that has it and whether others have it too; and the others with that least id, in
    rows of any bucket, so that a signature that very many sets have is a number per task in its own bucket."""

    def rows(signature: np.ndarray, ids: np.ndarray, turn: int) -> Iterator[tuple]:
        order = np.lexsort((ids, signature))
        signature, ids = signature[order], ids[order]
        new = np.ones(len(ids), bool)
        new[1:] = (signature[1:] != signature[:-1]) | (ids[1:] != ids[:-1])
        signature, ids = signature[new], ids[new]
        at = _starts(signature)
        n = np.diff(np.append(at, len(ids)))
        rest = np.ones(len(ids), bool)
        rest[at] = False
        held, own, center = signature[rest], ids[rest], np.repeat(ids[at], n)[rest]
        for k, low in enumerate(range(0, len(held), GROUPED // 8)):
            part = slice(low, low + GROUPED // 8)
            yield (turn + k) % buckets, _packed(held[part]), _packed(own[part]), _packed(center[part])
        flagged, signature = ids[at] * np.uint64(2) + (n > 1).astype(np.uint64), signature[at]
        bucket = ((signature >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        for low, high in zip(cut := _starts(bucket), np.append(cut[1:], len(bucket)), strict=True):
            yield int(bucket[low]), _packed(signature[low:high]), _packed(flagged[low:high]), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, turn = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                out = list(zip(*rows(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), turn), strict=True))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int32(), *[pa.binary()] * 3), strict=True)], ["bucket", "signatures", "ids", "centers"])

        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                ends = part.column(1).offsets.to_numpy()
                values = part.column(1).values.to_numpy()[ends[0] : ends[-1]].view(np.uint64)
                held.append((values, np.repeat(part.column(0).to_numpy().view(np.uint64), np.diff(ends))))
                n += len(values)
                if n >= PACKED:
                    yield from flush()
                    held, n, turn = [], 0, turn + 1
        if n:
            yield from flush()

    return run


def _merged(table: pa.Table) -> pa.Table:
    """A bucket's rows of _dealt() to (signature, id, center), for signatures that several sets have."""
    inside = table.column("centers").is_null()
    own, others = table.filter(inside), table.filter(pc.invert(inside))
    column = lambda t, k: _unpacked(t.column(k).to_pylist())
    signature, flagged = column(own, "signatures"), column(own, "ids")
    order = np.lexsort((flagged, signature))
    signature, flagged = signature[order], flagged[order]
    ids, at = flagged >> np.uint64(1), _starts(signature)
    n = np.diff(np.append(at, len(ids)))
    kept = np.repeat(n > 1, n) | (flagged & np.uint64(1)).astype(bool)
    parts = [(signature[kept], ids[kept], np.repeat(ids[at], n)[kept]), tuple(column(others, k) for k in ("signatures", "ids", "centers"))]
    return pa.table([pa.array(signed(np.concatenate(c))) for c in zip(*parts, strict=True)], ["signature", "id", "center"])


def shared_signatures(sets: DataFrame) -> DataFrame:
    """(signature, id, center) for the signatures that several of the sets(id, signatures) have.

    center is the least id with the signature among the sets that one task packed together; of the centers of several
    tasks the least is the center of the others. So (center, id) are the edges of a tree per signature. One exchange, in
    which signatures are packed and sorted and take about a quarter of what rows of their own would.
    """
    total = sets.agg(F.sum(F.size("signatures"))).first()[0] or 0
    dealt = sets.select("id", "signatures").mapInArrow(released(_dealt(total // GROUPED + 1)), "bucket int, signatures binary, ids binary, centers binary")
    return dealt.groupBy("bucket").applyInArrow(_merged, "signature long, id long, center long")


def _signatures_again(features: DataFrame, percent: int) -> DataFrame:
    """(id, again): the signatures of features(id, features) under another deal of the domain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                sigs = [signed(signatures(mixed(np.array(f, np.int64).view(np.uint64) ^ AGAIN), percent)) for f in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), lists(sigs, pa.int64())], ["id", "again"])

    return features.select("id", "features").mapInArrow(released(run), "id long, again array<long>")


def _differences(a: bytes, b: bytes) -> int:
    x = folded([np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)])
    return int(np.bitwise_count(x[0] ^ x[1]).sum())


def _nearest(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, differ) of the pairs(a, b, na, nb, sa, sb) whose sketches leave room for the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 4, rows=10_000):
                na, nb = part.column(2).to_numpy(), part.column(3).to_numpy()
                differ = np.array([_differences(x, y) for x, y in zip(part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True)], np.int64)
                near = pa.array(differ * (100 + percent) <= (100 - percent) * (na + nb))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(differ)], ["a", "b", "differ"]).filter(near)

    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(released(run), "a long, b long, differ long")


def _linked(shared: Column, a: Column, b: Column, percent: int) -> Column:
    return shared * 100 >= (a + b - shared) * percent


def _compare(percent: int, spanning: bool):
    """Pairs of two blocks that share a signature, lie in different components and have near sketches; if spanning, only
    those of a forest that would join all of them. For rows in order of group, x, y and id; a pair comes with its first
    row's signature."""

    def pairs(size: np.ndarray, comp: np.ndarray, side: np.ndarray, sketches: list[bytes], one: bool) -> list[tuple[int, int]]:
        held, comp, out = folded([np.frombuffer(s, np.uint64) for s in sketches]), comp.copy(), []
        for i in range(len(size) - 1):
            near = np.arange(i + 1, len(size))
            near = near[(comp[near] != comp[i]) & ((side[near] != side[i]) | one)]
            near = near[np.minimum(size[near], size[i]) * 100 >= np.maximum(size[near], size[i]) * percent]
            if not len(near):
                continue
            differ = np.bitwise_count(held[near] ^ held[i]).sum(1, dtype=np.int64)
            for j in near[differ * (100 + percent) <= (100 - percent) * (size[near] + size[i])]:
                if comp[i] != comp[j]:
                    out.append((i, j))
                    if spanning:
                        comp[comp == comp[j]] = comp[i]
        return out

    def found(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        _, x, y, ids, comp, side, size, signature = (rows.column(k).to_numpy() for k in range(8))
        out = []
        for low, high in zip(starts, [*starts[1:], len(ids)], strict=True):
            if high - low > 1:
                at = slice(low, high)
                out += [(low + i, low + j) for i, j in pairs(size[at], comp[at], side[at], rows.column(8)[low:high].to_pylist(), x[low] == y[low])]
        i, j = np.array(out, np.int64).reshape(-1, 2).T
        return pa.record_batch([signature[i], ids[i], ids[j]], ["signature", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            keys = np.stack([rows.column(k).to_numpy() for k in range(3)])
            starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
            rest = rows.slice(starts[-1])  # the last group may go on in the next batch
            if starts[-1]:
                yield found(rows.slice(0, starts[-1]), starts[:-1])
        if rest is not None:
            yield found(rest, np.zeros(1, np.int64))

    return run


def _verified(pairs: DataFrame, features: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) whose sets are similar, by their features, and whether: (a, b, linked). pairs should be staged.

    Features are many times as large as pairs, and most sets have no pair: theirs stay out of the shuffle.
    """
    side = lambda k: features.select(F.col("id").alias(k), F.col("features").alias(f"f{k}"), F.col("n_shingles").alias(f"n{k}")).join(small(pairs.select(k).distinct()), k, "left_semi")
    both = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", _linked(F.size(F.array_intersect("fa", "fb")), F.col("na"), F.col("nb"), percent).alias("linked"))


def _open(members: DataFrame) -> DataFrame:
    """The rows of members(group, id, component, ...) of groups whose members are not all in one component; of groups with the same members one."""
    apart = members.groupBy("group").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("as_set")).where("low != high")
    return members.join(apart.groupBy("n", "as_set").agg(F.min("group").alias("group")).select("group"), "group")


def _blocks(members: DataFrame) -> DataFrame:
    """(group, blocks): into how many blocks a group's members go for the comparison."""
    return members.groupBy("group").agg(F.ceil(F.greatest(F.sum("n_shingles") / BLOCK_BYTES, F.count("*") / BLOCK_ROWS)).cast("int").alias("blocks"))


def _residual(shared: DataFrame, found: DataFrame, sketches: DataFrame, features: DataFrame, percent: int, spanning: bool) -> DataFrame:
    """Candidate pairs (signature, a, b) in groups whose members are not all in one component.

    A group that fills one block is compared as a whole. The members of a larger one are grouped again by their
    signatures under another deal of the domain, of which similar sets share one too, so what they have in common by
    chance or in one part alone no longer holds them together; what is larger still is compared block by block.
    """
    members = shared.select("signature", "id").join(found, "id", "left").select("signature", "id", F.coalesce("component", "id").alias("component"), F.col("signature").alias("group"))
    inside = staged(_open(members).join(sketches.select("id", "n_shingles"), "id"), "inside")
    sizes = staged(_blocks(inside), "sizes")
    groups = inside.join(sizes.where("blocks = 1").select("group"), "group", "left_semi")
    held = [inside, sizes]
    if not sizes.where("blocks > 1").isEmpty():
        large = inside.join(sizes.where("blocks > 1").select("group"), "group", "left_semi")
        again = _signatures_again(features.join(large.select("id").distinct(), "id", "left_semi"), percent)
        finer = large.join(again, "id").withColumn("again", F.explode(F.array_distinct("again")))
        finer = staged(_open(finer.withColumn("group", F.xxhash64("group", "again")).select(*inside.columns)), "finer")
        held.append(finer)
        groups = groups.unionByName(finer)
    pairs = groups.join(_blocks(groups), "group").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    pairs = pairs.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("group", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), F.col("block").alias("side"), "id", "component", "signature")
    pairs = pairs.join(sketches, "id")
    pairs = pairs.select("group", "x", "y", "id", "component", "side", "n_shingles", "signature", "sketch").repartition("group", "x", "y").sortWithinPartitions("group", "x", "y", "id")
    near = staged(pairs.mapInArrow(released(_compare(percent, spanning)), "signature long, a long, b long"), "near")
    discard(*held)
    return near


def set_components(docs: DataFrame, sets: DataFrame, n: int, percent: int, *spent: DataFrame) -> DataFrame:
    """(id, component) over the ids of sets that link with another set.

    docs(doc_id, text); sets: a row of each distinct set of shingle_sets(docs), with an id of its own. A set without
    signatures links with nothing; empty tables give no rows. spent: staged tables that go once sets is read.
    """
    shared = staged(shared_signatures(sets), "shared")  # sets that have a signature in common with another
    pairs = staged(shared.where("id != center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    needed = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    held = staged(sets.select("id", "set_id", "doc_id", "text_key", "n_shingles", "sketch").join(needed, "id"), "held")
    sketches = held.select("id", "n_shingles", "sketch")
    discard(*spent)

    # 1. each set with the nearest of the least sets of its groups
    side = lambda k: sketches.select(F.col("id").alias(k), F.col("n_shingles").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    near = _nearest(pairs.join(side("a"), "a").join(side("b"), "b"), percent)
    best = staged(near.groupBy("b").agg(F.min_by("a", F.struct("differ", "a")).alias("a")), "best")
    origin = held.select("id", "set_id", F.col("doc_id").alias("of"), F.col("text_key").alias("key"))
    text = docs.select(F.col("doc_id").cast("long"), "text").join(small(origin), F.col("doc_id").eqNullSafe(F.col("of")) & (F.xxhash64("text") == F.col("key")))
    features = staged(_features(text, n), "features")
    if not features.groupBy("id").count().where("count > 1").isEmpty():  # repeated rows; otherwise features needn't be shuffled
        every, features = features, staged(features.dropDuplicates(["id"]), "features")
        discard(every)
    links = staged(_verified(best, features, percent).where("linked").select("a", "b"), "links")
    found = components(links)
    discard(pairs, best)
    # 2. what may link components that share a signature: first a forest of near pairs; where one of them fails, all
    done = []
    for spanning in (True, False):
        near = _residual(shared, found, sketches, features, percent, spanning)
        tried = staged(_verified(near, features, percent), "tried")
        done += [near, tried]
        links = links.union(tried.where("linked").select("a", "b"))
        if not tried.where("linked").isEmpty():
            found = components(links)
        failed = near.join(tried.where("not linked"), ["a", "b"], "left_semi").select("signature").distinct()
        if not spanning or failed.isEmpty():
            break
        shared = staged(shared.join(failed, "signature", "left_semi"), "shared")
        done.append(shared)
    discard(held, features, links, *done)
    return found


def near_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Links documents whose sets of n-word shingles have a Jaccard similarity of percent / 100 or more, exactly.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text with A-Z in lower case. A text of fewer than n words is one
    shingle; one without words, or null, has none and links with nothing. Sets that share a PartEnum signature are
    candidates. First each set is verified against the nearest of the least sets of its groups; then pairs of a group
    that lie in different components are compared by sketches that never miss a link, and those of a spanning forest
    are verified; a group too large for one comparison is first dealt anew by signatures of another kind. Only where one of these fails are all near pairs between components verified.

    Returns a row per input row: doc_id, text_key (xxhash64 of the text), n_shingles, set_id, component_id (the least doc_id reachable), first (true
    for one row of each component, that of the least doc_id). Rows with a null doc_id
    link as others do and get the least doc_id of the rest, or null. Repeated rows have equal sets, so one component.
    An empty table gives no rows. The session's batches stay small afterwards.
    """
    small_batches(docs.sparkSession)
    sets = staged(shingle_sets(docs, n, percent).withColumn("id", F.monotonically_increasing_id()), "sets")
    # of equal sets the first row stands for all
    filled = sets.where("set_id is not null").select("set_id", "id")
    repeated = filled.groupBy("set_id").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("first_id != last_id")
    later = staged(filled.join(repeated, "set_id").where("id != first_id").select("id", "first_id"), "later")
    narrow = staged(sets.select("doc_id", "text_key", "n_shingles", "set_id", "id"), "narrow")
    found = set_components(docs, sets.where("set_id is not null").join(small(later.select("id")), "id", "left_anti"), n, percent, sets)
    rows = narrow.join(later, "id", "left").withColumn("row_id", F.col("id")).withColumn("id", F.coalesce("first_id", "id"))
    rows = rows.join(found, "id", "left").withColumn("component", F.when(F.col("set_id").isNotNull(), F.coalesce("component", "id")))
    least = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")).alias("first_row"))
    rows = staged(rows.join(least, "component", "left").select("doc_id", "text_key", "n_shingles", "set_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce(F.col("first_row.row_id") == F.col("row_id"), F.lit(True)).alias("first")), "groups")
    discard(narrow, later)
    return rows


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), n=3, percent=90).select("doc_id", "n_shingles", "component_id")
