"""License scans: MinHash bands over overlapping windows retrieve license templates, shingle containment verifies them."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, coefficients, documents, grams, sliced
from .license_texts import TEMPLATES, bodies

#: Words in a shingle, and hash functions; each function is a band of one row. An occurrence lies whole in a window of
#: less than four times its words. With `CONTAINED` of a template's shingles there, window and template share at least
#: 0.8 / (4 + 0.2) of all their shingles, 0.19, so that one of the bands meets with a probability of at least
#: 1 - (1 - 0.19) ** 48 = 0.99996.
SHINGLE = 2
BANDS = 48
#: The part of a template's shingles that a window must have.
CONTAINED = 0.8
#: At most so many bytes of templates; they go to every task.
TEMPLATE_BYTES = 8 << 20


_MARKS = re.compile(r"[^\w\x00-\x7f]")


def _parted(texts: list[str | None]) -> Words:
    """Words without punctuation, in lower case; other marks than ASCII's part words as well."""
    return Words([t if t is None or t.isascii() else _MARKS.sub(".", t) for t in texts], lower=True, marks=True)


def _spans(text: str, found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """found with words that spaces part instead of words without punctuation."""
    plain, parted = Words([_MARKS.sub(".", text)]), _parted([text])
    return [(k, int(np.searchsorted(plain.start, parted.start[a], "right")) - 1, int(np.searchsorted(plain.start, parted.start[b - 1], "right")), part) for k, a, b, part in found]


def _occurrences(at: list[int], shingles: list[int], need: int, held_by: dict[int, int], width: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, distinct shingles) of a template's occurrences among its hits: each is the shortest run that ends
    first and has `need` distinct shingles within `width` places, and takes further hits that complete it. held_by: how
    often the template has each shingle."""
    whole = sum(held_by.values())
    held: deque[tuple[int, int]] = deque()
    times: dict[int, int] = {}

    def leave() -> None:
        x = held.popleft()[1]
        times[x] -= 1
        if not times[x]:
            del times[x]

    done = False
    for p, x in zip(at, shingles, strict=True):
        if done:
            more = p - held[0][0] < width and times.get(x, 0) < held_by[x]
            # a first hit that stands apart and comes again close by was a stray one
            stray = 1 < len(held) < whole and x == held[0][1] and p - held[-1][0] < held[1][0] - held[0][0]
            if not more and not stray:
                yield held[0][0], held[-1][0], len(times)
                held.clear()
                times.clear()
                done = False
        held.append((p, x))
        times[x] = times.get(x, 0) + 1
        while p - held[0][0] >= width or times[held[0][1]] > held_by[held[0][1]]:
            leave()
        done = done or len(times) >= need
    if done:
        yield held[0][0], held[-1][0], len(times)


def _best(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """found, in order of place, without those that lie within the span of one with a greater containment, or as great a one and more words."""
    out, before = [], []  # before: those that may hold what comes next
    for m in sorted(found, key=lambda m: (m[1], -m[2], -m[3])):
        before = [x for x in before if x[2] > m[1]]
        if not any(x[2] >= m[2] and (x[3], x[2] - x[1]) > (m[3], m[2] - m[1]) for x in before):
            out.append(m)
        before.append(m)
    return out


def _scale(words: int) -> int:
    """Words of a window: with steps of half a window, some window holds every occurrence whole."""
    w = 4
    while w < 2 * words:
        w *= 2
    return w


class Templates:
    def __init__(self, texts: dict[str, str]):
        self.names = list(texts)
        w = _parted(list(texts.values()))
        self.sets, self.times = zip(*[np.unique(grams(w.of(i), SHINGLE), return_counts=True) for i in range(len(self.names))], strict=True)
        self.words = [len(w.of(i)) for i in range(len(self.names))]
        c = coefficients(BANDS, 23).astype(np.uint32)[:, None] | np.uint32(1)
        self.multiply = c
        self.by_scale: dict[int, list[int]] = {}
        for k, n in enumerate(self.words):
            self.by_scale.setdefault(_scale(n), []).append(k)
        self.least = {k: self.hashed(s).min(1) for k, s in enumerate(self.sets) if len(s)}

    def hashed(self, shingles: np.ndarray) -> np.ndarray:
        """A row of values per hash function."""
        x = (shingles >> np.uint64(32)).astype(np.uint32)[None, :] * self.multiply
        return (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)

    def matches(self, h: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(template, first word, end, containment) of a document's words, one per template and occurrence."""
        shingles = grams(h, SHINGLE)
        if not len(shingles):
            return []
        smallest = min(self.by_scale) // 2
        values = self.hashed(shingles)
        pad = -len(shingles) % smallest
        values = np.pad(values, ((0, 0), (0, pad)), constant_values=np.uint32(0xFFFFFFFF))
        block, size = values.reshape(BANDS, -1, smallest).min(2), smallest
        near: dict[int, list[tuple[int, int]]] = {}
        for scale in range(1, max(self.by_scale).bit_length()):
            width = smallest << scale
            if width > max(self.by_scale):
                break
            # windows of two blocks at every block
            window = np.minimum(block, np.concatenate([block[:, 1:], np.full((BANDS, 1), 0xFFFFFFFF, np.uint32)], 1))
            for k in self.by_scale.get(width, ()):
                for at in np.flatnonzero((window == self.least[k][:, None]).any(0)):
                    low, high = int(at) * size, min(len(shingles), int(at) * size + width)
                    spans = near.setdefault(k, [])
                    if spans and low <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], high)
                    else:
                        spans.append((low, high))
            if block.shape[1] % 2:
                block = np.concatenate([block, np.full((BANDS, 1), 0xFFFFFFFF, np.uint32)], 1)
            block, size = np.minimum(block[:, ::2], block[:, 1::2]), size * 2
        out: list[tuple[int, int, int, float]] = []
        for k, spans in sorted(near.items()):
            whole = len(self.sets[k])
            held_by = dict(zip(self.sets[k].tolist(), self.times[k].tolist(), strict=True))
            need = next(n for n in range(whole + 1) if n / whole >= CONTAINED)
            for low, high in spans:
                where = np.flatnonzero(np.isin(shingles[low:high], self.sets[k])) + low
                if len(where) >= need:
                    out += [(k, a, b + SHINGLE, n / whole) for a, b, n in _occurrences(where.tolist(), shingles[where].tolist(), need, held_by, _scale(self.words[k]))]
        return out


def all_templates() -> dict[str, str]:
    """The notices, short bodies and lines, and the long bodies."""
    return TEMPLATES | bodies()


def load_templates(table: DataFrame, most: int = TEMPLATE_BYTES) -> dict[str, str]:
    """table(license, text) as templates for license_matches(), in order of name; of a folder of files, spark.read.text(..., wholetext=True) with the files' names.

    Rows without a name or with fewer than SHINGLE words are left out; of several texts of one name each is a template,
    numbered from the second on. More than `most` bytes of texts are an error, as every task gets them.
    """
    rows = table.where("license is not null and text is not null").select("license", "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > most:
        raise ValueError(f"{size} bytes of templates, of at most {most}")
    out: dict[str, str] = {}
    for r in sorted(rows.distinct().collect()):
        if len(_parted([r.text]).hash) >= SHINGLE:
            n = sum(k == r.license or k.startswith(f"{r.license} #") for k in out)
            out[f"{r.license} #{n + 1}" if n else r.license] = r.text
    return out


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """A row per license notice found in docs(doc_id, text): doc_id, license, first_word, end_word, containment.

    Of matches within one another's span only that with the greatest containment is returned: licenses quote each other.
    Words are compared in lower case and without punctuation; first_word and end_word count words between spaces. A
    template must have at least SHINGLE words; load_templates() reads a table of them. They are a bounded parameter and
    go to every task. A null or empty text has none; a null doc_id stays null; repeated rows give
    repeated matches; an empty table gives no rows; other columns are ignored.
    """
    known = all_templates() if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Templates(known)
        for batch in batches:
            for part in sliced(batch, 1):
                texts = part.column(1).to_pylist()
                w, rows = _parted(texts), []
                for i, doc_id in enumerate(part.column(0).to_pylist()):
                    if hits := _best(held.matches(w.of(i))):
                        rows += [(doc_id, held.names[k], a, b, c) for k, a, b, c in _spans(texts[i], hits)]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["doc_id", "license", "first_word", "end_word", "containment"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, license string, first_word long, end_word long, containment double")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(documents(spark, sf_dir))
