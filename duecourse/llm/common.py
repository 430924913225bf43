"""Helpers shared by the operators: staging between jobs, and words and hashes of whole text batches."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Class of the characters between words, the complement of [^\x20\x09-\x0D].
SPACE = r"[\x20\x09-\x0D]"
#: At most so many bytes go into a broadcast; a larger side is joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Bytes of text, and rows, that one numpy pass takes at a time (a longer document is taken whole).
SLICE_BYTES = 1 << 20
SLICE_ROWS = 1000
#: Bytes of rows that Spark hands to a Python worker at a time.
ARROW_BYTES = 4 << 20
#: Rows that a scan decodes at a time.
READ_ROWS = 512

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, in local mode a temporary folder, on a cluster an error."""
    if set_dir := spark.conf.get("spark.checkpoint.dir", None):
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set: tables between jobs need a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spark-"))
    return _own_folder[0]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: later jobs neither recompute it nor depend on an executor.

    The table stays until discard() or the end of the driver.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(_discard_all, spark)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _tables[path] = table
    return table


_tables: dict[str, DataFrame] = {}


def discard(*tables: DataFrame) -> None:
    """Removes staged tables that nothing reads any more; other frames are left alone."""
    for path, held in list(_tables.items()):
        if any(held is t for t in tables):
            del _tables[path]
            remove(held.sparkSession, path)


def _discard_all(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:  # the session may have been stopped before
        for path in list(_tables):
            remove(spark, path)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its values take at most so many bytes (df should be staged or cheap); else df, to be shuffled."""
    fixed = [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType))]
    width = F.lit(8 * max(1, len(fixed)))
    for c in df.columns:
        if c not in fixed:
            width = width + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 8
    rows = limit // (8 * len(df.columns)) + 1  # so many rows are too many in any case
    n, size = df.select(width.alias("w")).limit(rows).agg(F.count("*"), F.sum("w")).first()
    return F.broadcast(df) if n < rows and (size or 0) <= limit else df


def free(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores after it until no column has it, so that a table's own columns are left alone."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession) -> None:
    """From now on this session's scans decode at most READ_ROWS rows at a time and hand Python at most ARROW_BYTES, or what it is set to if that is less.

    By default a scan decodes 4,096 rows at a time. With whole texts or sets in them that is tens of MB in arrays that
    double as they fill, and an executor's heap grows for such arrays before it collects those of earlier tasks.
    An Arrow batch has up to 10,000 rows or 64 MB by default, each of whose columns an executor builds outside its heap
    in the same way. Its allocator keeps much of them, beside the heap, for the stages that follow.
    """
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) > ARROW_BYTES:
        spark.conf.set(size, str(ARROW_BYTES))
    rows = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(rows)) > READ_ROWS:
        spark.conf.set(rows, str(READ_ROWS))


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder, wherever it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text as an array; empty for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(spaced, " +"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words a text has, without an array function per word."""
    spaced = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(spaced == "", 0).otherwise(F.size(F.split(spaced, " +"))).cast("long")


# ---- numpy over batches of texts

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Also ASCII marks, so that words come without punctuation.
_IS_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.cumprod(np.concatenate([np.ones(1, _U), np.full(255, _P, _U)]))]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def coefficients(n: int, seed: int = 1) -> np.ndarray:
    """n odd 64-bit multipliers."""
    return mixed(np.arange(1, n + 1, dtype=_U) + _U(seed * 1_000_003)) | _U(1)


def _power(n: int) -> np.ndarray:
    while len(_powers[0]) < n:
        _powers[0] = np.concatenate([_powers[0], _powers[0] * _powers[0][-1] * _P])
    return _powers[0]


def sliced(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows with about `most` bytes in a string or binary column together, one row at least.

    The runs are cut by Arrow's offsets, so only a run's values become Python objects at a time.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        stop = min(max(stop, at + 1), at + rows)
        yield batch.slice(at, stop - at)
        at = stop


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def give_back() -> None:
    """Hands memory that a worker's allocators hold free to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a task's function over batches, after which the worker gives freed memory back to the system.

    Python workers live on after a stage, and their allocators keep what they once had; the next stage's come on top.
    """

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


class Words:
    """The words of a few texts: hashes, the first word of each text, and byte bounds in one buffer; with marks, ASCII punctuation parts words too."""

    def __init__(self, texts: list[str | None], lower: bool = False, marks: bool = False):
        raw = [(t or "").encode() for t in texts]
        self.buffer = b"\n".join(raw) + b"\n"
        data = np.frombuffer(self.buffer, np.uint8)
        space = (_IS_MARK if marks else _IS_SPACE)[data]
        edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=np.int8(1)))
        self.start, self.end = edge[::2], edge[1::2]
        ends = np.cumsum([len(r) + 1 for r in raw])
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)])
        if not len(self.start):
            self.hash = np.empty(0, _U)
            return
        length = self.end - self.start
        owner = np.repeat(np.arange(len(length)), length)
        inside = np.flatnonzero(~space)
        value = (_LOWER[data[inside]] if lower else data[inside]).astype(_U) + _U(1)
        value *= _power(int(length.max()))[inside - self.start[owner]]
        at = np.concatenate([[0], np.cumsum(length)[:-1]])
        self.hash = mixed(np.add.reduceat(value, at) + length.astype(_U) * _U(0xD6E8FEB86659FD93))

    def of(self, i: int) -> np.ndarray:
        return self.hash[self.first[i] : self.first[i + 1]]


def grams(h: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """A hash for each run of n words."""
    c = coefficients(n, seed)
    if len(h) < n:
        return np.empty(0, _U)
    out = np.zeros(len(h) - n + 1, _U)
    for j in range(n):
        out += h[j : len(h) - n + 1 + j] * c[j]
    return mixed(out)


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct shingles of n words; with fewer words the whole sequence as one; none without words."""
    if len(h) >= n:
        return np.unique(grams(h, n))
    if not len(h):
        return np.empty(0, _U)
    return mixed(np.array([(h * coefficients(len(h), 77)).sum(dtype=_U) + _U(len(h))], _U))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list array of numpy arrays."""
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))
