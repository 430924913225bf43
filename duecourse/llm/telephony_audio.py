"""Media columns of telephony audio: WAV with mu-law, A-law or IMA ADPCM samples, decoded to resampled PCM."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, documents, sliced

#: Bytes of a block; a payload is filled up with bytes 255 to a positive multiple.
BLOCK = 576
RATE = 8000
#: Codec names and their fixed WAV format tags.
CODECS = {"mulaw": 7, "alaw": 6, "adpcm": 0x11}
#: Samples of an ADPCM block: one in the header, two in each byte after its four.
BLOCK_SAMPLES = 1 + 2 * (BLOCK - 4)

#: Fixed step sizes and index changes of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307,
    337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358,
    5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 255
    size = (((code & 15) * 8 + 132) << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, step = code >> 4 & 7, (code & 15) * 16
    size = np.where(part == 0, step + 8, (step + 264) << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(n, block bytes) to (n, samples): each step decodes one sample of all blocks."""
    n = len(blocks)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.clip(blocks[:, 2].astype(np.int32), 0, len(STEPS) - 1)
    codes = np.empty((2 * (blocks.shape[1] - 4), n), np.int32)
    codes[::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, n), np.int16)
    out[0] = value
    for k, code in enumerate(codes):
        step = STEPS[index]
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + CHANGES[code & 7], 0, len(STEPS) - 1)
        out[k + 1] = value
    return out.T


def upsample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: between two samples the four around them weigh -1, 9, 9, -1 sixteenths."""
    if not len(pcm):
        return pcm
    x = np.pad(pcm.astype(np.int32), (1, 2), mode="edge")
    between = (9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8) >> 4
    out = np.empty(2 * len(pcm), np.int16)
    out[::2], out[1::2] = pcm, np.clip(between, -32768, 32767)
    return out


def read_wav(media: bytes) -> tuple[str, int, bytes]:
    """Codec, block size and the stored bytes; ValueError for anything else."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if at + 8 + size > len(media):
            raise ValueError("a chunk is cut off")
        if name == b"fmt ":
            tag, _, _, _, align = struct.unpack_from("<HHIIH", media, at + 8)
            kind = {v: k for k, v in CODECS.items()}.get(tag)
        elif name == b"data":
            if kind is None or kind == "adpcm" and (align < 5 or size % align):
                raise ValueError("an unknown format")
            return kind, align, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def payload(text: Column) -> Column:
    """UTF-8 bytes of a text, filled up with bytes 255 to a positive multiple of BLOCK."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    return F.call_function("rpad", raw, (F.greatest(F.ceil(F.length(raw) / BLOCK), F.lit(1)) * BLOCK).cast("int"), F.unhex(F.lit("FF")))


def _little(value: Column, size: int) -> Column:
    digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * (size - k) - 1, 2) for k in range(size)]))


def write_wav(data: Column, codec: Column) -> Column:
    """A WAV file around the samples, which it holds unchanged; its size must be even."""
    raw, n = lambda x: F.lit(x), F.length(data)
    adpcm = codec == "adpcm"
    tag = F.when(codec == "mulaw", CODECS["mulaw"]).when(codec == "alaw", CODECS["alaw"]).otherwise(CODECS["adpcm"])
    fmt = F.concat(
        _little(tag, 2), _little(F.lit(1), 2), _little(F.lit(RATE), 4), _little(F.when(adpcm, RATE * BLOCK // BLOCK_SAMPLES).otherwise(RATE), 4),
        _little(F.when(adpcm, BLOCK).otherwise(1), 2), _little(F.when(adpcm, 4).otherwise(8), 2),
        F.when(adpcm, F.concat(_little(F.lit(2), 2), _little(F.lit(BLOCK_SAMPLES), 2))).otherwise(_little(F.lit(0), 2)),
    )
    samples = F.when(adpcm, n / BLOCK * BLOCK_SAMPLES).otherwise(n)
    body = F.concat(raw(b"WAVE"), raw(b"fmt "), _little(F.length(fmt), 4), fmt, raw(b"fact"), _little(F.lit(4), 4), _little(samples, 4), raw(b"data"), _little(n, 4), data)
    return F.concat(raw(b"RIFF"), _little(F.length(body), 4), body)


DECODED = T.StructType(
    [
        T.StructField("codec", T.StringType()),
        T.StructField("stored", T.BinaryType()),
        T.StructField("pcm", T.BinaryType()),
        T.StructField("n_samples", T.LongType()),
        T.StructField("peak", T.IntegerType()),
        T.StructField("power", T.DoubleType()),
        T.StructField("crossings", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)


def encode_media(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with `media`, a WAV file that holds the text's payload, in a codec that a checksum of the payload picks."""
    rows = rows.withColumn("__payload", payload(F.col(text)))
    codec = F.element_at(F.array(*[F.lit(k) for k in CODECS]), (F.crc32("__payload") % len(CODECS) + 1).cast("int"))
    return rows.withColumn("media", write_wav(F.col("__payload"), codec)).drop("__payload")


def decode_media(rows: DataFrame) -> DataFrame:
    """Reads the column `media` of rows and adds codec, stored (the samples' bytes), pcm (16-bit at twice the rate), n_samples, peak, power, crossings, error.

    A null or broken file gives nulls and an error; nothing is raised for it. Blocks of all ADPCM files of a slice are
    decoded together. All columns stay, null or not, but those named like the new ones, which are replaced; repeated
    rows come out alike, an empty table gives no rows.
    """
    rows = rows.drop(*[f.name for f in DECODED])
    column = rows.columns.index("media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.string())
        for batch in batches:
            for part in sliced(batch, column, SLICE_BYTES // 4):
                read: list = []
                for m in part.column(column).to_pylist():
                    try:
                        read.append(read_wav(m or b""))
                    except (ValueError, struct.error) as e:
                        read.append(str(e))
                pcm: dict[int, np.ndarray] = {i: (MULAW if r[0] == "mulaw" else ALAW)[np.frombuffer(r[2], np.uint8)] for i, r in enumerate(read) if r[0] in ("mulaw", "alaw")}
                for align in {r[1] for r in read if r[0] == "adpcm"}:
                    which = [i for i, r in enumerate(read) if r[0] == "adpcm" and r[1] == align]
                    blocks = np.frombuffer(b"".join(read[i][2] for i in which), np.uint8).reshape(-1, align)
                    decoded = decode_adpcm(blocks)
                    ends = np.cumsum([len(read[i][2]) // align for i in which])
                    pcm.update({i: x.ravel() for i, x in zip(which, np.split(decoded, ends[:-1]), strict=True)})
                rows = []
                for i, r in enumerate(read):
                    if isinstance(r, str):
                        rows.append((None,) * 7 + (r,))
                        continue
                    x = pcm[i].astype(np.int64)
                    up = upsample(pcm[i]).astype("<i2")
                    rows.append((r[0], r[2], up.tobytes(), len(up), int(np.abs(x).max(initial=0)), float((x * x).mean()) if len(x) else 0.0, int(((x[1:] < 0) != (x[:-1] < 0)).sum()), None))
                columns = zip(*rows, strict=True)
                yield pa.record_batch([*part.columns, *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], [*part.schema.names, *DECODED.names])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *DECODED.fields]))


def op5_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    media = encode_media(docs).withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long")).drop("text")
    return decode_media(media).select(
        "doc_id", "n_bytes", F.length("stored").cast("long").alias("payload_bytes"), F.sha2("stored", 256).alias("payload_sha256"), F.crc32(F.substring("stored", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", "codec", "n_samples", "peak", F.round(F.sqrt("power"), 3), "crossings", F.crc32("pcm")).alias("feature"),
    )
