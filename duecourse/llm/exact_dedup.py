"""Exact dedup by progressive refinement: length, then prefix hash, then full hash; DataFrame functions only."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, small, staged

#: Characters of the text that the prefix hash covers.
PREFIX = 64
#: Bits of the filter that each level hands to the next, as a table of 4 KB bitmaps: 16 MB whatever the input's size.
FILTER_BITS = 1 << 27


def normalised(text: Column) -> Column:
    """The text with A-Z, and no other letter, in lower case; empty for null."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def _bit(key: Column) -> Column:
    return F.pmod(key, F.lit(FILTER_BITS))


def _repeated(keys: DataFrame) -> DataFrame:
    """Bitmaps (bucket, bits) of the keys(key) that more than one row has; counted map-side first."""
    twice = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(_bit(F.col("key")).alias("bit"))
    return twice.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))


def _in_filter(rows: DataFrame, key: str, bitmaps: DataFrame, name: str) -> DataFrame:
    """rows with a column `name`: whether the key's bit is set, so true for each repeated key and for few others."""
    rows = rows.join(F.broadcast(bitmaps), F.bitmap_bucket_number(_bit(F.col(key))) == F.col("bucket"), "left")
    at = F.bitmap_bit_position(_bit(F.col(key)))
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return rows.withColumn(name, F.coalesce(bit, F.lit(False))).drop("bucket", "bits")


def exact_copies(docs: DataFrame, carried: dict[str, Column] | None = None) -> DataFrame:
    """A row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, and the carried columns.

    Texts are equal when identical but for the case of A-Z; a null text is an empty one. Of equal texts the row with the
    largest doc_id stays, keep_id; a null doc_id is less than any other, and of rows that also agree in doc_id one stays.
    First the lengths in bytes are counted, then the pairs of length and prefix hash where the length repeats; only
    texts whose pair repeats are read whole, for their SHA-256. Each level hands the next a filter of fixed size that may
    let through a row too many, never one too few. Rows are counted before they are shuffled, so a group of any size is a
    few rows per task. An empty table gives no rows; other columns of docs are ignored but for the carried ones, which
    are expressions over docs, computed in the scan that reads the texts.
    """
    carried = carried or {}
    text = F.coalesce("text", F.lit(""))
    length = F.octet_length(text)
    prefix = F.xxhash64(length, normalised(F.substring(text, 1, PREFIX)))
    # one scan yields both, since a columnar file is decoded for either
    heads = staged(docs.select(F.xxhash64(length).alias("length_key"), prefix.alias("prefix_key")), "heads")
    lengths = staged(_repeated(heads.select(F.col("length_key").alias("key"))), "lengths")
    again = _in_filter(heads, "length_key", lengths, "again").where("again")
    prefixes = staged(_repeated(again.select(F.col("prefix_key").alias("key"))), "prefixes")
    discard(heads, lengths)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"), prefix.alias("_prefix_key"), *[c.alias(f"_carried_{k}") for k, c in carried.items()])
    rows = _in_filter(rows, "_prefix_key", prefixes, "_again")
    full = F.when(F.col("_again"), F.unhex(F.sha2(normalised(F.col("_text")), 256)))
    hashed = staged(rows.select("doc_id", full.alias("_full"), F.monotonically_increasing_id().alias("_row"), *[f"_carried_{k}" for k in carried]), "hashed")
    discard(prefixes)
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("given"), "doc_id", "_row"))
    groups = hashed.where("_full is not null").groupBy(F.col("_full").alias("_group")).agg(F.count("*").alias("n"), best.alias("best")).where("n > 1")
    groups = staged(groups.select("_group", "n", F.col("best.doc_id").alias("best_id"), F.col("best._row").alias("best_row")), "groups")
    out = hashed.join(small(groups), F.col("_full") == F.col("_group"), "left")  # a hot group's rows are split by AQE where this isn't a broadcast
    alone = F.col("n").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("_row") == F.col("best_row"))).alias("kept"),
        *[F.col(f"_carried_{k}").alias(k) for k in carried],
    )


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(documents(spark, sf_dir), {"text_sha256": F.sha2(normalised(F.col("text")), 256)})


#: The same in DuckDB, for a table whose doc_ids are unique.
ORACLE = f"""
WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256 FROM texts WINDOW same AS (PARTITION BY t)
"""
