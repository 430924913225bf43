"""The corpus pipeline: classify, drop recurring lines, drop near duplicates, mix sources, pack into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duecourse.llm.common import discard, free, small_batches, staged
from duecourse.llm.line_dedup import drop_recurring_lines
from duecourse.llm.mixing import mix
from duecourse.llm.ngram_join import near_groups
from duecourse.llm.packing import pack, pieces_digest, tokenizer_path
from duecourse.llm.quality_classifier import classify


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null text is judged by its metadata; repeated rows go or stay together; without labels of both sides all rows stay;
    an empty table stays empty.
    """
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels).where("kept").select(*docs.columns)


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; a document that had words and is left without any goes too.

    n_chars of a changed text is its new length. A null text, and one without words, stays as it is; rows with a null
    doc_id lose recurring lines but aren't counted; repeated rows are treated alike; an empty table stays empty.
    """
    rows = drop_recurring_lines(docs)
    rows = rows.where((F.col("lines_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    changed = F.when(F.col("lines_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return rows.withColumn("n_chars", changed).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-duplicate texts the one with the least doc_id stays.

    Texts are linked by five-word shingles with a similarity of 0.8 or more. Null texts and texts without words are
    linked with nothing and stay; a row with a null doc_id stays only where its whole group has null ids; of repeated
    rows one stays; an empty table stays empty.
    """
    at, key = free(docs.columns, "near_at", "near_key")
    rows = near_groups(docs).select(F.struct("doc_id", "text_key").alias(key), "first")
    gone = staged(rows.where("not first").select(key).distinct(), "gone")
    both = staged(rows.where("first").join(gone, key, "left_semi").select(key).distinct(), "both")
    keyed = docs.withColumn(at, F.struct(F.col("doc_id").cast("long"), F.xxhash64("text")).cast(gone.schema[key].dataType))
    meets = lambda side, how: keyed.join(side, F.col(at).eqNullSafe(F.col(key)), how)
    left = meets(gone, "left_anti").select(*docs.columns)
    if both.isEmpty():
        return left
    # repeated rows: the same row both stays and goes, so one of it stays
    return left.union(meets(both, "left_semi").dropDuplicates([at]).select(*docs.columns))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for, none, once or up to three times.

    Copies are equal rows. A null source is a source, a null text has no words and is drawn as others are; repeated rows
    are drawn alike; an empty table stays empty.
    """
    return mix(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, a row for each piece of a document in one.

    A null or empty text is one piece, its end token; repeated rows are packed each; an empty table gives no rows.
    """
    small_batches(spark)
    return pieces_digest(pack(docs, tokenizer_path()))


STAGES = [
    ("quality classifier", classified),
    ("line dedup", without_recurring_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources to target weights", mixed_sources),
    ("packing", packed),
]

#: The classifier and the seeded draws have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{k}")
            discard(before)
    return docs
