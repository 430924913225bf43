"""Stores in a folder: each commit rewrites the partitions that it touches and names all of them in a manifest.

A reader sees the partitions of the last manifest, so a commit is there as a whole or not at all, and what a failed one
has written is never read. Manifests carry the id of their batch: a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DIGITS = 10


class ConflictError(Exception):
    """Another commit has taken this version; read again and try again."""


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, root: str) -> None:
    if spark.sparkContext._jsc is not None:
        fs, where = _files(spark, root)
        fs.delete(where, True)


def manifest(spark: SparkSession, root: str) -> dict:
    """version, batches (ids that are in it), partitions (value to folder) of the last commit; empty for a new store."""
    fs, where = _files(spark, f"{root}/commits")
    names = sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []
    names = [n for n in names if n.endswith(".json")]
    if not names:
        return {"version": 0, "batches": [], "partitions": {}}
    return json.loads("\n".join(r.value for r in spark.read.text(f"{root}/commits/{names[-1]}").collect()))


def read(spark: SparkSession, root: str, schema: T.StructType | str) -> DataFrame:
    """The rows of the last commit."""
    paths = sorted(manifest(spark, root)["partitions"].values())
    return spark.read.schema(schema).parquet(*[f"{root}/{p}" for p in paths]) if paths else spark.createDataFrame([], schema)


def touched(spark: SparkSession, root: str, schema: T.StructType | str, values: list[str], by: str) -> DataFrame:
    """The rows of the last commit in the given partitions; no other folder is read."""
    held = manifest(spark, root)["partitions"]
    paths = [f"{root}/{held[v]}" for v in values if v in held]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def commit(rows: DataFrame, root: str, by: str, values: list[str], batch: str) -> bool:
    """Makes rows the whole content of the partitions `values` of the text column `by`; False if the batch is in already.

    The rows are written apart, by partition; then the manifest of the next version is created, which fails with a
    ConflictError where another commit came first. Partitions without rows are gone.
    """
    spark = rows.sparkSession
    now = manifest(spark, root)
    if batch in now["batches"]:
        return False
    part = f"data/{uuid.uuid4().hex}"
    kept = rows.withColumn("_part", F.col(by))
    kept.write.partitionBy("_part").parquet(f"{root}/{part}")
    fs, where = _files(spark, f"{root}/{part}")
    new = {spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath().toString()).getName() for s in fs.listStatus(where) if s.isDirectory()}
    folders = {v: f"{part}/_part={v}" for v in values if f"_part={v}" in new}
    if len(folders) != len(new):
        raise ValueError(f"rows of partitions that aren't named: {sorted(new - {f'_part={v}' for v in values})}")
    partitions = {v: p for v, p in now["partitions"].items() if v not in values} | folders
    text = json.dumps({"version": now["version"] + 1, "batches": [*now["batches"], batch], "partitions": partitions})
    fs, where = _files(spark, f"{root}/commits/{now['version'] + 1:0{_DIGITS}d}.json")
    try:
        out = fs.create(where, False)
    except Exception as e:
        raise ConflictError(f"version {now['version'] + 1} of {root} is there") from e
    out.write(bytearray(text, "utf-8"))
    out.close()
    return True


def upsert(fresh: DataFrame, root: str, schema: T.StructType | str, by: str, merge, batch: str) -> bool:
    """Commits merge(store, fresh) for the partitions that fresh has rows in; the others' folders stay as they are."""
    values = sorted(r[0] for r in fresh.select(F.col(by).cast("string")).distinct().collect())  # the partitions of a batch
    return commit(merge(touched(fresh.sparkSession, root, schema, values, by), fresh), root, by, values, batch)
