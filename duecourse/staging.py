"""Tables between jobs, broadcasts of a checked size, and places in the order of a whole table."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: At most so many rows are broadcast by hinted(); its callers' rows are a few numbers or short texts wide.
BROADCAST_ROWS = 500_000
_AT = "_place_at"


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode without one, a temporary folder; on a cluster without one, an error."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df written to folder() and read back."""
    folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as a compressed table in folder(), read back; checkpoints are several times as large. It stays until the end of the driver."""
    spark = df.sparkSession
    path = f"{folder(spark)}/stored-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None:  # the session may have been stopped before
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def hinted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, which should be cut, with a broadcast hint if it has at most so many rows; else it is joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_place(rows: DataFrame, *by: Column, name: str = "place", stored: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """rows with their place, from 1, in the order of the whole table by `by` (ascending; a descending key is given as such).

    Rows are range partitioned and each partition is sorted; a row's place is its partition's offset, a running sum over
    one count per partition, plus its place in the partition. So only the partitions' counts pass through one task.
    Rows that agree in all keys get different places in any order. An empty table stays empty; a column that has the
    name of the place is replaced.
    """
    kept = [c for c in rows.columns if c != name]
    dealt = rows.select(*kept).repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = stored(dealt.withColumn(_AT, F.monotonically_increasing_id()))  # the partition's number above 33 bits, the row's below
    part = F.call_function("shiftright", F.col(_AT), F.lit(33)).cast("int")
    counts = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))  # a row per partition
    placed = dealt.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return placed.select(*kept, (F.col("_offset") + F.col(_AT).bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long").alias(name))
