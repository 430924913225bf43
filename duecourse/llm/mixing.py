"""Mixing sources to target weights by per-source repetition rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, free, n_words, small, staged

#: Weights by the sources' order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is repeated so often at most.
MOST = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target, rate) from sizes(source, size).

    Weights go to the sources in order of code point, null last. Targets share the total by weight; one above
    `most` times its source's size stops there and the excess is shared again by weight among the others. That is
    a water level: with sources in order of what they can take per unit of weight, each either is full or takes the
    level times its weight, and running sums over the table of sources give the level. That table has a row per source
    and a few numbers in each, and one task puts it in order; documents don't pass through it. A null size counts as
    nothing, null is a source of its own, and an empty table gives no rows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("room", F.col("source_size") * float(most)).withColumn("height", F.col("room") / F.col("weight"))
    filling = Window.orderBy("height", F.col("source").isNull(), F.col("source").cast("binary"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = per.withColumns({
        "total": F.sum("source_size").over(everything).cast("double"), "all_weight": F.sum("weight").over(everything),
        "used": F.coalesce(F.sum("room").over(before), F.lit(0.0)), "gone": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    per = per.withColumn("level", (F.col("total") - F.col("used")) / (F.col("all_weight") - F.col("gone")))
    # the first source that isn't full at its level sets the level of all after it
    level = F.min(F.when(F.col("height") >= F.col("level"), F.struct("height", "level"))).over(everything)["level"]
    per = per.withColumn("target", F.when(level.isNull(), F.col("room")).otherwise(F.least("room", level * F.col("weight"))))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return per.select("source", "source_size", "target", F.least(rate, F.lit(float(most))).alias("rate"))


def _copies(rate: Column, draw: Column) -> Column:
    """floor(rate), and one more where the draw lies below its fraction."""
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int")


def _draw(seed: int) -> Column:
    """A number from 0 to below 1 by a hash of seed, doc_id and text."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / float(1 << 32)


def copies(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies) for every row of docs(doc_id, text, source).

    A document is emitted floor(rate) times, plus once more with a probability that is the rate's fraction: when a hash
    of seed, doc_id and text, taken as a number from 0 to 1, lies below it. No row depends on another but through its
    source's rate, so nothing is shuffled but the sources' totals, and the same rows give the same copies.

    A null text has size 0; a null source is a source; null doc_ids are drawn as rows of their own, repeated rows alike;
    an empty table gives no rows; further columns are ignored, whatever their names.
    """
    sizes = staged(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string").alias("__source"), n_words(F.col("text")).alias("size"), _draw(seed).alias("__draw")), "sizes")
    table = staged(targets(sizes.select(F.col("__source").alias("source"), "size"), weights, most), "targets")
    rows = sizes.join(small(table), F.col("__source").eqNullSafe(F.col("source")))
    return rows.select("doc_id", "source", "size", "source_size", "target", "rate", _copies(F.col("rate"), F.col("__draw")).alias("copies"))


def mix(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of docs, each as often as copies() says, with all their columns, whatever their names; see there for nulls and repeated rows."""
    table = staged(targets(docs.select(F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size")), weights, most), "targets")
    own, of, rate, draw, copy = free(docs.columns, "mix_source", "mix_of", "mix_rate", "mix_draw", "mix_copy")
    rows = docs.withColumns({own: F.col("source").cast("string"), draw: _draw(seed)})
    rows = rows.join(small(table.select(F.col("source").alias(of), F.col("rate").alias(rate))), F.col(own).eqNullSafe(F.col(of)))
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(1), _copies(F.col(rate), F.col(draw))))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


_WEIGHT = " ".join(f"WHEN {k} THEN {w}.0" for k, w in enumerate(WEIGHTS))
#: The same in DuckDB.
ORACLE = f"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS draw FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {_WEIGHT} END::DOUBLE AS weight FROM sizes GROUP BY source),
rooms AS (SELECT *, source_size * {MOST}.0::DOUBLE AS room, source_size * {MOST}.0::DOUBLE / weight AS height FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(room) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level FROM rooms
  WINDOW before AS (ORDER BY height, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
found AS (SELECT arg_min(level, height) FILTER (height >= level) AS level FROM levels),
targets AS (SELECT source, source_size, CASE WHEN f.level IS NULL THEN room ELSE least(room, f.level * weight) END AS target FROM rooms, found f),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, {MOST}) ELSE 0 END AS rate FROM targets)
SELECT doc_id, size, source_size, target, size * n AS taken, CAST(n AS INTEGER) AS copies FROM (
  SELECT doc_id, size, source_size, target, CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS n FROM sizes s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source)
"""
