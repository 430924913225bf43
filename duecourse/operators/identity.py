"""Free-text labels to customers, through keys in order of authority."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import name_key, verbatim_key


def _keys(columns: list[F.Column]) -> F.Column:
    """(level, key) of the given columns: each as it stands, normalized, and without corporate suffixes."""
    keys = [f(c) for f in (verbatim_key, lambda c: name_key(c, suffixes=True), lambda c: name_key(c, suffixes=False)) for c in columns]
    return F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("level"), k.alias("key")) for i, k in enumerate(keys)]), lambda x: x["key"] != ""))


def resolve_customers(labels: DataFrame, contracts: DataFrame) -> DataFrame:
    """labels(label) to label, customer_id, level, reason.

    Six indexes in order of authority: the id and the name as they stand, normalized, and without suffixes. A level
    counts only where its key belongs to one customer. reason says why a label has none: 'ambiguous' at the first level
    that several customers share, else 'unknown'.
    """
    index = contracts.select("customer_id", _keys([F.col("customer_id").cast("string"), F.col("customer_name")]).alias("x")).select("customer_id", "x.*")
    per = index.groupBy("level", "key").agg(F.min("customer_id").alias("customer_id"), F.count_distinct("customer_id").alias("n"))
    asked = labels.select("label").distinct()
    hits = asked.select("label", _keys([F.col("label"), F.col("label")]).alias("x")).select("label", "x.*").join(per, ["level", "key"])
    one = F.col("n") == 1
    best = hits.groupBy("label").agg(F.min_by(F.when(one, F.col("customer_id")), F.when(one, F.col("level"))).alias("customer_id"), F.min(F.when(one, F.col("level"))).alias("level"), F.max((~one).cast("int")).alias("shared"))
    reason = F.when(F.col("customer_id").isNotNull(), F.lit(None)).when(F.col("shared") == 1, "ambiguous").otherwise("unknown")
    return asked.join(best, "label", "left").select("label", "customer_id", "level", reason.alias("reason"))


def apply_holds(keys: DataFrame, holds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """keys(customer_id, ...) that may be evaluated, and those that a hold blocks.

    holds(scope, customers): a scope of 'account' holds every customer, any other those listed.
    """
    every = holds.agg(F.max((F.col("scope") == "account").cast("int")) == 1).scalar()
    some = holds.where("scope <> 'account'").select(F.explode("customers").alias("customer_id")).distinct().withColumn("held", F.lit(True))
    rows = keys.join(some, "customer_id", "left").withColumn("blocked", F.coalesce("held", F.lit(False)) | F.coalesce(every, F.lit(False))).drop("held")
    return rows.where("not blocked").drop("blocked"), rows.where("blocked").drop("blocked")
