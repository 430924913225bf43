"""Keyed stores as snapshots: upserts, merges and purges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_findings(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """store and fresh (finding_id, status, withdrawn_by, ...) as the next snapshot.

    Fresh values win, but status and created_at stay; a row that the system withdrew opens again; one that a human rejected doesn't.
    """
    new = fresh.select("finding_id", *[F.col(c).alias(f"n_{c}") for c in fresh.columns if c != "finding_id"], F.lit(True).alias("seen"))
    rows = store.join(new, "finding_id", "full_outer")
    reopened = F.col("seen") & (F.col("status") == "rejected") & (F.col("withdrawn_by") == "system")
    old = lambda c: F.coalesce(c, f"n_{c}")
    computed = [(old(c) if c == "created_at" else F.when(F.col("seen"), F.col(f"n_{c}")).otherwise(F.col(c))).alias(c) for c in store.columns if c not in ("finding_id", "status", "withdrawn_by")]
    status = F.when(reopened, "open").otherwise(F.coalesce("status", "n_status"))
    return rows.select("finding_id", status.alias("status"), F.when(~F.coalesce(reopened, F.lit(False)), F.col("withdrawn_by")).alias("withdrawn_by"), *computed)


def merge_upsert(store: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Later values that aren't null win, key by key; a contract that comes again without `confirmed` must be confirmed again."""
    new = incoming.select(*keys, *[F.col(c).alias(f"n_{c}") for c in incoming.columns if c not in keys], F.lit(True).alias("seen"))
    merged = lambda c: F.coalesce(f"n_{c}", c) if f"n_{c}" in new.columns else F.col(c)
    out = {c: merged(c) for c in store.columns if c not in keys}
    if "confirmed" in out:
        again = F.col("n_confirmed") if "n_confirmed" in new.columns else F.lit(None).cast("boolean")
        out["confirmed"] = F.when(F.col("seen"), F.coalesce(again, F.lit(False))).otherwise(F.col("confirmed"))
    return store.join(new, keys, "full_outer").select(*keys, *[x.alias(c) for c, x in out.items()])


def purge(tables: dict[str, DataFrame], column: str, value) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the rows of one account, and how many each loses."""
    gone = [t.where(F.col(column) == value).agg(F.count("*").alias("removed")).select(F.lit(n).alias("table"), "removed") for n, t in tables.items()]
    counts = gone[0]
    for g in gone[1:]:
        counts = counts.union(g)
    return {n: t.where(~F.col(column).eqNullSafe(value)) for n, t in tables.items()}, counts


def export_findings(findings: DataFrame) -> DataFrame:
    """A flat list of 13 columns, texts and numbers, for a CSV."""
    columns = ["finding_id", "customer_id", "customer_name", "code", "period", "currency", "amount", "clause_ref", "clause", "provenance", "confidence", "status", "created_at"]
    return findings.select(*[(F.col(c) if c in findings.columns else F.lit(None)).cast("string").alias(c) for c in columns])


def new_only(findings: DataFrame, store: DataFrame, key: str = "discrepancy_id") -> DataFrame:
    """Findings whose key the store doesn't have."""
    return findings.join(store.select(key), key, "left_anti")
