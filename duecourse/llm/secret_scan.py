"""Secret scans over versions of files by an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, remove, shared_folder, sliced, small, staged


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    #: A pattern for the database side; a text without it has no match.
    hint: str
    least: int = 0
    #: The group whose length counts.
    group: int = 0

    def spans(self, find: re.Pattern, text: str) -> list[tuple[int, int]]:
        """Leftmost non-overlapping matches, in code points, without those that are too short."""
        return [m.span() for m in find.finditer(text) if len(m[self.group]) >= self.least]


#: The first three are the base; `(?a)` keeps case-folding to ASCII.
RULES = (
    Rule("assign", 1, r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", 6, 2),
    Rule("access", 1, r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16}", 20),
    Rule("hex", 1, r"[0-9a-f]+", r"[0-9a-f]{24}", 24),
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]+\.", 30),
    Rule("prefixed", 1, r"(?:gh[pousr]|glpat|xox[abprs]|sk_live)[_-][A-Za-z0-9_-]+", r"(?:gh[pousr]|glpat|xox[abprs]|sk_live)[_-][A-Za-z0-9]", 20),
)
BASE = ("assign", "access", "hex")
SPANS = "array<struct<rule:string,kind:string,start:int,end:int>>"
LEDGER = f"blob string, rules array<string>, found {SPANS}"


def rule_id(rule: Rule) -> str:
    return f"{rule.kind}@{rule.version}"


def _array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _scanner(rules: tuple[Rule, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finds = {rule_id(r): (r, re.compile(r.pattern)) for r in rules}
        kind = pa.list_(pa.struct([("rule", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for part in sliced(batch, 1):
                found = [[{"rule": x, "kind": finds[x][0].kind, "start": a, "end": b} for x in todo for a, b in finds[x][0].spans(finds[x][1], text)] for text, todo in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.record_batch([part.column(0), pa.array(found, kind)], ["blob", "found"])

    return run


def blob_ids(versions: DataFrame) -> DataFrame:
    return versions.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("blob", F.sha2("text", 256))


def scan_new(versions: DataFrame, blobs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows (blob, rules, found) for what the ledger lacks: each distinct blob with the rule versions not yet tried on it.

    versions(text), and blobs(blob) with the ids of its texts, repeated or not. Most blobs lack the same rules (all of
    them in a first run, new ones after a change of rules, none in a run over a few new versions); only those that lack
    others are joined with the texts, so that texts are shuffled only where both kinds are many. Of the texts only those
    with the hint of a rule they lack reach the scanner; the others are entered with nothing found.
    """
    every = [rule_id(r) for r in rules]
    tried = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("tried"))
    todo = F.array_except(_array(every), F.coalesce("tried", _array([])))
    pairs = staged(blobs.select("blob").distinct().join(tried, "blob", "left").select("blob", todo.alias("todo")), "pairs")
    usual = pairs.groupBy("todo").count().orderBy(F.desc("count"), "todo").select("todo").first()
    usual = usual["todo"] if usual else []
    others = staged(pairs.where(F.col("todo") != _array(usual)), "others")
    rows = blob_ids(versions.select("text")).join(small(others), "blob", "left" if usual else "inner").withColumn("todo", F.coalesce("todo", _array(usual)))
    hinted = F.array_compact(F.array(*[F.when(F.array_contains("todo", rule_id(r)) & F.col("text").rlike(r.hint), F.lit(rule_id(r))) for r in rules]))
    hits = rows.withColumn("hinted", hinted).where(F.size("hinted") > 0).dropDuplicates(["blob"])
    found = hits.select("blob", "text", "hinted").mapInArrow(_scanner(rules), f"blob string, found {SPANS}")
    return pairs.where(F.size("todo") > 0).join(found, "blob", "left").select("blob", F.col("todo").alias("rules"), F.coalesce("found", F.array().cast(SPANS)).alias("found"))


def secrets_by_path(rows: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Joins the ledger's findings of the given rule versions back to every row of rows(blob, ...), in order of start and rule."""
    ranks = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (rule_id(r), k)])
    current = ledger.select("blob", F.filter("found", lambda x: x["rule"].isin([rule_id(r) for r in rules])).alias("found")).where(F.size("found") > 0)
    ordered = F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_list("found"))), lambda x: F.struct(x["start"].alias("start"), ranks[x["rule"]].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"), x["rule"].alias("rule"))))
    some = staged(current.groupBy("blob").agg(ordered.alias("found")), "findings")
    return rows.join(small(some), "blob", "left").withColumn("found", F.coalesce("found", F.array().cast(some.schema["found"].dataType)))


def scan_secrets(versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Finds secrets in every whole text of versions(text, ... such as path, commit or doc_id).

    What the ledger at ledger_path (a folder in shared storage) lacks is scanned and appended to it, and the findings of
    the given rule versions come from the whole ledger, so a rule's older versions no longer count. Copies are scanned
    once. Two runs at a time may scan and enter the same pair, which changes no result. A null text counts as empty and
    has nothing; repeated rows each get their findings; an empty table gives no rows; other columns pass through (of
    `blob` and `found` the new ones count).
    """
    spark = versions.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger_path)
    rows = staged(blob_ids(versions.drop("blob", "found")).drop("text"), "blobs")
    scan_new(versions, rows, spark.read.schema(LEDGER).parquet(ledger_path), rules).write.mode("append").parquet(ledger_path)
    return secrets_by_path(rows, spark.read.schema(LEDGER).parquet(ledger_path), rules)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds on a new ledger: the base rules, then with the method's further ones, which scans for these alone."""
    docs, ledger = documents(spark, sf_dir).select("doc_id", "text"), f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    scan_secrets(docs, ledger, tuple(r for r in RULES if r.kind in BASE))
    rows = scan_secrets(docs, ledger)
    remove(spark, ledger)  # the findings are staged
    of = lambda kinds: F.filter("found", lambda x: x["kind"].isin(*kinds))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    counts = [F.size(of([k])).cast("long").alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(joined(of(BASE)), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
