"""Totals, rankings and ledgers over findings and recovery events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import evidence_completeness, rank_score
from ..staging import with_place


def book_totals(findings: DataFrame) -> DataFrame:
    """By month and customer, by month, and in all: one rollup."""
    return findings.rollup("period", "customer_id").agg(F.sum("amount").cast("decimal(18,2)").alias("recoverable"), F.count("*").alias("findings")).withColumn("annualized", F.col("recoverable") * 12)


def audit_totals(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """By customer, and in all with a null customer: amount, kinds, findings, and a headline; customers with reviews(customer_id) alone are there with 0."""
    zero = F.lit(0).cast("decimal(18,2)")
    quiet = reviews.select("customer_id").distinct().join(findings.select("customer_id"), "customer_id", "left_anti")
    rows = findings.select("customer_id", "code", "amount").union(quiet.select("customer_id", F.lit(None).cast("string"), zero))
    per = rows.rollup("customer_id").agg(F.sum("amount").cast("decimal(18,2)").alias("amount"), F.count_distinct("code").alias("kinds"), F.count("code").alias("findings"), F.count_distinct("customer_id").alias("customers"))
    head = F.concat(F.col("amount").cast("string"), F.lit(" in "), F.col("findings").cast("string"), F.lit(" findings of "), F.col("customers").cast("string"), F.lit(" customers"))
    return per.select("customer_id", "amount", "kinds", "findings", F.when(F.col("findings") == 0, "reviews only").otherwise(head).alias("headline"))


def audit_report(findings: DataFrame) -> DataFrame:
    """By customer and kind: amount, months, first clause."""
    return findings.groupBy("customer_id", "code").agg(F.sum("amount").cast("decimal(18,2)").alias("amount"), F.count_distinct("period").alias("months"), F.min_by("clause", "period").alias("clause"))


# The statuses of findings that can be collected.
COLLECTIBLE = ["approved", "invoiced", "disputed"]


def trueup_pack(findings: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """A customer's findings of the statuses (COLLECTIBLE if none are given) in order of month and kind, as one text, with their months."""
    line = F.struct("period", "code", "amount")
    rows = findings.where(F.col("status").isin(COLLECTIBLE if statuses is None else statuses)).groupBy("customer_id").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.sum("amount").cast("decimal(18,2)").alias("total"))
    text = F.array_join(F.transform("lines", lambda x: F.concat_ws(" ", F.date_format(x["period"], "yyyy-MM"), x["code"], x["amount"].cast("string"))), "; ")
    months = F.array_join(F.array_distinct(F.transform("lines", lambda x: F.date_format(x["period"], "yyyy-MM"))), ",")
    return rows.select("customer_id", "total", F.size("lines").alias("n_lines"), months.alias("months"), text.alias("lines"))


def net_realized(events: DataFrame) -> DataFrame:
    """events(event_id, case_id, kind, amount): realizations less reversals per case, and the fee on them."""
    back = F.col("kind") == "reversal"
    net = F.sum(F.when(back, -F.col("amount")).otherwise(F.col("amount")))
    rows = events.groupBy("case_id").agg(net.cast("decimal(18,2)").alias("net"), F.sum(F.when(~back, F.col("amount"))).cast("decimal(18,2)").alias("realized"), F.count(F.when(back, 1)).alias("reversals"), F.min("ts").alias("first_ts"))
    return rows.withColumn("fee", F.round(F.col("net") * F.lit("0.20").cast("decimal(3,2)"), 2).cast("decimal(18,2)"))


def reversal_guard(events: DataFrame) -> DataFrame:
    """Reversals that take a case's running net below zero."""
    signed = F.when(F.col("kind") == "reversal", -F.col("amount")).otherwise(F.col("amount"))
    running = F.sum(signed).over(Window.partitionBy("case_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("running", running.cast("decimal(18,2)")).where("kind = 'reversal' and running < 0").select("event_id", "case_id", "running")


def ledger_integrity(events: DataFrame) -> DataFrame:
    """What is wrong with a ledger of events(event_id, case_id, kind, amount): ids that occur twice, and cases whose reversals exceed their realizations."""
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("amount"))), F.lit(0).cast("decimal(28,2)")).cast("decimal(18,2)")
    over = events.groupBy("case_id").agg((total("reversal") - total("realization")).cast("decimal(18,2)").alias("excess")).where("excess > 0")
    twice = events.groupBy("event_id").agg(F.count("*").alias("n")).where("n > 1")
    return over.select(F.lit("reversed too much").alias("violation"), F.col("case_id").cast("string").alias("id"), "excess").union(twice.select(F.lit("id occurs twice"), F.col("event_id").cast("string"), F.col("n").cast("decimal(18,2)")))


def command_center(findings: DataFrame) -> DataFrame:
    """One row: potential, verified and held values and counts, in one pass."""
    when = lambda test: F.coalesce(F.sum(F.when(test, F.col("amount"))), F.lit(0).cast("decimal(28,2)")).cast("decimal(18,2)")
    opened = F.col("status") == "open"
    return findings.agg(F.sum("amount").cast("decimal(18,2)").alias("potential"), when(opened).alias("verified"), when(~opened).alias("needs_review"), F.count("*").alias("findings"), F.count_distinct("customer_id").alias("customers"))


# What a status adds to a case's score.
STATUS_WEIGHT = {"open": 1.0, "approved": 0.9, "invoiced": 0.8, "disputed": 0.7, "recovered": 0.2, "rejected": 0.0, "written_off": 0.0}


def rank_cases(findings: DataFrame, now: str) -> DataFrame:
    """Each finding's evidence, score, place among its customer's and place in the whole book (`overall`), the best first.

    Evidence is the share of clause, formula, reference, provenance, kind and expected value that a finding has; columns
    that aren't there count as absent. Of equal scores the least id comes first.
    """
    field = lambda c: F.col(c) if c in findings.columns else F.lit(None)
    evidence = evidence_completeness(*[field(c) for c in ("clause", "formula", "clause_ref", "provenance", "code", "expected")])
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STATUS_WEIGHT.items() for x in kv]), F.col("status")), F.lit(0.5))
    age = F.greatest(F.datediff(F.lit(now).cast("date"), "period"), F.lit(0)).cast("double")
    scored = findings.withColumn("evidence", evidence).withColumn("score", rank_score(F.col("amount").cast("double"), F.col("confidence"), F.col("evidence"), age, weight))
    order = Window.partitionBy("customer_id").orderBy(F.desc("score"), "finding_id")
    rows = scored.withColumn("place", F.row_number().over(order)).select("finding_id", "customer_id", "evidence", "score", "place")
    return with_place(rows, F.desc("score"), F.col("finding_id"), name="overall")


def top_kinds(findings: DataFrame, n: int = 5) -> DataFrame:
    return findings.groupBy("code").agg(F.sum("amount").cast("decimal(18,2)").alias("amount")).orderBy(F.desc("amount"), "code").limit(n)


def group_math(findings: DataFrame) -> DataFrame:
    """How a customer's amounts of one kind add up: '500.00 × 3 months' where they are equal, else a sum in order of month."""
    rows = findings.groupBy("customer_id", "code").agg(F.array_sort(F.collect_list(F.struct("period", "amount"))).alias("m"), F.count_distinct("amount").alias("n"))
    text = F.transform("m", lambda x: x["amount"].cast("string"))
    return rows.select("customer_id", "code", F.when(F.col("n") == 1, F.concat(F.get(text, F.lit(0)), F.lit(" × "), F.size("m").cast("string"), F.lit(" months"))).otherwise(F.array_join(text, " + ")).alias("math"))


def finding_ordinal(findings: DataFrame) -> DataFrame:
    """Which finding of its kind in the customer's month each is, by id."""
    return findings.withColumn("nth", F.row_number().over(Window.partitionBy("customer_id", "period", "code").orderBy("finding_id")))


def latest_events(events: DataFrame, n: int = 50) -> DataFrame:
    """The newest n events by receipt; n is the report's length."""
    return events.orderBy(F.desc("received_at"), F.desc("event_id")).limit(n)


def pending_queue(findings: DataFrame) -> DataFrame:
    """Open findings with their place in their customer's queue, the largest amount first."""
    order = Window.partitionBy("customer_id").orderBy(F.desc("amount"), "finding_id")
    return findings.where("status = 'open'").withColumn("place", F.row_number().over(order))


# The changes of status that findings and actions may make.
FINDING_MOVES = {"open": ["approved", "rejected"], "approved": ["invoiced", "recovered", "written_off", "rejected"], "invoiced": ["recovered", "disputed", "written_off"], "disputed": ["recovered", "written_off"]}
ACTION_MOVES = {
    "draft": ["pending_approval", "rejected"], "pending_approval": ["approved", "rejected", "draft"], "approved": ["sent", "rejected"], "sent": ["awaiting_response", "resolved", "disputed"],
    "awaiting_response": ["resolved", "disputed", "written_off"], "disputed": ["resolved", "written_off", "awaiting_response"],
}


def illegal_moves(history: DataFrame, moves: dict[str, list[str]]) -> DataFrame:
    """history(id, seq, status) to the changes of status that the table of moves doesn't have: id, seq, was, status."""
    was = F.lag("status").over(Window.partitionBy("id").orderBy("seq"))
    may = F.create_map(*[x for k, v in moves.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = history.withColumn("was", was).where("was is not null and was <> status")
    return rows.where(~F.coalesce(F.array_contains(F.element_at(may, F.col("was")), F.col("status")), F.lit(False))).select("id", "seq", "was", "status")


def tampered_amounts(actions: DataFrame, cases: DataFrame) -> DataFrame:
    """Actions that ask for another amount than their case has."""
    rows = actions.join(cases.select("case_id", "potential"), "case_id")
    return rows.where("requested <> potential").select("case_id", "action_id", "requested", "potential")


def assurance_status(events: DataFrame, n: int = 10) -> DataFrame:
    """One row: events by outcome, the last trigger, and the value of the n latest, which is the report's window."""
    latest = latest_events(events, n).agg(F.struct(F.sum("value").alias("value"), F.max_by("trigger", F.struct("received_at", "event_id")).alias("trigger"))).scalar()
    counts = events.agg(F.count("*").alias("events"), F.count(F.when(F.col("trigger") == "error", 1)).alias("failed"), F.count_distinct("customer_id").alias("customers"))
    rows = counts.withColumn("latest", latest)
    return rows.select("events", "failed", "customers", F.col("latest.value").alias("recent_value"), F.col("latest.trigger").alias("last_trigger"))


def benchmark_summary(rows: DataFrame) -> DataFrame:
    """rows(category, doc_id, expected, found, violations: array) per category: documents, found, recall and each violation's number."""
    per = rows.groupBy("category").agg(F.count_distinct("doc_id").alias("documents"), F.sum(F.col("expected").cast("int")).alias("expected"), F.sum((F.col("expected") & F.col("found")).cast("int")).alias("found"))
    wrong = rows.select("category", F.explode("violations").alias("v")).groupBy("category", "v").agg(F.count("*").alias("n")).groupBy("category").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "v", "n"))), ",").alias("violations"))
    return per.join(wrong, "category", "left").withColumn("recall", F.round(F.col("found") / F.col("expected"), 4))
