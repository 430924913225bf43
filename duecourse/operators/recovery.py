"""Ledgers of recovery cases: what was asked for, what came in, what went back, and how each case ended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import stable_id

MONEY = "decimal(18,2)"
# The success fee's share, and the tolerance of a full resolution.
FEE = "0.20"
TOLERANCE = "0.005"
CLOSED = ["recovered", "rejected", "written_off"]


def _sum(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0).cast("decimal(28,2)")).cast(MONEY)


def resolution(status: Column, net: Column, requested: Column) -> Column:
    met = F.when(net >= requested - F.lit(TOLERANCE).cast("decimal(4,3)"), "resolved_full").when(net > 0, "settled").otherwise("resolved_unverified")
    return F.when(status.isin("rejected", "written_off"), status).when(status == "recovered", met).when(net > 0, "partially_realized").when(status == "disputed", "disputed").otherwise("open")


def case_ledger(cases: DataFrame, actions: DataFrame, events: DataFrame) -> DataFrame:
    """A row per case. cases(case_id, customer_id, kind, potential, status, created), actions(case_id, action_type, channel,
    status, requested, created), events(case_id, kind, basis, amount, at). Actions and events are summed up before the joins.

    Requested is the last action's that isn't a draft (of one day the largest), else the potential.
    """
    sent = F.col("status") != "draft"
    acts = actions.groupBy("case_id").agg(
        F.max_by(F.when(sent, F.col("requested")), F.when(sent, F.struct("created", "requested"))).alias("asked"), F.min("created").alias("first_action"),
        F.max((F.col("status") == "disputed").cast("int")).alias("disputed"), F.array_join(F.array_sort(F.collect_set("action_type")), ",").alias("action_types"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"),
    )
    back = F.col("kind") == "reversal"
    of_basis = events.groupBy("case_id", "basis").agg(_sum(F.when(back, -F.col("amount")).otherwise(F.col("amount"))).alias("part"))  # a basis is one of a few
    by_basis = of_basis.groupBy("case_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "basis", F.col("part").cast("string")))), ",").alias("by_basis"))
    came = events.groupBy("case_id").agg(_sum(F.when(~back, F.col("amount"))).alias("realized"), _sum(F.when(back, F.col("amount"))).alias("reversed"), F.min(F.when(~back, F.col("at"))).alias("first_realized"), F.max(F.when(~back, F.col("at"))).alias("last_realized"))
    zero = F.lit(0).cast(MONEY)
    rows = cases.join(acts, "case_id", "left").join(came, "case_id", "left").join(by_basis, "case_id", "left")
    rows = rows.withColumns({"requested": F.coalesce("asked", "potential").cast(MONEY), "realized": F.coalesce("realized", zero), "reversed": F.coalesce("reversed", zero)})
    rows = rows.withColumn("net", (F.col("realized") - F.col("reversed")).cast(MONEY))
    gap = F.greatest(F.col("requested") - F.col("net"), F.lit(0)).cast(MONEY)
    return rows.select(
        "case_id", "customer_id", "kind", "status", "potential", "requested", "realized", "reversed", "net",
        F.when(F.col("status").isin(CLOSED), zero).otherwise(gap).alias("outstanding"), F.when(F.col("status") == "recovered", gap).otherwise(zero).alias("shortfall"),
        "first_action", "first_realized", "last_realized", F.datediff("first_realized", "created").alias("days"),
        F.when((F.col("status") == "disputed") | (F.col("disputed") == 1), "disputed").otherwise("none").alias("dispute"), resolution(F.col("status"), F.col("net"), F.col("requested")).alias("resolution"),
        F.coalesce("action_types", F.lit("")).alias("action_types"), F.coalesce("channels", F.lit("")).alias("channels"), F.coalesce("by_basis", F.lit("")).alias("by_basis"), F.round(F.col("net") * F.lit(FEE).cast("decimal(3,2)"), 2).cast(MONEY).alias("fee"),
    )


def outcome_record(ledger: DataFrame) -> DataFrame:
    return ledger.select("case_id", "kind", "resolution", "requested", "net", "days", "action_types", "channels")


def recovery_metrics(ledger: DataFrame) -> DataFrame:
    """By kind, by customer and in all, from one pass of grouping sets."""
    rows = ledger.groupingSets([["kind"], ["customer_id"], []], "kind", "customer_id").agg(_sum(F.col("potential")).alias("opportunity"), _sum(F.col("net")).alias("net"), F.sum("days").alias("days"), F.count("days").alias("timed"), F.count("*").alias("cases"))
    return rows


def resolution_mix(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("resolution").agg(F.count("*").alias("cases"), _sum(F.col("net")).alias("net"))


def net_by_basis(events: DataFrame) -> DataFrame:
    """Realizations less reversals per basis."""
    return events.groupBy("basis").agg(_sum(F.when(F.col("kind") == "reversal", -F.col("amount")).otherwise(F.col("amount"))).alias("net"))


def success_fee_metrics(ledger: DataFrame) -> DataFrame:
    """One row: recovered, the fee on it, what is potential, awaited and written off."""
    test = lambda *s: F.col("status").isin(*s)
    rows = ledger.agg(
        _sum(F.col("net")).alias("recovered"), _sum(F.when(~test("rejected", "written_off"), F.col("potential"))).alias("potential"), _sum(F.when(test("invoiced", "disputed"), F.col("potential"))).alias("awaiting"),
        _sum(F.when(test("written_off"), F.col("potential"))).alias("written_off"), F.count(F.when(test("recovered"), 1)).alias("n_recovered"), F.count(F.when(test("written_off"), 1)).alias("n_written_off"),
    )
    return rows.withColumn("fee", F.round(F.col("recovered") * F.lit(FEE).cast("decimal(3,2)"), 2).cast(MONEY))


def realized_by_month(events: DataFrame) -> DataFrame:
    """Realizations less reversals and the fee on them by the month they came in; the current month's row is what came this month."""
    signed = F.when(F.col("kind") == "reversal", -F.col("amount")).otherwise(F.col("amount"))
    rows = events.groupBy(F.date_format("at", "yyyy-MM").alias("month")).agg(_sum(signed).alias("net"), F.count_distinct("case_id").alias("cases"))
    return rows.withColumn("fee", F.round(F.col("net") * F.lit(FEE).cast("decimal(3,2)"), 2).cast(MONEY))


def executive_summary(ledger: DataFrame) -> DataFrame:
    """One row: opportunity, realized value and the rate, open cases, days to the first realization, and the five kinds of the largest opportunity."""
    live = F.col("status") != "rejected"
    per = ledger.where(live).groupBy("kind").agg(_sum(F.col("potential")).alias("part"))  # a row per kind
    top = per.agg(F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("part")).alias("less"), "kind"))), 1, 5), lambda x: F.concat_ws(" ", x["kind"], (-x["less"]).cast("string"))), "; ").alias("top"))
    rows = ledger.agg(_sum(F.when(live, F.col("potential"))).alias("opportunity"), _sum(F.col("net")).alias("realized"), F.count(F.when(~F.col("status").isin(CLOSED), 1)).alias("open_cases"), F.sum("days").alias("days"), F.count("days").alias("timed")).withColumn("top", top.scalar())
    rate = F.round((F.col("realized") / F.nullif(F.col("opportunity"), F.lit(0))).cast("decimal(24,10)"), 4).cast("double")
    return rows.withColumns({"rate": rate, "average_days": F.round((F.col("days") / F.nullif(F.col("timed"), F.lit(0))).cast("decimal(24,10)"), 2).cast("double")})


# A case's stages, and the statuses that put it there.
STAGES = {"identified": ["open"], "approved": ["approved"], "in recovery": ["invoiced"], "disputed": ["disputed"], "realized": ["recovered"]}


def command_stages(ledger: DataFrame) -> DataFrame:
    """Cases and their value by stage; what has come already of a case in recovery or dispute isn't in its value, a realized one has its net."""
    stage = F.element_at(F.create_map(*[F.lit(x) for k, v in STAGES.items() for s in v for x in (s, k)]), F.col("status"))
    partial = F.greatest(F.col("potential") - F.col("net"), F.lit(0)).cast(MONEY)
    value = F.when(F.col("stage") == "realized", F.col("net")).when(F.col("stage").isin("in recovery", "disputed"), partial).otherwise(F.col("potential"))
    return ledger.withColumn("stage", stage).where("stage is not null").groupBy("stage").agg(F.count("*").alias("cases"), _sum(value).alias("value"))


def filter_facets(ledger: DataFrame) -> DataFrame:
    """The values a list of cases can be filtered by, and how many cases have each: status, kind, resolution, customer and month of the first action."""
    values = {"status": F.col("status"), "kind": F.col("kind"), "resolution": F.col("resolution"), "customer": F.col("customer_id").cast("string"), "month": F.date_format("first_action", "yyyy-MM")}
    facet = F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), v.alias("value")) for k, v in values.items()]))
    return ledger.select(facet.alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("cases"))


def link_actions(events: DataFrame, actions: DataFrame) -> DataFrame:
    """events(event_id, case_id, action_id, ...) with the strategy of the action that brought each about, else 'unattributed'.

    Events without an action meet none, so they stay out of the join, which would deal them all to one task.
    """
    alone = F.lit("unattributed")
    named = events.where("action_id is not null").join(actions.select("action_id", "action_type"), "action_id", "left").withColumn("strategy", F.coalesce("action_type", alone)).drop("action_type")
    return named.unionByName(events.where("action_id is null").withColumn("strategy", alone))


def net_by_strategy(linked: DataFrame) -> DataFrame:
    """Realizations less reversals, and how many cases, per strategy."""
    signed = F.when(F.col("kind") == "reversal", -F.col("amount")).otherwise(F.col("amount"))
    return linked.groupBy("strategy").agg(_sum(signed).alias("net"), F.count_distinct("case_id").alias("cases"))


def recovery_rate(ledger: DataFrame) -> DataFrame:
    """One row: opportunity (rejected cases left out), realized, the rate, the average days and value of a case that brought something in."""
    live, came = F.col("status") != "rejected", F.col("net") > 0
    rows = ledger.agg(_sum(F.when(live, F.col("potential"))).alias("opportunity"), _sum(F.col("net")).alias("realized"), F.sum(F.when(came, F.col("days"))).alias("days"), F.count(F.when(came, F.col("days"))).alias("timed"), F.count(F.when(came, 1)).alias("cases"))
    ratio = lambda a, b, n: F.round(F.col(a).cast("double") / F.nullif(F.col(b), F.lit(0)).cast("double"), n)
    return rows.select("opportunity", "realized", ratio("realized", "opportunity", 4).alias("rate"), ratio("days", "timed", 1).alias("average_days"), ratio("realized", "cases", 2).alias("average_value"))


def sync_payments(cases: DataFrame, invoices: DataFrame) -> DataFrame:
    """Invoiced cases whose corrective invoice was paid, as realizations. cases(case_id, status, reference), invoices(reference, status, paid, at)."""
    paid = invoices.where("status = 'paid'").select("reference", "paid", "at")
    return cases.where("status = 'invoiced'").join(paid, "reference").select(stable_id("event", F.col("case_id"), F.col("reference")).alias("event_id"), "case_id", F.lit("realization").alias("kind"), F.col("paid").alias("amount"), "at")


# Fee statuses that are tried again, and how often.
RETRYABLE = ["payment_failed", "error", "pending", "unbilled"]
MOST_TRIES = 3


def fee_retries(events: DataFrame) -> DataFrame:
    """events(event_id, fee_status, tries) to what becomes of each: 'retry', 'collection_hold' after MOST_TRIES, or 'skipped'."""
    step = F.when(~F.coalesce(F.col("fee_status").isin(RETRYABLE), F.lit(False)), "skipped").when(F.coalesce("tries", F.lit(0)) >= MOST_TRIES, "collection_hold").otherwise("retry")
    return events.select("event_id", step.alias("step"))
