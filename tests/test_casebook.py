"""Derived cases and rules against sums and tests by hand, on the smallest tables."""

from datetime import date
from decimal import Decimal as D

import duckdb
from pyspark.sql import functions as F

from duecourse.functions import scalar as S
from duecourse.operators import recovery, rollups
from duecourse.plans import catalog
from duecourse.sources import casebook

SF = "/root/testdata/sf0.001"


def test_every_line_item_is_an_event(spark):
    events = casebook.recovery_events(spark, SF).collect()
    rows = duckdb.sql(f"select l_linestatus = 'O', l_returnflag = 'R', l_extendedprice::decimal(18,2) from '{SF}/lineitem.parquet'").fetchall()
    assert len(events) == len(rows)
    want = {basis: float(sum(-amount if back else amount for o, back, amount in rows if o == (basis == "settlement"))) for basis in ("settlement", "paid_invoice")}
    assert {r.basis: r.net for r in catalog.QUERIES["net_by_basis"](spark, SF).collect()} == want


def test_all_constants_are_looked_for_in_the_quote(spark):
    got = {(r.right_id, r.name): r.grounded for r in catalog.QUERIES["ground_constants"](spark, SF).collect()}
    want, fixed = {}, {"cap": 60000, "floor": 100, "t1": 10, "t2": 30, "r1": 1.5, "r2": 1.25, "r3": 1}
    for (k,) in duckdb.sql(f"select c_custkey from '{SF}/customer.parquet'").fetchall():
        quoted = {k % 50 * 1000, (k % 7 + 1) * 5, k % 20}
        want |= {(f"R-{k}", name): value in quoted for name, value in fixed.items()}
        want |= {(f"R-{k}", name): True for name in ("minimum", "rate", "above")}
    assert got == want and len({g for (_, name), g in got.items() if name in fixed}) == 2


def test_events_without_an_action_meet_none(spark):
    events = spark.createDataFrame([(1, 1, 7), (2, 1, 8), (3, 2, None)], "event_id long, case_id long, action_id long")
    linked = recovery.link_actions(events, spark.createDataFrame([(7, "credit_request"), (None, "lost")], "action_id long, action_type string"))
    assert {r.event_id: r.strategy for r in linked.collect()} == {1: "credit_request", 2: "unattributed", 3: "unattributed"} and linked.columns == ["action_id", "event_id", "case_id", "strategy"]
    plan = linked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter isnotnull(action_id") == 2  # on both sides, else all of them are dealt to one task


def test_lines_are_read_once_for_a_graph(spark):
    for name in ("graph_edges", "graph_nodes", "link_findings", "lineage_path", "withdraw_stale"):
        assert "lineitem" not in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().lower(), name


def test_a_matched_line_is_not_grouped_again(spark):
    plan = catalog.QUERIES["ledger_line_match"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [line_id" not in plan


def test_a_month_without_late_deductions_is_one_row(spark):
    rows = [(1, date(2025, 1, 1), 1, role, D(5), None, None, None) for role in ("base", "seat", "tax", "overage", "credit", "proration")]
    rows += [(1, date(2025, 1, 1), 1, "discount", D(-2), None, "Launch", e) for e in (date(2024, 1, 1), date(2026, 1, 1), date(2024, 1, 1))]
    lines = spark.createDataFrame(rows, "customer_id long, period date, invoice_id long, role string, amount decimal(18,2), quantity decimal(18,2), discount string, expires date")
    months = rollups.monthly(lines)
    assert sorted((r.discount or "", r.gone is not None, r.n) for r in months.collect()) == [("", False, 6), ("Launch", False, 1), ("Launch", True, 2)]
    (r,) = rollups.rolled(months).collect()
    assert (r.base, r.discounts, r.billed, r.n_lines, len(r.applied), r.prorated) == (10, 6, 24, 9, 2, True)
    assert [r.amount for r in rollups.deducted(months).collect()] == [6]


def test_roles_are_those_of_the_patterns(spark):
    texts = ["Sales TAX", "taxi", "VAT", "Prorated", "unused time", "partial", "a licence", "LICENSES", "Users", "write-off", "writeoff", "Service CREDIT", "credits", "Overage", None, "plan", "GOODWILL"]
    df = spark.createDataFrame([(t, a) for t in texts for a in (D(1), D(-1))], "t string, a decimal(18,2)")
    no, text = F.lit(False), F.coalesce("t", F.lit(""))
    plain = F.when(text.rlike(S.PRORATION), "proration").when(text.rlike(S.TAX), "tax").when((F.col("a") < 0) & text.rlike(S.CREDIT), "credit").when(F.col("a") < 0, "discount").when(F.lower(text).contains("overage"), "overage").when(text.rlike(S.SEAT), "seat").otherwise("base")
    assert df.where(~S.line_role(F.col("t"), F.col("a"), no, no, no).eqNullSafe(plain)).isEmpty()
