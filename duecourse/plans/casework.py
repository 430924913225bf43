"""Registered queries over derived rules and recovery cases, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import recovery
from ..operators import rightspec as R
from ..operators import rulejson as J
from ..sources import book, casebook
from .registry import _BOOK, _doubles, _select, _tables


def _rules(spark: SparkSession, d: str) -> DataFrame:
    return casebook.rules(book.contracts(spark, d))


def _faulty(rules: DataFrame) -> DataFrame:
    """Rules of which some fail in one way each."""
    k = F.col("customer_id") % 23
    calc = F.col("calc").withField("type", F.when(k == 1, "cube").when(k == 4, "min_of").otherwise(F.col("calc.type"))).withField("operands", F.when(k == 4, F.slice("calc.operands", 1, 1)).otherwise(F.col("calc.operands")))
    nodes = F.when(k == 3, F.transform("nodes", lambda n: n.withField("op", F.lit("near")))).when(k == 5, F.flatten(F.array_repeat("nodes", R.MAX_NODES + 1))).otherwise(F.col("nodes"))
    return rules.withColumns({"calc": calc, "nodes": nodes, "constants": F.when(k == 2, F.map_filter("constants", lambda name, _: name != "r1")).otherwise(F.col("constants"))})


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated_on(*_tables(spark, d))


def _evaluated_on(contracts: DataFrame, usage: DataFrame, invoices: DataFrame) -> DataFrame:
    return R.evaluate_rules(casebook.rules(contracts), casebook.observations(usage, invoices))


def _from_json(spark: SparkSession, d: str) -> DataFrame:
    contracts, usage, invoices = _tables(spark, d)
    return R.evaluate_rules(J.parse_rules(casebook.rule_texts(contracts)), casebook.observations(usage, invoices))


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    return recovery.case_ledger(casebook.cases(spark, d), casebook.actions(spark, d), casebook.recovery_events(spark, d))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Rules with recorded checks, a check that failed for some customers."""
    k = F.col("customer_id")
    return book.contracts(spark, d).select(F.concat(F.lit("R-"), k.cast("string")).alias("right_id"), (k % 17 != 0).alias("is_right"), (k % 19 != 0).alias("quote_supported"), (k % 3 != 0).alias("amount_supported"), F.when(k % 7 != 0, k % 4 != 0).alias("scope_supported"), "confidence")


QUERIES = {
    "evaluate_rules": lambda s, d: _doubles(_evaluated(s, d)),
    "rule_findings": lambda s, d: _doubles(R.rule_findings(_evaluated(s, d))),
    "rule_tiers": lambda s, d: R.flatten_rules(_rules(s, d))["tiers"],
    "rule_nodes": lambda s, d: R.flatten_rules(_rules(s, d))["nodes"].select("right_id", "ordinal", "op", "parent"),
    "validate_rules": lambda s, d: R.validate_rules(_faulty(_rules(s, d))),
    "json_rules_evaluated": lambda s, d: _doubles(_from_json(s, d)),
    "json_rules_validated": lambda s, d: J.validate_texts(J.parse_rules(casebook.rule_texts(book.contracts(s, d), faulty=True))),
    "ground_constants": lambda s, d: R.ground_constants(_rules(s, d)),
    "gate_candidates": lambda s, d: R.gate_candidates(_candidates(s, d), ["amount_supported", "scope_supported"]),
    "case_ledger": lambda s, d: _doubles(_ledger(s, d)),
    "outcome_record": lambda s, d: _doubles(recovery.outcome_record(_ledger(s, d))),
    "recovery_metrics": lambda s, d: _doubles(recovery.recovery_metrics(_ledger(s, d))),
    "resolution_mix": lambda s, d: _doubles(recovery.resolution_mix(_ledger(s, d))),
    "net_by_basis": lambda s, d: _doubles(recovery.net_by_basis(casebook.recovery_events(s, d))),
    "success_fee_metrics": lambda s, d: _doubles(recovery.success_fee_metrics(_ledger(s, d))),
    "executive_summary": lambda s, d: _doubles(recovery.executive_summary(_ledger(s, d))),
    "command_stages": lambda s, d: _doubles(recovery.command_stages(_ledger(s, d))),
    "filter_facets": lambda s, d: recovery.filter_facets(_ledger(s, d)),
}

# ---- the same in DuckDB

_RULES = (
    _BOOK
    + """, seen AS (
  SELECT customer_id, period, base, overage, seat_units, units, customer_id AS k, CAST(customer_id % 50 * 1000 AS DECIMAL(18,4)) AS minimum, CAST((customer_id % 7 + 1) * 0.05::DECIMAL(3,2) AS DECIMAL(18,4)) AS rate,
    CAST(customer_id % 20 AS DECIMAL(18,4)) AS above, DATE '1996-01-01' + CAST(customer_id % 1500 AS INTEGER) AS since FROM usage FULL JOIN invoices USING (customer_id, period)),
tried AS (
  SELECT *, CASE WHEN k % 2 = 0 THEN (units > above OR seat_units IS NOT NULL) AND (CASE WHEN base IS NOT NULL THEN last_day(period) >= since END) ELSE units >= above END AS hit,
    CASE WHEN units IS NOT NULL THEN greatest(units - above, 0) END AS over FROM seen),
raw AS (
  SELECT *, CASE k % 9 WHEN 0 THEN minimum WHEN 1 THEN rate * base WHEN 2 THEN rate * over WHEN 3 THEN CASE WHEN base IS NOT NULL THEN greatest(minimum - base, 0) END
    WHEN 4 THEN least(over, 10) * 1.50 + greatest(least(over, 30) - 10, 0) * 1.25 + greatest(over - 30, 0) WHEN 5 THEN over * CASE WHEN over <= 10 THEN 1.50 WHEN over <= 30 THEN 1.25 ELSE 1 END
    WHEN 6 THEN base * CASE WHEN units <= 10 THEN 1.50 WHEN units <= 30 THEN 1.25 WHEN units IS NOT NULL THEN 1 END
    WHEN 7 THEN CASE WHEN base IS NOT NULL THEN least(minimum, base) END WHEN 8 THEN CASE WHEN base IS NOT NULL THEN greatest(minimum, base) END END AS r FROM tried),
raw2 AS (SELECT * REPLACE (CASE WHEN k % 9 = 4 AND over IS NULL THEN NULL ELSE r END AS r) FROM raw),
held AS (
  SELECT *, CASE WHEN r IS NOT NULL THEN round(CASE WHEN k % 5 = 0 THEN greatest(CASE WHEN k % 4 = 0 THEN least(r, 60000) ELSE r END, 100) WHEN k % 4 = 0 THEN least(r, 60000) ELSE r END, 2) END AS e FROM raw2),
judged AS (
  SELECT *, 'R-' || customer_id AS right_id, CASE WHEN units < 0 THEN 'negative quantity' WHEN k % 10 = 0 AND base IS NULL THEN 'missing required' WHEN hit IS NULL THEN 'trigger unknown' WHEN NOT hit THEN 'not triggered'
    WHEN e IS NULL THEN 'operands unresolved' WHEN overage IS NULL AND k % 3 <> 0 THEN 'missing actual' END AS reason FROM held),
evaluated AS (
  SELECT right_id, customer_id, period, reason, CASE WHEN reason IS NULL THEN 'evaluated' WHEN reason = 'not triggered' THEN 'not_triggered' WHEN reason = 'operands unresolved' THEN 'error' ELSE 'not_evaluable' END AS status,
    CASE WHEN reason IS NULL THEN e END AS expected, CASE WHEN reason IS NULL THEN coalesce(overage, 0) END AS actual, CASE WHEN reason IS NULL THEN greatest(e - coalesce(overage, 0), 0) END AS recoverable FROM judged)
"""
)
_CASES = """WITH cases AS (
  SELECT o_orderkey AS case_id, o_custkey AS customer_id, o_orderpriority AS kind, CAST(o_totalprice AS DECIMAL(18,2)) AS potential, CAST(o_orderdate AS DATE) AS created,
    CASE WHEN o_orderstatus = 'F' THEN 'recovered' WHEN o_orderstatus = 'P' THEN 'disputed' WHEN o_orderkey % 4 = 0 THEN 'invoiced' WHEN o_orderkey % 4 = 1 THEN 'written_off' WHEN o_orderkey % 4 = 2 THEN 'rejected' ELSE 'open' END AS status FROM orders),
lines AS (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_shipdate AS DATE) AS day, l_returnflag = 'R' AS back FROM lineitem),
acts AS (
  SELECT l_orderkey AS case_id, arg_max(price, (day, price)) FILTER (l_linenumber % 4 <> 0) AS asked, min(day) AS first_action, bool_or(l_linenumber % 4 <> 0 AND l_linenumber % 7 = 0) AS disputed,
    array_to_string(list_sort(list(DISTINCT CASE WHEN l_linestatus = 'O' THEN 'credit_request' ELSE 'corrective_invoice' END)), ',') AS action_types, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS channels FROM lines GROUP BY ALL),
moves AS (SELECT l_orderkey AS case_id, back, CASE WHEN l_linestatus = 'O' THEN 'settlement' ELSE 'paid_invoice' END AS basis, price AS amount, day FROM lines),
came AS (SELECT case_id, sum(amount) FILTER (NOT back) AS realized, sum(amount) FILTER (back) AS reversed, min(day) FILTER (NOT back) AS first_realized, max(day) FILTER (NOT back) AS last_realized FROM moves GROUP BY case_id),
based AS (SELECT case_id, string_agg(basis || ':' || part, ',' ORDER BY basis) AS by_basis FROM (SELECT case_id, basis, CAST(sum(CASE WHEN back THEN -amount ELSE amount END) AS DECIMAL(18,2)) AS part FROM moves GROUP BY ALL) GROUP BY case_id),
nets AS (
  SELECT c.*, coalesce(asked, potential) AS requested, coalesce(realized, 0) AS realized, coalesce(reversed, 0) AS reversed, CAST(coalesce(realized, 0) - coalesce(reversed, 0) AS DECIMAL(18,2)) AS net, first_action, first_realized, last_realized, disputed,
    coalesce(action_types, '') AS action_types, coalesce(channels, '') AS channels, coalesce(by_basis, '') AS by_basis FROM cases c LEFT JOIN acts USING (case_id) LEFT JOIN came USING (case_id) LEFT JOIN based USING (case_id)),
ledger AS (
  SELECT *, CASE WHEN status IN ('recovered', 'rejected', 'written_off') THEN 0 ELSE greatest(requested - net, 0) END AS outstanding, CASE WHEN status = 'recovered' THEN greatest(requested - net, 0) ELSE 0 END AS shortfall,
    CAST(date_diff('day', created, first_realized) AS INTEGER) AS days, CASE WHEN status = 'disputed' OR disputed THEN 'disputed' ELSE 'none' END AS dispute, round(net * 0.20::DECIMAL(3,2), 2) AS fee,
    CASE WHEN status IN ('rejected', 'written_off') THEN status WHEN status = 'recovered' THEN CASE WHEN net >= requested - 0.005 THEN 'resolved_full' WHEN net > 0 THEN 'settled' ELSE 'resolved_unverified' END WHEN net > 0 THEN 'partially_realized' WHEN status = 'disputed' THEN 'disputed' ELSE 'open' END AS resolution FROM nets)
"""
_N = "CAST({0} AS DOUBLE) AS {1}"


def _cases(columns: str, money: str, rest: str, dates: str = "") -> str:
    parts = [columns] + [_N.format(c, c) for c in money.split()] + [f"CAST({c} AS VARCHAR) AS {c}" for c in dates.split()]
    return f"{_CASES} SELECT {', '.join(p for p in parts if p)} FROM {rest}"


def _total(value: str, name: str) -> str:
    return _N.format(f"coalesce({value}, 0)", name)


ORACLES = {
    "evaluate_rules": _select("right_id, customer_id, status, reason", "evaluated", "expected actual recoverable", "period").replace(_BOOK, _RULES),
    "rule_findings": _RULES + "SELECT 'F-' || substr(sha1(right_id || '|' || customer_id || '|' || strftime(period, '%Y-%m')), 1, 8) AS finding_id, right_id, customer_id, CAST(period AS VARCHAR) AS period, CAST(expected AS DOUBLE) AS expected, CAST(actual AS DOUBLE) AS actual, CAST(recoverable AS DOUBLE) AS recoverable FROM evaluated WHERE recoverable > 0",
    "json_rules_evaluated": _select("right_id, customer_id, status, reason", "evaluated", "expected actual recoverable", "period").replace(_BOOK, _RULES),
    "json_rules_validated": """SELECT c_custkey AS customer_id, CASE WHEN k <> 2 THEN 'R-' || c_custkey END AS right_id, CASE WHEN k IN (1, 5) THEN 'unsupported' WHEN k IN (2, 3) THEN 'rejected' WHEN k = 4 THEN 'needs_review' ELSE 'valid' END AS status,
      CASE k WHEN 1 THEN 'unknown key colour' WHEN 2 THEN 'not JSON' WHEN 3 THEN 'too many levels' WHEN 4 THEN 'no date above' WHEN 5 THEN 'unknown calculation' ELSE '' END AS reasons FROM (SELECT c_custkey, c_custkey % 23 AS k FROM customer)""",
    "rule_tiers": "SELECT 'R-' || c_custkey AS right_id, CAST(ordinal AS INTEGER) AS ordinal, up_to, rate FROM customer, (VALUES (0, 't1', 'r1'), (1, 't2', 'r2'), (2, NULL, 'r3')) t(ordinal, up_to, rate)",
    "rule_nodes": "SELECT 'R-' || c_custkey AS right_id, CAST(ordinal AS INTEGER) AS ordinal, op, CAST(parent AS INTEGER) AS parent FROM customer JOIN (VALUES (0, 0, 'gt', 1), (0, 1, 'event_exists', 1), (0, 2, 'or', 0), (0, 3, 'date_reached', 0), (0, 4, 'and', NULL), (1, 0, 'gte', NULL)) t(odd, ordinal, op, parent) ON c_custkey % 2 = odd",
    "validate_rules": """SELECT 'R-' || c_custkey AS right_id, CASE WHEN c_custkey % 23 IN (1, 3) THEN 'unsupported' WHEN c_custkey % 23 IN (2, 4) THEN 'needs_review' WHEN c_custkey % 23 = 5 THEN 'rejected' ELSE 'valid' END AS status,
      CASE c_custkey % 23 WHEN 1 THEN 'unknown calculation' WHEN 2 THEN 'undeclared constant' WHEN 3 THEN 'unknown operator' WHEN 4 THEN 'operands missing' WHEN 5 THEN 'too many nodes' ELSE '' END AS reasons FROM customer""",
    "ground_constants": """SELECT 'R-' || c_custkey AS right_id, name, CASE name WHEN 't1' THEN c_custkey % 7 = 1 OR c_custkey % 20 = 10 WHEN 't2' THEN c_custkey % 7 = 5 WHEN 'r3' THEN c_custkey % 20 = 1 ELSE name IN ('minimum', 'rate', 'above') END AS grounded
      FROM customer, (VALUES ('minimum'), ('rate'), ('above'), ('cap'), ('floor'), ('t1'), ('t2'), ('r1'), ('r2'), ('r3')) t(name)""",
    "gate_candidates": """SELECT 'R-' || c_custkey AS right_id, CASE WHEN c_custkey % 17 = 0 OR c_custkey % 19 = 0 THEN 'rejected' WHEN reasons <> '' THEN 'needs_review' ELSE 'accepted' END AS status, reasons FROM (
      SELECT c_custkey, concat_ws('; ', CASE WHEN c_custkey % 3 = 0 THEN 'amount_supported' END, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 4 = 0 THEN 'scope_supported' END, CASE WHEN c_custkey % 11 = 0 THEN 'low confidence' END) AS reasons FROM customer)""",
    "case_ledger": _cases("case_id, customer_id, kind, status, days, dispute, resolution, action_types, channels, by_basis", "potential requested realized reversed net outstanding shortfall fee", "ledger", "first_action first_realized last_realized"),
    "outcome_record": _cases("case_id, kind, resolution, days, action_types, channels", "requested net", "ledger"),
    "recovery_metrics": _cases(f"kind, customer_id, {_total('sum(potential)', 'opportunity')}, {_total('sum(net)', 'net')}, CAST(sum(days) AS BIGINT) AS days, count(days) AS timed, count(*) AS cases", "", "ledger GROUP BY GROUPING SETS ((kind), (customer_id), ())"),
    "resolution_mix": _cases(f"resolution, count(*) AS cases, {_total('sum(net)', 'net')}", "", "ledger GROUP BY resolution"),
    "net_by_basis": _cases(f"basis, {_total('sum(CASE WHEN back THEN -amount ELSE amount END)', 'net')}", "", "moves GROUP BY basis"),
    "success_fee_metrics": _cases(
        ", ".join([_total("sum(net)", "recovered"), _total("sum(potential) FILTER (status NOT IN ('rejected', 'written_off'))", "potential"), _total("sum(potential) FILTER (status IN ('invoiced', 'disputed'))", "awaiting"), _total("sum(potential) FILTER (status = 'written_off')", "written_off"), "count(*) FILTER (status = 'recovered') AS n_recovered, count(*) FILTER (status = 'written_off') AS n_written_off", _total("round(sum(net) * 0.20::DECIMAL(3,2), 2)", "fee")]),
        "", "ledger",
    ),
    "executive_summary": _cases(f"{_total('''sum(potential) FILTER (status <> 'rejected')''', 'opportunity')}, {_total('sum(net)', 'realized')}, count(*) FILTER (status NOT IN ('recovered', 'rejected', 'written_off')) AS open_cases, CAST(sum(days) AS BIGINT) AS days, count(days) AS timed, CAST(round(CAST(CAST(sum(net) AS DOUBLE) / CAST(sum(potential) FILTER (status <> 'rejected') AS DOUBLE) AS DECIMAL(24,10)), 4) AS DOUBLE) AS rate, CAST(round(CAST(CAST(sum(days) AS DOUBLE) / count(days) AS DECIMAL(24,10)), 2) AS DOUBLE) AS average_days, (SELECT string_agg(kind || ' ' || part, '; ' ORDER BY part DESC, kind) FROM (SELECT kind, CAST(sum(potential) AS DECIMAL(18,2)) AS part FROM ledger WHERE status <> 'rejected' GROUP BY kind ORDER BY part DESC, kind LIMIT 5)) AS top", "", "ledger"),
    "command_stages": _CASES + """SELECT stage, count(*) AS cases, CAST(sum(CASE WHEN stage = 'realized' THEN net WHEN stage IN ('in recovery', 'disputed') THEN greatest(potential - net, 0) ELSE potential END) AS DOUBLE) AS value FROM (
      SELECT *, CASE status WHEN 'open' THEN 'identified' WHEN 'approved' THEN 'approved' WHEN 'invoiced' THEN 'in recovery' WHEN 'disputed' THEN 'disputed' WHEN 'recovered' THEN 'realized' END AS stage FROM ledger) WHERE stage IS NOT NULL GROUP BY stage""",
    "filter_facets": f"{_CASES} SELECT facet, value, count(*) AS cases FROM (SELECT 'status' AS facet, status AS value FROM ledger UNION ALL SELECT 'kind', kind FROM ledger UNION ALL SELECT 'resolution', resolution FROM ledger UNION ALL SELECT 'customer', CAST(customer_id AS VARCHAR) FROM ledger UNION ALL SELECT 'month', strftime(first_action, '%Y-%m') FROM ledger) GROUP BY ALL",
}
