"""The registered queries over the derived book, and the same in DuckDB SQL."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import staging
from ..functions import scalar as S
from ..operators import documents as D
from ..operators import identity, reports, rollups, rules, terms
from ..sources import book
from ..streaming import assurance

FLAGSHIP = "run_book"


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    contracts = book.contracts(spark, d)
    return contracts, rollups.rollup_usage(book.usage_lines(spark, d)), rollups.rollup_invoices(rollups.classified(book.invoice_lines(spark, d), contracts))


def _schedule(spark: SparkSession, d: str) -> DataFrame:
    return book.terms(spark, d).where("term_type in ('1-URGENT', '2-HIGH')")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return terms.with_minimum(rollups.align_book(*_tables(spark, d)), _schedule(spark, d))


def _stored_facts(spark: SparkSession, d: str) -> DataFrame:
    """_facts() for those who read them more than once."""
    return staging.cut(_facts(spark, d))


def _audit_totals(spark: SparkSession, d: str) -> DataFrame:
    facts = _stored_facts(spark, d)
    return reports.audit_totals(staging.cut(rules.run_book(facts).select("customer_id", "code", "amount")), rules.reviews(facts))


def _findings(spark: SparkSession, d: str, explained: bool = True) -> DataFrame:
    return rules.run_book(_facts(spark, d), explained)


def _statused(spark: SparkSession, d: str) -> DataFrame:
    """Findings with the statuses that people gave them."""
    names = F.array(*map(F.lit, ["open", "approved", "invoiced", "disputed", "rejected"]))
    return _findings(spark, d).withColumn("status", F.element_at(names, ((F.col("customer_id") + F.month("period")) % 5 + 1).cast("int")))


def _doubles(df: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as text, which both engines print alike."""
    kinds = dict(df.dtypes)
    return df.select(*[F.col(c).cast("double").alias(c) if kinds[c].startswith("decimal") else F.col(c).cast("string").alias(c) if kinds[c] in ("date", "timestamp") else F.col(c) for c in df.columns])


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Recovery events: errors are reversals, three event types realize; a case is a user."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.col("user_id").alias("case_id"), F.when(F.col("event_type") == "error", "reversal").otherwise("realization").alias("kind"), F.col("value").cast("decimal(18,2)").alias("amount"), "ts")


def _replayed(spark: SparkSession, d: str) -> DataFrame:
    """Recovery events by session, those of every 97th id sent twice."""
    e = _events(spark, d)
    by_user = e.withColumn("case_id", F.col("event_id") % 1000 + F.col("case_id") * 1000)
    return by_user.union(by_user.where("event_id % 97 = 0"))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.col("event_type").alias("trigger"), F.col("user_id").alias("customer_id"), F.date_format("ts", "yyyy-MM").alias("period"), F.floor("value").cast("string").alias("payload"), F.col("value").cast("decimal(18,2)").alias("value"), F.col("ts").alias("received_at"))


def _payment_events(spark: SparkSession, d: str) -> DataFrame:
    """Changes as a payment processor's events, of kinds that count and of one that doesn't."""
    kinds = [*assurance.FEE_STATES, "customer.updated"]
    return _changes(spark, d).withColumn("trigger", F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % len(kinds) + 1).cast("int")))


def _scope_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes of contracts and of months of the book, by customers of which some aren't in it."""
    e, k = spark.read.parquet(f"{d}/events.parquet"), F.col("event_id")
    month = F.date_format(F.add_months(F.lit("1996-01-01").cast("date"), (k % 60).cast("int")), "yyyy-MM")
    return e.select((F.col("user_id") * 7 + k % 3).alias("customer_id"), F.when(k % 11 == 0, "pricing_change").when(k % 2 == 0, "new_usage").otherwise("new_invoice").alias("trigger"), month.alias("period")).where("customer_id % 5 <> 4")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """Customers' names as billing systems spell them."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    spelt = F.when(F.col("c_custkey") % 3 == 0, F.upper("c_name")).when(F.col("c_custkey") % 3 == 1, F.concat(F.translate("c_name", "#", " "), F.lit(" Inc."))).otherwise(F.concat(F.lit("X"), F.col("c_name")))
    return c.select(spelt.alias("label"))


def _orders_text(spark: SparkSession, d: str) -> DataFrame:
    """Dates and amounts as exports spell them."""
    o, k = spark.read.parquet(f"{d}/orders.parquet"), F.col("o_orderkey") % 3
    day = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    amount = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return o.select("o_orderkey", day.alias("day"), F.when(k == 0, F.concat(F.lit("$"), amount)).when(k == 1, F.concat(F.lit("("), amount, F.lit(")"))).otherwise("n/a").alias("amount"))


def _quote_table(spark: SparkSession, d: str) -> DataFrame:
    return D.grounded_quotes(spark.read.parquet(f"{d}/benchmark.parquet"), spark.read.parquet(f"{d}/documents.parquet"))


QUERIES = {
    "run_book": lambda s, d: _doubles(_findings(s, d).select("finding_id", "customer_id", "period", "code", "amount", "status")),
    "finding_formulas": lambda s, d: _doubles(_findings(s, d).groupBy("customer_id", "period", "code", "formula").agg(F.count("*").alias("findings"))),
    "discounts_applied": lambda s, d: _doubles(rollups.classified(book.invoice_lines(s, d), book.contracts(s, d)).where("role = 'discount'").groupBy("customer_id", "discount", "expires").agg(F.count("*").alias("lines"), (-F.sum("amount")).cast("decimal(18,2)").alias("amount"))),
    "reviews": lambda s, d: _doubles(rules.reviews(_facts(s, d))),
    "classify_line": lambda s, d: _doubles(rollups.classified(book.invoice_lines(s, d), book.contracts(s, d)).groupBy("role").agg(F.count("*").alias("lines"), F.sum("amount").cast("decimal(18,2)").alias("amount"))),
    "invoice_rollup": lambda s, d: _doubles(_tables(s, d)[2].drop("applied", "prorated")),
    "usage_rollup": lambda s, d: _doubles(_tables(s, d)[1]),
    "duplicate_rows": lambda s, d: _doubles(rollups.kept_once(book.invoice_lines(s, d), ["customer_id", "period", "description", "amount", "quantity"])),
    "book_align": lambda s, d: _doubles(_facts(s, d).select("customer_id", "period", "units", "base", "overage", "billed", "minimum")),
    "missing_side_review": lambda s, d: _doubles(rollups.missing_sides(*_tables(s, d))),
    "minimum_asof": lambda s, d: _doubles(terms.minimum_asof(_schedule(s, d), _tables(s, d)[2].select("customer_id", "period"))),
    "active_term_asof": lambda s, d: _doubles(terms.active_terms(book.terms(s, d), _tables(s, d)[2].select("customer_id", "period"), ["term_type"])),
    "active_terms_by_scope": lambda s, d: _doubles(terms.active_terms(book.terms(s, d), _tables(s, d)[2].select("customer_id", "period"), ["term_type", "scope"])),
    "scalar_term_resolution": lambda s, d: _doubles(terms.resolve_scalar_terms(book.terms(s, d))),
    "minimum_conflicts": lambda s, d: _doubles(terms.minimum_conflicts(book.terms(s, d))),
    "renewal_calendar": lambda s, d: _doubles(terms.renewal_calendar(book.contracts(s, d), "1999-06-01")),
    "escalator_steps": lambda s, d: book.contracts(s, d).select("customer_id", S.escalator_steps(F.col("escalator_date"), F.lit("1999-02-28").cast("date")).alias("steps")),
    "resolve_customer": lambda s, d: identity.resolve_customers(_labels(s, d), book.contracts(s, d)),
    "parse_export": lambda s, d: _doubles(_orders_text(s, d).select("o_orderkey", S.parse_period(F.col("day")).alias("period"), S.parse_amount(F.col("amount")).cast("decimal(18,2)").alias("amount"))),
    "periods_in_both": lambda s, d: _doubles(_tables(s, d)[1].select("period").intersect(_tables(s, d)[2].select("period"))),
    "complete_keys": lambda s, d: _doubles(_tables(s, d)[1].select("customer_id", "period").intersect(_tables(s, d)[2].select("customer_id", "period"))),
    "book_totals": lambda s, d: _doubles(reports.book_totals(_findings(s, d, explained=False))),
    "audit_report": lambda s, d: _doubles(reports.audit_report(_findings(s, d))),
    "trueup_pack": lambda s, d: _doubles(reports.trueup_pack(_findings(s, d), ["open"])),
    "trueup_collectible": lambda s, d: _doubles(reports.trueup_pack(_statused(s, d))),
    "audit_totals": lambda s, d: _doubles(_audit_totals(s, d)),
    "command_center_metrics": lambda s, d: _doubles(reports.command_center(_findings(s, d))),
    "top_sources": lambda s, d: _doubles(reports.top_kinds(_findings(s, d))),
    "rank_cases": lambda s, d: reports.rank_cases(_findings(s, d), "1999-01-01"),
    "net_realized": lambda s, d: _doubles(reports.net_realized(_events(s, d)).drop("first_ts")),
    "running_reversal_guard": lambda s, d: _doubles(reports.reversal_guard(_events(s, d))),
    "ledger_integrity": lambda s, d: _doubles(reports.ledger_integrity(_replayed(s, d))),
    "event_identity": lambda s, d: assurance.event_identity(_changes(s, d)).select("event_id", "event_key"),
    "dedupe_events": lambda s, d: assurance.dedupe_events(_changes(s, d)).select("event_key", "event_id"),
    "event_panel": lambda s, d: _doubles(assurance.event_panel(_changes(s, d)).withColumn("start", F.date_format("start", "yyyy-MM-dd"))),
    "fee_status_fold": lambda s, d: assurance.fee_status(_payment_events(s, d), assurance.FEE_STATES),
    "impacted_scope": lambda s, d: _doubles(assurance.impacted_scope(_scope_changes(s, d), _tables(s, d)[2])),
    "pseudo_pages": lambda s, d: D.pseudo_pages(s.read.parquet(f"{d}/documents.parquet")).select("doc_id", "page", F.sha2("text", 256).alias("page_sha256")),
    "critical_terms": lambda s, d: D.critical_terms(D.pseudo_pages(s.read.parquet(f"{d}/documents.parquet")), D.CRITICAL),
    "quote_in_document": _quote_table,
}

# ---- the same in DuckDB

_ROLE = r"""CASE WHEN regexp_matches(description, '\b(prorat\w*|partial period|unused time|remaining time)\b', 'i') THEN 'proration'
  WHEN regexp_matches(description, '\b(sales tax|vat|gst|hst|pst|qst|tax)\b', 'i') THEN 'tax'
  WHEN hit IS NOT NULL THEN 'discount'
  WHEN amount < 0 AND regexp_matches(description, '\b(credit note|credit memo|service credit|credit|refund|chargeback|goodwill|adjustment|write-?off)\b', 'i') THEN 'credit'
  WHEN amount < 0 THEN 'discount'
  WHEN contains(lower(description), 'metered') OR contains(lower(description), 'overage') THEN 'overage'
  WHEN regexp_matches(description, '\b(seat|user|license|licence)s?\b', 'i') THEN 'seat' ELSE 'base' END"""
_D = "DECIMAL(18,2)"
_POWERS = " ".join(f"WHEN {n} THEN {Decimal('1.04') ** n}::DECIMAL(16,14)" for n in range(1, 8))
_BOOK = f"""WITH contracts AS (
  SELECT c_custkey AS customer_id, c_name AS customer_name, CAST(c_custkey % 40 * 2 AS {_D}) AS included_units, CAST((c_custkey % 7 + 1) * 10 AS {_D}) AS overage_rate,
    CASE WHEN c_custkey % 5 = 0 THEN 0.04::DOUBLE END AS escalator_pct, DATE '1995-01-01' + CAST(c_custkey % 700 AS INTEGER) AS escalator_date,
    DATE '1994-06-01' + CAST(c_custkey % 900 AS INTEGER) AS effective_date, DATE '1998-01-01' + CAST(c_custkey % 1200 AS INTEGER) AS term_end, CASE WHEN c_custkey % 17 <> 0 THEN c_custkey % 3 = 0 END AS auto_renew,
    CASE WHEN c_custkey % 11 = 0 THEN 0.80::DOUBLE ELSE 0.95::DOUBLE END AS confidence, CASE WHEN c_custkey % 13 <> 0 THEN 'clause ' || c_custkey END AS clause,
    list_filter([{{'name': 'Launch promo', 'expires': DATE '1996-01-01' + CAST(c_custkey % 1500 AS INTEGER)}}, CASE WHEN c_custkey % 3 <> 1 THEN {{'name': 'Loyalty rebate', 'expires': DATE '1995-06-01' + CAST(c_custkey % 1300 AS INTEGER)}} END, CASE WHEN c_custkey % 4 = 0 THEN {{'name': 'Volume', 'expires': NULL::DATE}} END], lambda x: x IS NOT NULL) AS discount_list, CASE WHEN c_custkey % 6 = 0 THEN CAST(c_custkey % 9 + 40 AS {_D}) END AS committed_seats, 12.50::{_D} AS seat_price
  FROM customer),
terms AS (
  SELECT o_custkey AS customer_id, o_orderpriority AS term_type, o_orderstatus AS scope, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS effective,
    CAST(CAST(o_totalprice AS {_D}) * 0.1::DECIMAL(2,1) AS {_D}) AS value, o_orderkey AS seq FROM orders),
usage_lines AS (
  SELECT o_custkey AS customer_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS period, l_returnflag AS metric, CAST(l_quantity AS {_D}) AS units FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
items AS (
  SELECT o_custkey AS customer_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, o_orderkey AS invoice_id, l_linenumber AS nr, l_returnflag AS f, l_linestatus AS s, CAST(l_quantity AS {_D}) AS q,
    CAST(l_extendedprice AS {_D}) AS price, CAST(l_discount AS {_D}) AS cut, CAST(l_tax AS {_D}) AS tax FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
invoice_lines AS (
  SELECT * FROM (
    SELECT customer_id, period, invoice_id, CASE WHEN f = 'R' THEN 'Metered usage overage' WHEN f = 'N' AND s = 'O' THEN 'Workspace seats' ELSE 'Platform subscription' END AS description, price AS amount, q AS quantity FROM items
    UNION ALL SELECT customer_id, period, invoice_id, CASE WHEN cut >= 0.09 THEN 'Service credit' WHEN nr % 3 = 0 THEN 'Loyalty' WHEN nr % 3 = 1 THEN 'Launch promo applied' ELSE 'VOLUME price' END, CAST(-round(price * cut, 2) AS {_D}), NULL FROM items
    UNION ALL SELECT customer_id, period, invoice_id, 'Sales tax', CAST(round(price * tax, 2) AS {_D}), NULL FROM items) WHERE amount <> 0),
met_lines AS (
  SELECT l.*, discount_list, CASE WHEN amount < 0 THEN list_filter(discount_list, lambda x: contains(lower(description), lower(x.name)) OR contains(lower(x.name), lower(description)))[1] END AS hit FROM invoice_lines l LEFT JOIN contracts USING (customer_id)),
applying AS (SELECT *, CASE WHEN role = 'discount' THEN coalesce(hit, CASE WHEN len(discount_list) = 1 THEN discount_list[1] END) END AS taken FROM (SELECT *, {_ROLE} AS role FROM met_lines)),
classified AS (SELECT * EXCLUDE (discount_list, hit, taken), CASE WHEN role = 'discount' THEN coalesce(taken.name, description) END AS discount, taken.expires AS expires FROM applying),
invoices AS (
  SELECT customer_id, period, CAST(sum(amount) FILTER (role IN ('base', 'seat')) AS {_D}) AS base, CAST(coalesce(sum(amount) FILTER (role = 'overage'), 0) AS {_D}) AS overage,
    CAST(coalesce(sum(amount) FILTER (role = 'tax'), 0) AS {_D}) AS tax, CAST(sum(quantity) FILTER (role = 'seat') AS {_D}) AS seat_units,
    CAST(coalesce(-sum(amount) FILTER (role = 'discount'), 0) AS {_D}) AS discounts, CAST(coalesce(sum(amount) FILTER (role = 'credit'), 0) AS {_D}) AS credits,
    count(*) FILTER (role = 'credit') AS n_credits, CAST(sum(amount) AS {_D}) AS billed, count(*) AS n_lines, min(invoice_id) AS first_invoice FROM classified GROUP BY ALL),
meters AS (SELECT customer_id, period, metric, CAST(sum(units) AS {_D}) AS units FROM usage_lines GROUP BY ALL),
usage AS (
  SELECT customer_id, period, max(units) AS units, arg_min(metric, (-units, metric)) AS metric, count(*) AS n_metrics, count(*) > 1 AS incomplete FROM meters GROUP BY ALL),
panel AS (SELECT customer_id, period FROM invoices),
schedule AS (SELECT * FROM terms WHERE term_type IN ('1-URGENT', '2-HIGH')),
held_minimum AS (
  SELECT customer_id, period, minimum FROM (
    SELECT p.customer_id, p.period, s.value AS minimum, row_number() OVER (PARTITION BY p.customer_id, p.period ORDER BY s.effective <= p.period DESC, CASE WHEN s.effective <= p.period THEN s.effective END DESC, s.effective, s.seq) AS r
    FROM panel p JOIN schedule s USING (customer_id)) WHERE r = 1),
facts AS (
  SELECT *, last_day(period) AS period_end, CASE WHEN last_day(period) < effective_date THEN 'not yet effective' WHEN period > term_end AND NOT coalesce(auto_renew, false) THEN 'after the term' END AS gate
  FROM usage JOIN invoices USING (customer_id, period) JOIN contracts USING (customer_id) LEFT JOIN held_minimum USING (customer_id, period)),
steps AS (
  SELECT *, coalesce(base, 0) AS b, greatest(0, 1 + year(period_end) - year(escalator_date) - CAST(month(period_end) * 100 + day(period_end) < month(escalator_date) * 100 + day(escalator_date) AS INTEGER)) AS n,
    greatest(units - included_units, 0) * overage_rate - overage AS over, committed_seats - seat_units AS seats FROM facts WHERE gate IS NULL),
outcomes AS (
  SELECT *, CASE WHEN escalator_pct IS NOT NULL THEN CAST(round(CAST(minimum AS DECIMAL(22,2)) * CASE greatest(n, 1) {_POWERS} END, 2) AS {_D}) END - greatest(b, minimum) AS risen, b <= 0.005 AND billed - b > 0 AS lost FROM steps),
fired AS (
  SELECT customer_id, period, confidence, clause, 'MISSING_BASE' AS code, minimum AS amount, concat('no base charge in ', billed, ' billed; the minimum is ', minimum) AS formula, NULL::VARCHAR AS discount FROM outcomes WHERE lost AND minimum IS NOT NULL
  UNION ALL SELECT customer_id, period, confidence, clause, 'MINIMUM', minimum - b, concat('minimum ', minimum, ' - base ', CAST(b AS {_D}), ' = ', CAST(minimum - b AS {_D})), NULL FROM outcomes WHERE NOT lost AND minimum - b > 0
  UNION ALL SELECT customer_id, period, confidence, clause, 'OVERAGE', over, concat(CAST(greatest(units - included_units, 0) AS {_D}), ' units beyond ', included_units, ' at ', overage_rate, ' - ', overage, ' billed = ', CAST(round(over, 2) AS {_D})), NULL FROM outcomes WHERE over > 0.01
  UNION ALL SELECT customer_id, period, o.confidence, o.clause, 'EXPIRED_DISCOUNT', -c.amount, concat(discount, ' ended ', expires, ', ', CAST(-c.amount AS {_D}), ' taken off'), discount FROM outcomes o JOIN classified c USING (customer_id, period) WHERE c.role = 'discount' AND period > expires
  UNION ALL SELECT customer_id, period, confidence, clause, 'ESCALATOR', risen, concat('minimum ', minimum, ' raised ', n, ' times by ', CAST(escalator_pct * 100 AS DECIMAL(8,2)), '% - ', CAST(greatest(b, minimum) AS {_D}), ' = ', CAST(risen AS {_D})), NULL FROM outcomes WHERE n > 0 AND risen > 0.01
  UNION ALL SELECT customer_id, period, confidence, clause, 'SEATS', seats * seat_price, concat(CAST(seats AS {_D}), ' seats beyond ', seat_units, ' billed, at ', seat_price, ' = ', CAST(round(seats * seat_price, 2) AS {_D})), NULL FROM outcomes WHERE seats >= 1),
findings AS (
  SELECT 'F-' || customer_id || '-' || strftime(period, '%Y%m') || '-' || code || CASE WHEN nth > 1 THEN '-' || nth ELSE '' END AS finding_id, customer_id, period, code, CAST(round(amount, 2) AS {_D}) AS amount, formula, discount, clause, confidence,
    CASE WHEN clause IS NULL THEN 'no clause' WHEN confidence < 0.85 THEN 'low confidence' ELSE 'open' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, period, code ORDER BY amount) AS nth FROM fired)),
rec AS (SELECT event_id, user_id AS case_id, CASE WHEN event_type = 'error' THEN 'reversal' ELSE 'realization' END AS kind, CAST(value AS {_D}) AS amount, ts FROM events),
changes AS (SELECT event_id, event_type AS trigger, user_id AS customer_id, strftime(ts, '%Y-%m') AS period, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS payload, CAST(value AS {_D}) AS value, ts AS received_at FROM events),
keyed AS (SELECT *, substr(sha256(trigger || '|' || customer_id || '|' || period || '|' || payload), 1, 32) AS event_key FROM changes),
pages AS (SELECT doc_id, page, substr(text, CAST((page - 1) * 3000 + 1 AS BIGINT), 3000) AS text FROM (SELECT doc_id, coalesce(text, '') AS text, unnest(range(1, greatest(1, CAST(ceil(length(coalesce(text, '')) / 3000) AS BIGINT)) + 1)) AS page FROM documents)),
labels_of AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) WHEN c_custkey % 3 = 1 THEN replace(c_name, '#', ' ') || ' Inc.' ELSE 'X' || c_name END AS label FROM customer)
"""
_NUM = "CAST({0} AS DOUBLE) AS {0}"


def _select(columns: str, source: str, decimals: str = "", dates: str = "") -> str:
    parts = [c.strip() for c in columns.split(",") if c.strip()] + [_NUM.format(c) for c in decimals.split()] + [f"CAST({c} AS VARCHAR) AS {c}" for c in dates.split()]
    return f"{_BOOK} SELECT {', '.join(parts)} FROM {source}"


_ACTIVE = "(SELECT p.customer_id, p.period, t.term_type, t.scope, t.value, row_number() OVER (PARTITION BY p.customer_id, p.period, t.term_type{0} ORDER BY t.effective DESC, t.seq) AS r FROM panel p JOIN terms t USING (customer_id) WHERE t.effective <= p.period) WHERE r = 1"

ORACLES = {
    "run_book": _select("finding_id, customer_id, code, status", "findings", "amount", "period"),
    "finding_formulas": _BOOK + "SELECT customer_id, CAST(period AS VARCHAR) AS period, code, formula, count(*) AS findings FROM findings GROUP BY ALL",
    "discounts_applied": _BOOK + "SELECT customer_id, discount, CAST(expires AS VARCHAR) AS expires, count(*) AS lines, CAST(-sum(amount) AS DOUBLE) AS amount FROM classified WHERE role = 'discount' GROUP BY ALL",
    "reviews": _select("customer_id, reason", "(SELECT DISTINCT customer_id, period, unnest([gate, CASE WHEN n_credits > 0 THEN 'credits' END, CASE WHEN incomplete THEN 'several meters' END, CASE WHEN base IS NULL THEN 'no base charge' END, CASE WHEN committed_seats IS NOT NULL AND seat_units IS NULL THEN 'no seat line' END]) AS reason FROM facts) WHERE reason IS NOT NULL", "", "period"),
    "classify_line": _BOOK + "SELECT role, count(*) AS lines, CAST(CAST(sum(amount) AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM classified GROUP BY role",
    "invoice_rollup": _select("customer_id, n_credits, n_lines, first_invoice", "invoices", "base overage tax seat_units discounts credits billed", "period"),
    "usage_rollup": _select("customer_id, metric, n_metrics, incomplete", "usage", "units", "period"),
    "duplicate_rows": _select("customer_id, description, times", "(SELECT customer_id, period, description, amount, quantity, count(*) AS times FROM invoice_lines GROUP BY ALL)", "amount quantity", "period"),
    "book_align": _select("customer_id", "facts", "units base overage billed minimum", "period"),
    "missing_side_review": _select("customer_id, reason", """(SELECT c.customer_id, m.period, CASE WHEN k.customer_id IS NULL THEN 'no data' WHEN u.customer_id IS NULL AND i.customer_id IS NULL THEN 'no usage and no invoice' WHEN u.customer_id IS NULL THEN 'no usage' WHEN i.customer_id IS NULL THEN 'no invoice' END AS reason
      FROM contracts c CROSS JOIN (SELECT period FROM usage INTERSECT SELECT period FROM invoices) m LEFT JOIN usage u ON u.customer_id = c.customer_id AND u.period = m.period LEFT JOIN invoices i ON i.customer_id = c.customer_id AND i.period = m.period
      LEFT JOIN (SELECT customer_id FROM usage UNION SELECT customer_id FROM invoices) k ON k.customer_id = c.customer_id) WHERE reason IS NOT NULL""", "", "period"),
    "minimum_asof": _select("customer_id", "held_minimum", "minimum", "period"),
    "active_term_asof": _select("customer_id, term_type", _ACTIVE.format(""), "value", "period"),
    "active_terms_by_scope": _select("customer_id, term_type, scope", _ACTIVE.format(", t.scope"), "value", "period"),
    "scalar_term_resolution": _select("customer_id, term_type, status", """(SELECT customer_id, term_type, status, CASE WHEN status <> 'conflict' THEN latest END AS value FROM (
      SELECT customer_id, term_type, CASE WHEN min(low) = max(high) THEN 'single' WHEN max(n) > 1 THEN 'conflict' ELSE 'latest' END AS status, arg_max(low, effective) AS latest FROM (
      SELECT customer_id, term_type, effective, count(DISTINCT value) AS n, min(value) AS low, max(value) AS high FROM terms GROUP BY ALL) GROUP BY ALL))""", "value"),
    "minimum_conflicts": _select("customer_id, term_type, scope, n", "(SELECT customer_id, term_type, scope, effective, count(DISTINCT value) AS n, min(value) AS low, max(value) AS high FROM terms GROUP BY ALL HAVING count(DISTINCT value) > 1)", "low high", "effective"),
    "renewal_calendar": _select("customer_id, state", """(SELECT customer_id, term_end, term_end - 60 AS notice_deadline, CASE WHEN term_end IS NULL THEN 'unknown' WHEN term_end < DATE '1999-06-01' THEN 'expired' WHEN term_end - 60 <= DATE '1999-06-01' THEN 'notice_window_open' WHEN date_diff('day', DATE '1999-06-01', term_end - 60) <= 90 THEN 'upcoming_90d' ELSE 'later' END AS state FROM contracts)""", "", "term_end notice_deadline"),
    "escalator_steps": _BOOK + "SELECT customer_id, CAST(greatest(0, 1 + 1999 - year(escalator_date) - CAST(228 < month(escalator_date) * 100 + day(escalator_date) AS INTEGER)) AS INTEGER) AS steps FROM contracts",
    "resolve_customer": _BOOK + r""", parts AS (SELECT label, lower(trim(label)) AS v, list_filter(string_split(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS t FROM (SELECT label FROM labels_of UNION SELECT customer_name FROM contracts)),
      keys AS (SELECT label, 0 AS level, v AS key FROM parts UNION ALL SELECT label, 1, array_to_string(t, '_') FROM parts UNION ALL SELECT label, 2, array_to_string(list_filter(t, lambda x: x NOT IN ('llc','inc','co','corp','corporation','company','group','grp','ltd','limited','plc','gmbh','the','and')), '_') FROM parts),
      per AS (SELECT level, key, min(customer_id) AS customer_id, count(DISTINCT customer_id) AS n FROM (
        SELECT level * 2 + 1 AS level, key, customer_id FROM keys JOIN contracts ON label = customer_name UNION ALL SELECT x.level, CAST(customer_id AS VARCHAR), customer_id FROM contracts, (VALUES (0), (2), (4)) x(level)) WHERE key <> '' GROUP BY ALL),
      hits AS (SELECT k.label, p.* FROM (SELECT label, level * 2 AS level, key FROM keys UNION ALL SELECT label, level * 2 + 1, key FROM keys) k JOIN per p USING (level, key)),
      best AS (SELECT label, arg_min(customer_id, level) FILTER (n = 1) AS customer_id, min(level) FILTER (n = 1) AS level, max(n) AS n FROM hits GROUP BY label)
      SELECT DISTINCT l.label, b.customer_id, b.level, CASE WHEN b.customer_id IS NOT NULL THEN NULL WHEN b.n > 1 THEN 'ambiguous' ELSE 'unknown' END AS reason FROM labels_of l LEFT JOIN best b USING (label)""",
    "parse_export": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS period, CAST(CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) WHEN o_orderkey % 3 = 1 THEN -CAST(o_totalprice AS DECIMAL(18,2)) END AS DOUBLE) AS amount FROM orders",
    "periods_in_both": _BOOK + "SELECT CAST(period AS VARCHAR) AS period FROM (SELECT period FROM usage INTERSECT SELECT period FROM invoices)",
    "complete_keys": _BOOK + "SELECT customer_id, CAST(period AS VARCHAR) AS period FROM (SELECT customer_id, period FROM usage INTERSECT SELECT customer_id, period FROM invoices)",
    "book_totals": _BOOK + "SELECT CAST(period AS VARCHAR) AS period, customer_id, CAST(sum(amount) AS DOUBLE) AS recoverable, count(*) AS findings, CAST(sum(amount) * 12 AS DOUBLE) AS annualized FROM findings GROUP BY ROLLUP (period, customer_id)",
    "audit_report": _BOOK + "SELECT customer_id, code, CAST(sum(amount) AS DOUBLE) AS amount, count(DISTINCT period) AS months, arg_min(clause, period) AS clause FROM findings GROUP BY ALL",
    "trueup_pack": _BOOK + "SELECT customer_id, CAST(sum(amount) AS DOUBLE) AS total, CAST(count(*) AS INTEGER) AS n_lines, array_to_string(list_sort(list(DISTINCT strftime(period, '%Y-%m'))), ',') AS months, string_agg(strftime(period, '%Y-%m') || ' ' || code || ' ' || amount, '; ' ORDER BY period, code, amount) AS lines FROM findings WHERE status = 'open' GROUP BY customer_id",
    "trueup_collectible": _BOOK + "SELECT customer_id, CAST(sum(amount) AS DOUBLE) AS total, CAST(count(*) AS INTEGER) AS n_lines, array_to_string(list_sort(list(DISTINCT strftime(period, '%Y-%m'))), ',') AS months, string_agg(strftime(period, '%Y-%m') || ' ' || code || ' ' || amount, '; ' ORDER BY period, code, amount) AS lines FROM findings WHERE (customer_id + month(period)) % 5 IN (1, 2, 3) GROUP BY customer_id",
    "audit_totals": _BOOK
    + """, reviewed AS (SELECT DISTINCT customer_id FROM facts WHERE gate IS NOT NULL OR n_credits > 0 OR incomplete OR base IS NULL OR (committed_seats IS NOT NULL AND seat_units IS NULL)),
      every AS (SELECT customer_id, code, amount FROM findings UNION ALL SELECT customer_id, NULL, 0 FROM reviewed WHERE customer_id NOT IN (SELECT customer_id FROM findings))
      SELECT customer_id, CAST(sum(amount) AS DOUBLE) AS amount, count(DISTINCT code) AS kinds, count(code) AS findings, CASE WHEN count(code) = 0 THEN 'reviews only' ELSE CAST(sum(amount) AS DECIMAL(18,2)) || ' in ' || count(code) || ' findings of ' || count(DISTINCT customer_id) || ' customers' END AS headline FROM every GROUP BY ROLLUP (customer_id)""",
    "command_center_metrics": _BOOK + "SELECT CAST(sum(amount) AS DOUBLE) AS potential, CAST(coalesce(sum(amount) FILTER (status = 'open'), 0) AS DOUBLE) AS verified, CAST(coalesce(sum(amount) FILTER (status <> 'open'), 0) AS DOUBLE) AS needs_review, count(*) AS findings, count(DISTINCT customer_id) AS customers FROM findings",
    "top_sources": _BOOK + "SELECT code, CAST(sum(amount) AS DOUBLE) AS amount FROM findings GROUP BY code ORDER BY 2 DESC, code LIMIT 5",
    "rank_cases": _BOOK + """SELECT finding_id, customer_id, evidence, score, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, finding_id) AS INTEGER) AS place, row_number() OVER (ORDER BY score DESC, finding_id) AS overall FROM (
      SELECT *, CAST(round(CAST(0.4 * least(CAST(amount AS DOUBLE) / 10000, 1) + 0.25 * confidence + 0.15 * evidence + 0.1 * least(CAST(greatest(date_diff('day', period, DATE '1999-01-01'), 0) AS DOUBLE) / 90, 1) + 0.1 * CASE WHEN status = 'open' THEN 1.0 ELSE 0.5 END AS DECIMAL(12,8)), 4) AS DOUBLE) AS score
      FROM (SELECT *, CASE WHEN clause IS NULL THEN 0.33::DOUBLE ELSE 0.5::DOUBLE END AS evidence FROM findings))""",
    "net_realized": _BOOK + "SELECT case_id, CAST(net AS DOUBLE) AS net, CAST(realized AS DOUBLE) AS realized, reversals, CAST(round(net * 0.20::DECIMAL(3,2), 2) AS DOUBLE) AS fee FROM (SELECT case_id, CAST(sum(CASE WHEN kind = 'reversal' THEN -amount ELSE amount END) AS DECIMAL(18,2)) AS net, sum(amount) FILTER (kind <> 'reversal') AS realized, count(*) FILTER (kind = 'reversal') AS reversals FROM rec GROUP BY case_id)",
    "running_reversal_guard": _BOOK + "SELECT event_id, case_id, CAST(running AS DOUBLE) AS running FROM (SELECT *, sum(CASE WHEN kind = 'reversal' THEN -amount ELSE amount END) OVER (PARTITION BY case_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM rec) WHERE kind = 'reversal' AND running < 0",
    "ledger_integrity": _BOOK
    + """, replayed AS (SELECT event_id, event_id % 1000 + case_id * 1000 AS case_id, kind, amount FROM rec UNION ALL SELECT event_id, event_id % 1000 + case_id * 1000, kind, amount FROM rec WHERE event_id % 97 = 0)
      SELECT 'reversed too much' AS violation, CAST(case_id AS VARCHAR) AS id, CAST(excess AS DOUBLE) AS excess FROM (SELECT case_id, coalesce(sum(amount) FILTER (kind = 'reversal'), 0) - coalesce(sum(amount) FILTER (kind = 'realization'), 0) AS excess FROM replayed GROUP BY case_id) WHERE excess > 0
      UNION ALL SELECT 'id occurs twice', CAST(event_id AS VARCHAR), CAST(count(*) AS DOUBLE) FROM replayed GROUP BY event_id HAVING count(*) > 1""",
    "event_identity": _BOOK + "SELECT event_id, event_key FROM keyed",
    "dedupe_events": _BOOK + "SELECT event_key, arg_min(event_id, (received_at, event_id)) AS event_id FROM keyed GROUP BY event_key",
    "event_panel": _BOOK + "SELECT strftime(received_at, '%Y-%m-%d') AS start, trigger, count(*) AS events, CAST(sum(value) AS DOUBLE) AS value FROM changes GROUP BY ALL",
    "fee_status_fold": _BOOK + f"SELECT customer_id, arg_max(([{', '.join(repr(v) for v in assurance.FEE_STATES.values())}])[CAST(event_id % 10 + 1 AS INTEGER)], (received_at, event_id)) AS status, count(*) AS events FROM changes WHERE event_id % 10 < 9 GROUP BY customer_id",
    "impacted_scope": _BOOK
    + """, moves AS (SELECT * FROM (SELECT user_id * 7 + event_id % 3 AS customer_id, event_id % 11 = 0 AS every, CAST(DATE '1996-01-01' + to_months(CAST(event_id % 60 AS INTEGER)) AS DATE) AS month FROM events) WHERE customer_id % 5 <> 4),
      per AS (SELECT customer_id, bool_or(every) AS every FROM moves GROUP BY ALL), named AS (SELECT DISTINCT customer_id, month FROM moves WHERE NOT every)
      SELECT p.customer_id, CAST(i.period AS VARCHAR) AS period FROM per p LEFT JOIN (SELECT DISTINCT customer_id, period FROM invoices) i ON i.customer_id = p.customer_id LEFT JOIN named n ON n.customer_id = p.customer_id AND n.month = i.period WHERE every OR n.month IS NOT NULL OR i.period IS NULL""",
    "pseudo_pages": _BOOK + "SELECT doc_id, CAST(page AS INTEGER) AS page, sha256(text) AS page_sha256 FROM pages",
    "critical_terms": _BOOK + f"SELECT doc_id, CAST(page AS INTEGER) AS page, term, count(*) AS times FROM (SELECT doc_id, page, unnest(regexp_extract_all(lower(text), '{D.CRITICAL}')) AS term FROM pages) GROUP BY ALL",
    "quote_in_document": r"WITH q AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents) SELECT DISTINCT item_id, doc_id FROM q JOIN d ON contains(d.text, q.text)",
}
