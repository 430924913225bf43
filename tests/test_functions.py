"""Scalar functions, temporal terms and stores on small rows."""

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from duecourse.functions import scalar as S
from duecourse.operators import charges, documents, identity, provenance, terms
from duecourse.sources import book, sinks


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_line_roles(spark):
    rows = [("Prorated charge for June", 100, "proration"), ("Sales tax", 64, "tax"), ("GST", 10, "tax"), ("Service credit", -100, "credit"), ("Refund — goodwill", -50, "credit"),
            ("Unknown negative line", -25, "discount"), ("API overage", 30, "overage"), ("Platform subscription", 5000, "base"), ("pro-rated fee", 10, "base")]
    df = spark.createDataFrame([(d, float(a), w) for d, a, w in rows], "d string, a double, want string")
    got = df.select("want", S.line_role(F.col("d"), F.col("a"), F.lit(False), F.lit(False), F.lit(False)).alias("got"))
    assert all(r.want == r.got for r in got.collect())


def test_dates_and_amounts(spark):
    texts = [("2026-06-01", "2026-06"), ("06/01/2026", "2026-06"), ("Jun 1 2026", "2026-06"), ("2026-07", "2026-07"), ("soon", None), (None, None)]
    df = spark.createDataFrame(texts, "t string, want string").select("want", S.parse_period(F.col("t")).alias("got"))
    assert all(r.want == r.got for r in df.collect())
    amounts = [("$1,234.50", Decimal("1234.50")), ("(12.00)", Decimal("-12")), ("x", None), (None, None)]
    df = spark.createDataFrame(amounts, "t string, want decimal(18,6)").select("want", S.parse_amount(F.col("t")).alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_monthly_amounts(spark):
    rows = [(96000, "year", "an annual fee", 8000.0), (15000, "quarter", "per quarter", 5000.0), (8500, "month", "each month", 8500.0), (120000, None, "annual", 10000.0), (10000, "year", "per year", 833.33),
            (1, "month", "annual", None), (1, None, "no period", None), (1, None, "monthly or yearly", None)]
    df = spark.createDataFrame(rows, "a int, p string, q string, want double")
    got = df.select("want", S.monthly_amount(F.col("a"), F.col("p"), F.col("q")).cast("double").alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_escalator_steps_and_money(spark):
    day = lambda s: F.lit(s).cast("date")
    assert one(spark, S.escalator_steps(day("2024-05-01"), day("2026-06-30"))) == 3
    assert one(spark, S.escalator_steps(day("2024-05-01"), day("2024-04-30"))) == 0
    assert one(spark, S.money(F.lit(10000.0) * F.pow(F.lit(1.04), 3) - 10000)) == Decimal("1248.64")
    assert one(spark, S.cents(F.lit("1.005").cast("decimal(18,6)"))) == 101


def test_customers_resolve_only_where_one_fits(spark):
    c = spark.createDataFrame([(1, "NorthPeak Logistics LLC"), (2, "Acme North"), (3, "Acme Holdings"), (4, "Sterling Dental Group"), (5, "Sterling Dental LLC")], "customer_id long, customer_name string")
    asked = spark.createDataFrame([("northpeak logistics",), ("Acme N",), ("Acme",), ("Sterling Dental",), ("STERLING  DENTAL LLC",)], "label string")
    got = {r.label: r.customer_id for r in identity.resolve_customers(asked, c).collect()}
    assert got == {"northpeak logistics": 1, "Acme N": None, "Acme": None, "Sterling Dental": None, "STERLING  DENTAL LLC": 5}


def test_minimum_falls_back_to_the_earliest(spark):
    s = spark.createDataFrame([(1, date(2025, 1, 1), Decimal(9000), 1), (1, date(2025, 9, 1), Decimal(6000), 2), (1, date(2025, 9, 1), Decimal(7000), 3)], "customer_id long, effective date, value decimal(18,2), seq long")
    p = spark.createDataFrame([(1, date(2024, 6, 1)), (1, date(2025, 8, 1)), (1, date(2025, 9, 1))], "customer_id long, period date")
    got = {r.period: r.minimum for r in terms.minimum_asof(s, p).collect()}
    assert got == {date(2024, 6, 1): Decimal(9000), date(2025, 8, 1): Decimal(9000), date(2025, 9, 1): Decimal(6000)}


def test_tiers(spark):
    q = spark.createDataFrame([("k", "r", Decimal(12000))], "key string, rule string, units decimal(18,2)")
    t = spark.createDataFrame([("r", Decimal(5000), Decimal("0.05")), ("r", None, Decimal("0.04"))], "rule string, up_to decimal(18,2), rate decimal(18,6)")
    assert terms.tiered_amount(q, t).first().amount == Decimal("530.00")


def test_upsert_keeps_status_and_reopens_what_the_system_withdrew(spark):
    store = spark.createDataFrame([("a", "approved", None, 1.0), ("b", "rejected", "system", 2.0), ("c", "rejected", None, 3.0), ("d", "open", None, 4.0)], "finding_id string, status string, withdrawn_by string, amount double")
    fresh = spark.createDataFrame([("a", "open", None, 10.0), ("b", "open", None, 20.0), ("c", "open", None, 30.0), ("e", "open", None, 50.0)], "finding_id string, status string, withdrawn_by string, amount double")
    got = {r.finding_id: (r.status, r.amount) for r in sinks.upsert_findings(store, fresh).collect()}
    assert got == {"a": ("approved", 10.0), "b": ("open", 20.0), "c": ("rejected", 30.0), "d": ("open", 4.0), "e": ("open", 50.0)}


def test_csv_headers_by_alias(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Txn Date,Customer,Amount\n2026-06-01,Acme,5\n,,\n")
    df = book.read_aliased_csv(spark, str(tmp_path / "x.csv"), {"date": ["period_start", "txn date"], "customer": ["customer"]}, {"memo": ["memo"]})
    assert [tuple(r) for r in df.collect()] == [("2026-06-01", "Acme", None)]


def test_chunks_by_hand(spark):
    sizes = {1: [10, 10, 10], 2: [90, 10, 90], 3: [500], 4: [60, 60, 30, 30]}
    pages = spark.createDataFrame([(d, i + 1, "x" * n) for d, ns in sizes.items() for i, n in enumerate(ns)], "doc_id long, page int, text string")
    got = {}
    for r in documents.chunk_pages(pages, max_chars=100, mark=0).collect():
        got.setdefault(r.doc_id, []).append((r.first, r.last))
    assert {d: sorted(w) for d, w in got.items()} == {1: [(1, 3)], 2: [(1, 2), (2, 3)], 3: [(1, 1)], 4: [(1, 1), (2, 3), (3, 4)]}


def test_rights_say_what_is_missing(spark):
    c = spark.createDataFrame([(1, "clause", 0.9, 5.0, 10.0), (2, " ", 0.5, 5.0, None), (3, "clause", 0.9, None, None)], "customer_id long, clause string, confidence double, overage_rate double, included_units double")
    assert {r.customer_id: (r.active, r.reasons) for r in provenance.extract_rights(c).collect()} == {1: (True, ""), 2: (False, "terms missing; no clause; low confidence")}


def test_a_line_pays_for_the_first_charge_that_fits(spark):
    day = date(2025, 9, 1)
    c = spark.createDataFrame([(1, day, "seat", "east", Decimal(100), None, 2), (1, day, "seat", "west", Decimal(50), None, 2), (1, day, "base", "east", Decimal(10), None, 1)], "customer_id long, period date, kind string, scope string, expected decimal(18,2), review string, n_scopes long")
    rows = [("1", "seat", "east", "west plan", 90), ("2", "seat", None, "west plan", 50), ("3", "seat", None, "plan", 7), ("4", "base", None, "subscription", 4), ("5", "base", None, "other", 6)]
    lines = spark.createDataFrame([(i, 1, day, k, s, t, Decimal(a)) for i, k, s, t, a in rows], "line_id string, customer_id long, period date, kind string, scope string, label string, amount decimal(18,2)")
    got = charges.match_lines(c, lines)
    assert {r.line_id: r.charge for r in got.collect()} == {"1": "east", "2": "west", "4": "east"}
    assert {(r.kind, r.scope): (r.outcome, int(r.recoverable)) for r in charges.ledger_variance(c, lines, got).collect()} == {("seat", "east"): ("underbilled", 10), ("seat", "west"): ("met", 0), ("base", "east"): ("underbilled", 6)}


def test_expected_charges_tell_seats_from_minimums(spark):
    day = date(2025, 9, 1)
    D = Decimal
    terms = [
        ("a", "minimum", "x", 100), ("a", "committed", "x", 2), ("a", "seat_price", "x", 10),  # seats and a minimum in one scope
        ("b", "minimum", charges.DEFAULT, 100), ("b", "committed", "x", 2), ("b", "seat_price", "x", 10),  # a generic minimum beside seats
        ("c", "committed", charges.DEFAULT, 2), ("c", "seat_price", charges.DEFAULT, 10), ("c", "committed", "x", 3), ("c", "seat_price", "x", 10),  # generic beside specific seats
        ("d", "included", "x", 5), ("d", "rate", "y", 2), ("e", "included", charges.DEFAULT, 5), ("e", "rate", "y", 2), ("f", "included", "x", 5), ("f", "rate", "x", 2), ("f", "included", "y", 1), ("f", "rate", "y", 3),
        ("g", "minimum", "x", 10), ("g", "committed", "x", 2), ("g", "seat_price", "x", 10), ("h", "committed", "x", 2), ("i", "minimum", "x", 7), ("i", "seat_price", "x", 10),
    ]
    live = spark.createDataFrame([(c, day, t, s, D(v)) for c, t, s, v in terms], "customer_id string, period date, term string, scope string, value decimal(18,2)")
    used = spark.createDataFrame([(c, day, D(15), D(1)) for c in "abcdefghi"], "customer_id string, period date, units decimal(18,2), seats decimal(18,2)")
    got = {(r.customer_id, r.kind, r.scope): (int(r.expected), r.review) for r in charges.expected_charges(live, used).collect()}
    assert got == {
        ("a", "base", "x"): (80, "minimum beside seats"), ("a", "seat", "x"): (20, "seats and minimum in one scope"), ("b", "base", charges.DEFAULT): (100, "minimum beside seats"), ("b", "seat", "x"): (20, None),
        ("c", "seat", charges.DEFAULT): (20, "generic beside specific seats"), ("c", "seat", "x"): (30, None), ("d", "overage", "y"): (20, "two scopes on one meter"), ("e", "overage", "y"): (20, None),
        ("f", "overage", "x"): (20, "several scopes on one meter"), ("f", "overage", "y"): (42, "several scopes on one meter"), ("g", "seat", "x"): (20, "seats and minimum in one scope"), ("i", "base", "x"): (7, None), ("i", "seat", "x"): (10, "no committed seats"),
    }
    over = live.where("customer_id = 'c'").withColumn("overrides", F.col("scope") == "x")
    assert {(r.scope, r.review) for r in charges.expected_charges(over, used).collect()} == {("x", None)}


def test_the_most_specific_charge_takes_a_line(spark):
    day = date(2025, 9, 1)
    c = spark.createDataFrame([("a", day, "base", s, Decimal(1), None, 3) for s in ("east", "eastern", "alpha")], "customer_id string, period date, kind string, scope string, expected decimal(18,2), review string, n_scopes long")
    lines = [("1", "east", "alpha plan"), ("2", None, "the eastern plan"), ("3", None, "alpha and east"), ("4", None, "none"), ("5", "zzz", "alpha")]
    rows = spark.createDataFrame([(i, "a", day, "base", s, t, Decimal(1)) for i, s, t in lines], "line_id string, customer_id string, period date, kind string, scope string, label string, amount decimal(18,2)")
    assert {r.line_id: r.charge for r in charges.match_lines(c, rows).collect()} == {"1": "east", "2": "eastern", "3": "alpha", "5": "alpha"}
