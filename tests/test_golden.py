"""Whole books from files, to the cent."""

import json
import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from duecourse.operators import charges, rollups, rules, terms
from duecourse.sources import book

MONEY = "decimal(18,2)"
# customer, name, minimum, included, rate, escalator, month, notes, discounts, billed lines, used in June and July
BOOK = [
    ("northpeak", "NorthPeak Logistics", 4000, 1000000, 0.0025, 0.0, None, "Overage above 1,000,000 calls.", [], [("API Calls - base tier", 4000)], (1340000, 1512000)),
    ("sterling", "Sterling Dental Group", 6000, 40, 150, 0.04, "2026-03", "Annual increase of 4%.", [], [("Practice Suite - Enterprise (40 seats)", 6000)], (40, 40)),
    ("cascade", "Cascade Analytics", 5000, 25, 200, 0.0, None, None, [{"type": "promotional_percentage", "amount_pct": 0.2, "starts": "2025-06-01", "expires": "2025-11-30", "notes": "Launch promo: 20% off for 6 months."}], [("Data Platform - Growth (25 seats)", 5000), ("Launch promo -20%", -1000)], (25, 25)),
    ("meridian", "Meridian Foods", 8000, 10, 750, 0.0, None, "Floor of $8,000 a month.", [], [("Supply Chain Cloud - pro-rated for 6 facilities", 4800)], (6, 6)),
    ("volt", "Volt Robotics", 6000, 30, 250, 0.0, None, "Minimum lowered to 6000.", [], [("Fleet Ops Platform", 6000)], (22, 22)),
    ("harbor", "Harbor Freight Co", 3000, 500000, 0.004, 0.0, None, "Everything matches.", [], [("Logistics API - Standard", 3000)], (480000, 495000)),
]
PERIODS = ("2026-06", "2026-07")


def contract(row):
    k, name, minimum, included, rate, pct, month, notes, discounts, *_ = row
    return {"customer_id": k, "name": name, "contract_start": "2024-03-01", "contract_end": "2027-12-31", "currency": "USD", "minimum_monthly_commit": minimum, "annual_escalator_pct": pct, "escalator_effective_month": month, "notes": notes, "discounts": discounts,
            "committed_tier": {"product": "x", "included_units": included, "unit": "units", "base_monthly_fee": minimum, "overage_rate_per_unit": rate}}


def facts(contracts, usage, lines):
    return rollups.align_book(contracts, rollups.rollup_usage(usage), rollups.rollup_invoices(rollups.classified(lines, contracts)))


@pytest.fixture
def folder(tmp_path):
    invoices = [{"invoice_id": f"{r[0]}-{p}", "customer_id": r[0], "period": p, "line_items": [{"description": d, "amount": a} for d, a in r[9]]} for r in BOOK for p in PERIODS]
    usage = [{"customer_id": r[0], "period": p, "units_consumed": u} for r in BOOK for p, u in zip(PERIODS, r[10], strict=True)]
    (tmp_path / "contracts.json").write_text(json.dumps({"customers": [contract(r) for r in BOOK]}, indent=1))
    (tmp_path / "invoices.json").write_text(json.dumps({"invoices": invoices}, indent=1))
    (tmp_path / "usage.json").write_text(json.dumps(usage))  # a bare list
    return tmp_path


def test_clean_book(spark, folder):
    got = rules.run_book(facts(*book.read_book(spark, str(folder)))).collect()
    per = {}
    for r in got:
        per[r.customer_id, r.period.month] = per.get((r.customer_id, r.period.month), 0) + r.amount
    assert sum(r.amount for r in got) == Decimal("11010.00") and all(r.status == "open" for r in got)
    assert per == {("northpeak", 6): 850, ("northpeak", 7): 1280, ("sterling", 6): 240, ("sterling", 7): 240, ("cascade", 6): 1000, ("cascade", 7): 1000, ("meridian", 6): 3200, ("meridian", 7): 3200}
    rows = facts(*book.read_book(spark, str(folder)))
    assert rules.reviews(rows).isEmpty()


def test_messy_book(spark, folder):
    names = {"northpeak": ("NorthPeak Logistics", "northpeak-logistics"), "sterling": ("Sterling Dental", "sterling-dental-grp"), "cascade": ("Cascade Analytics Inc", "cascade-analytics"), "meridian": ("Meridian Foods LLC", "meridian-foods"), "volt": ("Volt Robotics", "volt-robotics"), "harbor": ("Harbor Freight Co", "harbor-freight")}
    days = {"northpeak": "06/01/2026 07/01/2026", "sterling": "2026-06-01 2026-07-01", "cascade": "Jun_1_2026 Jul_1_2026", "meridian": "06/01/2026 07/01/2026", "volt": "6/1/2026 7/1/2026", "harbor": "2026/06/01 2026/07/01"}
    bills = ["invoice,customer_name,period_start,period_end,description,amount_usd,status"]
    for r in BOOK:
        for p, day in zip(PERIODS, days[r[0]].replace("_", " ").split(" ") if "_" not in days[r[0]] else [x.replace("_", " ") for x in days[r[0]].split(" ")], strict=True):
            bills += [f"in-{r[0]}-{p}-{n},{names[r[0]][0]},{day},,{d.replace(' -20%', ' discount')},{a}.00,paid" for n, (d, a) in enumerate(r[9])]
    bills += ["in-x,NorthPeak Logistics,06/01/2026,,API Calls,9999.00,void", "in-y,Nobody Knows,06/01/2026,,API Calls,5.00,paid", bills[1]]
    (folder / "bills.csv").write_text("\n".join(bills) + "\n")
    (folder / "meters.csv").write_text("\n".join(["account,month,metric,qty"] + [f"{names[r[0]][1]},{p},calls,{u}" for r in BOOK for p, u in zip(PERIODS, r[10], strict=True)]) + "\n")
    (folder / "other.csv").write_text("colour,shape\nred,round\n")
    contracts, _, _ = book.read_book(spark, str(folder))
    # the escalator starts a year earlier, so two steps are due
    contracts = contracts.withColumn("escalator_date", F.when(F.col("customer_id") == "sterling", F.lit("2025-03-01").cast("date")).otherwise(F.col("escalator_date")))
    usage, lines, reviews = book.read_book_dir(spark, [str(folder / f) for f in ("bills.csv", "meters.csv", "other.csv")], contracts)
    got = rules.run_book(facts(contracts, usage, lines)).collect()
    assert sum(r.amount for r in got) == Decimal("11509.20") and len(got) == 8
    assert sorted(r.amount for r in got if r.customer_id == "sterling") == [Decimal("489.60")] * 2
    assert {(r.file, r.reason.split(";")[0]) for r in reviews.collect()} == {("bills.csv", "not billed"), ("bills.csv", "unknown customer"), ("other.csv", "no column for customer")}


def row(**x):
    base = {"customer_id": "c", "customer_name": "C", "period": date(2026, 6, 1), "units": None, "incomplete": False, "base": None, "overage": 0, "tax": 0, "seat_units": None, "discounts": 0, "credits": 0, "n_credits": 0, "billed": None, "included_units": None, "overage_rate": None,
            "escalator_pct": None, "escalator_date": None, "effective_date": date(2020, 1, 1), "term_end": date(2030, 1, 1), "auto_renew": False, "confidence": 0.95, "clause": "a clause", "discount_expires": None, "committed_seats": None, "seat_price": None, "minimum": None}
    return base | {"billed": x.get("base", 0)} | x


SCHEMA = f"""customer_id string, customer_name string, period date, units {MONEY}, incomplete boolean, base {MONEY}, overage {MONEY}, tax {MONEY}, seat_units {MONEY}, discounts {MONEY}, credits {MONEY}, n_credits int, billed {MONEY}, included_units {MONEY}, overage_rate decimal(18,6),
  escalator_pct double, escalator_date date, effective_date date, term_end date, auto_renew boolean, confidence double, clause string, discount_expires date, committed_seats {MONEY}, seat_price {MONEY}, minimum {MONEY}"""
EXTRA = "prorated boolean, currencies array<string>, conflicts array<string>, tiers array<struct<lower:decimal(18,6),up_to:decimal(18,6),rate:decimal(18,6)>>, applied array<struct<name:string,amount:decimal(18,2),expires:date>>, active_seats decimal(18,2), confirmed boolean"


def run(spark, *rows):
    names = [f.split()[0] for f in f"{SCHEMA}, {EXTRA}".replace("\n", " ").split(", ")]
    money = [f.split()[0] for f in SCHEMA.replace("\n", " ").split(", ") if "decimal" in f]
    fixed = [{k: Decimal(str(v)) if k in money and v is not None else v for k, v in r.items()} for r in rows]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in fixed], f"{SCHEMA}, {EXTRA}")


def amounts(df):
    return {(r.customer_id, r.finding_id.split("-", 3)[3]): r.amount for r in rules.run_book(df).collect()}


def test_synthetic_book(spark):
    got = amounts(run(
        spark, row(customer_id="acme", minimum=50000, included_units=10000, overage_rate=Decimal("3.5"), units=11200, base=42000, discounts=2000, discount_expires=date(2026, 3, 31)),
        row(customer_id="globex", minimum=20000, included_units=10000, overage_rate=Decimal(2), units=8000, base=20000), row(customer_id="initech", minimum=25000, included_units=5000, overage_rate=Decimal(5), units=5000, base=25000, escalator_pct=0.04, escalator_date=date(2026, 5, 1)),
    ))
    assert got == {("acme", "MINIMUM"): 8000, ("acme", "OVERAGE"): 4200, ("acme", "EXPIRED_DISCOUNT"): 2000, ("initech", "ESCALATOR"): 1000}
    assert sum(v for (c, _), v in got.items() if c == "acme") == 14200


def test_escalators_gates_and_seats(spark):
    risen = {"minimum": 10000, "escalator_pct": 0.04, "escalator_date": date(2024, 5, 1)}
    tiers = [(Decimal(0), Decimal(5000), Decimal("0.05")), (Decimal(5000), None, Decimal("0.04"))]
    got = amounts(run(
        spark, row(customer_id="a", base=10000, **risen), row(customer_id="b", base=10400, **risen), row(customer_id="d", base=9000, **risen), row(customer_id="e", base=9000, prorated=True, **risen), row(customer_id="f", base=9000, currencies=["USD", "EUR"], **risen), row(customer_id="g", base=9000, conflicts=["term_end"], **risen),
        row(customer_id="h", base=9000, conflicts=["committed_minimum"], **risen), row(customer_id="i", base=1, included_units=10000, units=22000, tiers=tiers), row(customer_id="j", base=1, committed_seats=10, active_seats=Decimal(12), seat_units=9, seat_price=5),
        row(customer_id="k", base=1, applied=[("x", Decimal(5), date(2026, 1, 1)), ("x", Decimal(7), date(2026, 1, 1)), ("y", Decimal(9), date(2027, 1, 1))]), row(customer_id="l", base=9000, confidence=0.2, confirmed=True, **risen),
    ))
    assert got == {
        ("a", "ESCALATOR"): Decimal("1248.64"), ("b", "ESCALATOR"): Decimal("848.64"), ("d", "MINIMUM"): 1000, ("d", "ESCALATOR"): Decimal("1248.64"), ("h", "ESCALATOR"): Decimal("1248.64"), ("i", "OVERAGE"): 530, ("j", "SEATS"): 15,
        ("k", "EXPIRED_DISCOUNT"): 5, ("k", "EXPIRED_DISCOUNT-2"): 7, ("l", "MINIMUM"): 1000, ("l", "ESCALATOR"): Decimal("1248.64"),
    }
    held = {(r.customer_id, r.reason) for r in rules.reviews(run(spark, row(customer_id="f", base=1, currencies=["USD", "EUR"]), row(customer_id="g", base=1, currencies=["EUR"]), row(customer_id="h", base=1, prorated=True, conflicts=["committed_minimum"]))).collect()}
    assert held == {("f", "currency"), ("g", "currency"), ("h", "prorated"), ("h", "conflict: committed_minimum")}


def test_scoped_ledger(spark):
    day = [date(2025, 8, 1), date(2025, 9, 1)]
    entry = "customer_id string, period date, term string, scope string, value decimal(18,2)"
    live = spark.createDataFrame([("c", d, *x) for d in day for x in (("minimum", "platform", Decimal(11000)), ("included", "platform", Decimal(200000)), ("rate", "platform", Decimal("0.05")), ("committed", "enterprise", Decimal(275)), ("seat_price", "enterprise", Decimal(42)))], entry)
    used = spark.createDataFrame([("c", day[0], Decimal(260000), Decimal(250)), ("c", day[1], Decimal(280000), Decimal(250))], "customer_id string, period date, units decimal(18,2), seats decimal(18,2)")
    due = charges.expected_charges(live, used)
    lines = spark.createDataFrame([(f"{d}{k}", "c", d, k, None, t, Decimal(a), None if q is None else Decimal(q)) for d, over in zip(day, (1800, 2400), strict=True) for k, t, a, q in (("seat", "enterprise workspace", 10500, 250), ("overage", "metered usage overage", over, None))], "line_id string, customer_id string, period date, kind string, scope string, label string, amount decimal(18,2), quantity decimal(18,2)")
    got = {(r.period.month, r.kind): (r.outcome, r.recoverable, r.derived_rate) for r in charges.ledger_variance(due, lines, charges.match_lines(due, lines)).collect()}
    assert {k: v[:2] for k, v in got.items()} == {(8, "base"): ("missing", 11000), (8, "seat"): ("underbilled", 1050), (8, "overage"): ("tariff mismatch", 1200), (9, "base"): ("missing", 11000), (9, "seat"): ("underbilled", 1050), (9, "overage"): ("tariff mismatch", 1600)}
    assert got[8, "overage"][2] == Decimal("0.03") and [sum(v[1] for (m, _), v in got.items() if m == x) for x in (8, 9)] == [13250, 13650]


def test_agreements(spark):
    docs = spark.createDataFrame([(1, "a", "master", date(2026, 1, 1)), (2, "a", "amendment", date(2026, 7, 1)), (3, "a", "exhibit", date(2026, 1, 1)), (4, "a", "amendment", None), (5, "a", "master", date(2025, 1, 1))], "doc_id long, counterparty string, role string, dated date")
    held = spark.createDataFrame([(1, 1, "minimum", None, None, Decimal(50000)), (2, 2, "minimum", None, date(2026, 7, 1), Decimal(42000)), (3, 3, "included", None, None, Decimal(20000)), (1, 4, "included", None, None, Decimal(10000)), (4, 5, "rate", None, None, Decimal(2)), (1, 6, "rate", None, None, Decimal("3.5")), (3, 7, "seats", None, None, Decimal(125)), (5, 8, "minimum", None, None, Decimal(1))], "doc_id long, seq long, term_type string, scope string, effective date, value decimal(18,2)")
    kept, places, reviews = terms.assemble_agreements(docs, held)
    assert {(r.term_type, r.value) for r in kept.collect()} == {("minimum", 42000), ("included", 10000), ("rate", Decimal("3.5")), ("seats", 125)}
    assert {(r.doc_id, r.reason) for r in reviews.collect()} == {(3, "disagrees on included"), (4, "undated amendment"), (5, "superseded")}
    assert {r.doc_id: r.place for r in places.collect()} == {1: "anchor", 2: "amendment", 3: "supplement", 4: "undated", 5: "superseded"}


def test_a_deduction_applies_the_first_discount_that_names_it(spark):
    kind = "customer_id string, discount_list array<struct<name:string,expires:date>>"
    old, new = date(2026, 1, 1), date(2027, 1, 1)
    contracts = spark.createDataFrame([("a", [("Launch promo", old), ("Promo", new), ("Loyalty rebate", old)]), ("b", [("Launch", old)]), ("c", []), ("d", None), ("e", [(None, new), ("", new), ("Rebate", old)])], kind)
    lines = [("a", "LAUNCH PROMO for June", -1), ("a", "a promo", -2), ("a", "loyalty", -4), ("a", "other", -8), ("a", "Service credit promo", -16), ("b", "anything", -32), ("b", "Service credit", -64), ("c", "x", -128), ("d", "x", -256), ("e", "rebate", -512), ("x", "x", -1024), ("a", None, -2048), ("a", "Launch promo", 5), ("b", "anything", -32)]
    rows = spark.createDataFrame([(c, date(2026, 6, 1), 1, t, Decimal(v), None) for c, t, v in lines], f"customer_id string, period date, invoice_id long, description string, amount {MONEY}, quantity {MONEY}")
    held = rollups.classified(rows, contracts)
    got = {(r.customer_id, int(-r.amount)): (r.role, r.discount, r.expires) for r in held.collect()}
    assert got == {
        ("a", 1): ("discount", "Launch promo", old), ("a", 2): ("discount", "Promo", new), ("a", 4): ("discount", "Loyalty rebate", old), ("a", 8): ("discount", "other", None), ("a", 16): ("discount", "Promo", new), ("b", 32): ("discount", "Launch", old),
        ("b", 64): ("credit", None, None), ("c", 128): ("discount", "x", None), ("d", 256): ("discount", "x", None), ("e", 512): ("discount", "Rebate", old), ("x", 1024): ("discount", "x", None), ("a", 2048): ("discount", "Launch promo", old), ("a", -5): ("base", None, None),
    }
    rolled = {r.customer_id: r for r in rollups.rollup_invoices(held).collect()}
    assert [(x.name, int(x.amount)) for x in rolled["a"].applied] == [("Launch promo", 1), ("Loyalty rebate", 4), ("Launch promo", 2048)] and rolled["a"].discounts == 2079 and rolled["a"].n_lines == 7
    assert [(x.name, int(x.amount)) for x in rolled["b"].applied] == [("Launch", 32)] * 2 and rolled["b"].n_credits == 1 and rolled["c"].applied == []
    assert {(r.customer_id, r.discount): int(r.amount) for r in rollups.deductions(held).collect()}["b", "Launch"] == 64


def test_the_end_of_a_term_without_a_word_on_renewal_stops_a_month(spark):
    ended = {"term_end": date(2026, 1, 1), "base": 1, "minimum": 10}
    rows = run(spark, row(customer_id="a", auto_renew=None, **ended), row(customer_id="b", auto_renew=True, **ended), row(customer_id="c", auto_renew=False, **ended))
    assert amounts(rows) == {("b", "MINIMUM"): 9}
    assert {(r.customer_id, r.reason) for r in rules.reviews(rows).collect()} == {("a", "after the term"), ("c", "after the term")}
    assert [r.formula for r in rules.run_book(rows).collect()] == ["minimum 10.00 - base 1.00 = 9.00"]


def test_minimum_is_carried_to_each_month(spark):
    months = [date(2025, m, 1) for m in (1, 3, 6)]
    rows = spark.createDataFrame([(c, m, "clash") for c in ("a", "b", "c") for m in months], "customer_id string, period date, value string")
    schedule = spark.createDataFrame([("a", date(2025, 2, 15), Decimal(5), 1), ("a", date(2025, 6, 1), Decimal(7), 3), ("a", date(2025, 6, 1), Decimal(6), 2), ("b", None, Decimal(1), 1)], f"customer_id string, effective date, value {MONEY}, seq long")
    got = {(r.customer_id, r.period.month): r.minimum for r in terms.with_minimum(rows, schedule).collect()}
    assert got == {("a", 1): 5, ("a", 3): 5, ("a", 6): 6, ("b", 1): 1, ("b", 3): 1, ("b", 6): 1, ("c", 1): None, ("c", 3): None, ("c", 6): None}


def test_entries_with_ends_give_way(spark):
    rng = random.Random(4)
    day = lambda: date(2025, rng.randint(1, 12), rng.choice([1, 15])) if rng.random() < 0.85 else None
    rows = [(f"c{rng.randint(0, 4)}", rng.choice(["x", None, "__default__"]), day(), day(), None if rng.random() < 0.05 else Decimal(k), k) for k in range(150)]
    schedule = spark.createDataFrame(rows, f"customer_id string, scope string, effective date, ends date, value {MONEY}, seq long").repartition(3)
    months = [date(2024 + m // 12, m % 12 + 1, 1) for m in range(36)]
    panel = spark.createDataFrame([(f"c{c}", m) for c in range(6) for m in months], "customer_id string, period date")
    for by in (["scope"], []):
        want = {}
        for c in range(6):
            for m in months:
                for scope in {r[1] or "__default__" for r in rows} if by else {None}:
                    live = [r for r in rows if r[0] == f"c{c}" and (not by or (r[1] or "__default__") == scope) and (r[2] is None or r[2] <= m) and (r[3] is None or r[3] >= m)]
                    if live:
                        want[f"c{c}", m, scope] = max(live, key=lambda r: (r[2] is not None, r[2] or m, -r[5]))[4]
        got = terms.active_terms(schedule, panel, by)
        assert {(r.customer_id, r.period, r.scope if by else None): r.value for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Python" not in plan
    assert terms.active_terms(schedule.limit(0), panel, ["scope"]).isEmpty()
