"""Rules by hand: the order of refusals, unknown triggers, tiers without a rate."""

from decimal import Decimal

from pyspark.sql import functions as F

from duecourse.operators import rightspec as R

RULE = f"right_id string, customer_id long, currency string, quote string, constants map<string,{R.NUMBER}>, dates map<string,date>, nodes {R.NODES}, calc {R.CALC}, actual string, actual_optional boolean, required array<string>"
SEEN = f"customer_id long, period date, type string, seq int, amount {R.NUMBER}, quantity {R.NUMBER}, value {R.NUMBER}, date date, currency string"
CALC = dict.fromkeys("type amount rate base quantity above band minuend subtrahend floor_zero cap floor tiers operands".split())


def rule(name, calc, nodes=(("event_exists", "usage", None),), optional=True, required=()):
    constants = {"n": Decimal(10), "rate": Decimal("0.5")}
    tests = [(i, None, op, seen, value, None, None) for i, (op, seen, value) in enumerate(nodes)]
    return (name, 1, "USD", "10 units at 50 %", constants, {}, tests, {**CALC, **calc}, "billed", optional, list(required))


def statuses(spark, rules, currency="USD", units=25):
    import datetime

    day = datetime.date(2026, 6, 1)
    seen = [(1, day, "usage", 0, None, Decimal(units), None, day, currency), (1, day, "usage", 1, None, Decimal(7), None, day, currency)]
    rows = R.evaluate_rules(spark.createDataFrame(rules, RULE), spark.createDataFrame(seen, SEEN)).collect()
    return {r.right_id: (r.status, r.reason, None if r.expected is None else float(r.expected)) for r in rows}


def test_cascade(spark):
    units = {"type": "per_unit", "rate": "rate", "quantity": "usage"}
    open_tiers = {"type": "tiered", "quantity": "usage", "tiers": [("n", "rate"), (None, "gone")]}
    got = statuses(spark, [
        rule("units", units), rule("needs", units, required=["seats"]), rule("unknown", units, nodes=[("gt", "seats", "n")]), rule("not", units, nodes=[("lt", "usage", "n")]),
        rule("gone", {**units, "rate": "gone"}), rule("actual", units, optional=False), rule("cap", {**units, "cap": "n"}), rule("lost cap", {**units, "cap": "gone"}), rule("tiers", open_tiers),
        rule("one band", {"type": "tiered", "quantity": "usage", "tiers": [("n", "rate"), (None, "rate")]}),
    ])
    assert got == {
        "units": ("evaluated", None, 12.5), "needs": ("not_evaluable", "missing required", None), "unknown": ("not_evaluable", "trigger unknown", None), "not": ("not_triggered", "not triggered", None),
        "gone": ("error", "operands unresolved", None), "actual": ("not_evaluable", "missing actual", None), "cap": ("evaluated", None, 10.0), "lost cap": ("error", "operands unresolved", None), "tiers": ("error", "operands unresolved", None),
        "one band": ("evaluated", None, 12.5),
    }
    assert statuses(spark, [rule("units", units)], currency="EUR")["units"][1] == "currency mismatch"
    assert statuses(spark, [rule("units", units)], units=-1)["units"][1] == "negative quantity"


def test_validation_and_grounding(spark):
    rows = spark.createDataFrame([rule("fine", {"type": "per_unit", "rate": "rate", "quantity": "usage"}), rule("odd", {"type": "magic"}), rule("lost", {"type": "fixed_amount", "amount": "gone"}), rule("few", {"type": "min_of", "operands": [("n", None)]})], RULE)
    got = {r.right_id: r.status for r in R.validate_rules(rows).collect()}
    assert got == {"fine": "valid", "odd": "unsupported", "lost": "needs_review", "few": "needs_review"}
    fine = {r.name: r.grounded for r in R.ground_constants(rows.where(F.col("right_id") == "fine")).collect()}
    assert fine == {"n": True, "rate": True}  # a rate may stand as a percentage
