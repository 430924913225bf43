"""Rules from JSON text: faults by hand, and 300 random rules against a plain evaluator."""

import json
import random
from datetime import date
from decimal import ROUND_HALF_UP, Decimal

from duecourse.operators import rightspec as R
from duecourse.operators import rulejson as J

SEEN = f"customer_id long, period date, type string, seq int, amount {R.NUMBER}, quantity {R.NUMBER}, value {R.NUMBER}, date date, currency string"
UNIT = {"type": "per_unit", "rate": {"constant": "r"}, "quantity_observation": "usage"}
CONSTANTS = [{"name": "r", "value": "2.5", "kind": "rate"}, {"name": "n", "value": 10, "kind": "quantity"}, {"name": "p", "value": "5%", "kind": "percentage"}, {"name": "d", "value": "2026-05-01", "kind": "date"}]


def spec(k, **more):
    return {"spec_version": "1", "right_id": f"R-{k}", "trigger": {"op": "event_exists", "observation": "usage"}, "calculation": UNIT, "contractual_constants": CONSTANTS, "actual_observation": "billed", "actual_observation_optional": True} | more


def texts(spark, specs):
    return spark.createDataFrame([(k, "", s if isinstance(s, str) or s is None else json.dumps(s)) for k, s in enumerate(specs)], "customer_id long, quote string, spec string")


def nested(levels, leaf):
    return leaf if levels == 1 else {"op": "and", "children": [nested(levels - 1, leaf)]}


def test_faults(spark):
    leaf = {"op": "event_exists", "observation": "usage"}
    before = {"op": "observed_date_before", "observation": "usage", "value": {"constant": "n"}}
    got = {r.customer_id: (r.status, r.reasons) for r in J.validate_texts(J.parse_rules(texts(spark, [
        spec(0), "{not json", None, spec(3, colour=1), spec(4, trigger={**leaf, "why": 1}), spec(5, calculation={**UNIT, "x": 1}), spec(6, contractual_constants=[*CONSTANTS, {"name": "z", "value": 1, "unit": "kg"}]),
        spec(7, trigger=nested(8, leaf)), spec(8, trigger=nested(9, leaf)), spec(9, trigger=before), spec(10, trigger={**before, "value": {"constant": "d"}}), spec(11, calculation={"type": "magic"}), spec(12, calculation={"type": "fixed_amount", "amount": {"constant": "gone"}}),
        spec(13, calculation=None), "[]", spec(15, trigger={"op": "or", "children": [leaf, {"op": "near"}]}),
    ]))).collect()}
    assert {k: v[0] for k, v in got.items() if v[0] == "valid"} == dict.fromkeys((0, 7, 10), "valid")
    assert got[1] == got[2] == ("rejected", "not JSON") and got[8] == ("rejected", "too many levels") and got[9] == ("needs_review", "no date n")
    assert [got[k] for k in (3, 4, 5)] == [("unsupported", f"unknown key {x}") for x in ("colour", "why", "x")] and got[6] == ("unsupported", "unknown key unit")
    assert got[11] == got[13] == ("unsupported", "unknown calculation") and got[12] == ("needs_review", "undeclared constant") and got[15] == ("unsupported", "unknown operator")
    assert got[14][0] == "unsupported"


def test_parts_of_a_text(spark):
    deep = {"op": "and", "children": [{"op": "or", "children": [{"op": "gt", "observation": "usage", "value": {"constant": "n"}}]}, {"op": "between", "observation": "seats", "low": {"constant": "n"}, "high": {"constant": "r"}}]}
    r = J.parse_rules(texts(spark, [spec(0, trigger=deep, required_observations=["seats"], contractual_constants=[*CONSTANTS, {"name": "n", "value": 99, "kind": "quantity"}])])).first()
    assert r.constants == {"r": Decimal("2.5"), "n": 10, "p": Decimal("0.05")} and r.dates == {"d": date(2026, 5, 1)} and r.required == ["seats"] and not r.faults
    assert [(n.op, n.value, n.low, n.high) for n in r.nodes] == [("gt", "n", None, None), ("or", None, None, None), ("between", None, "n", "r"), ("and", None, None, None)]
    by = {n.id: n for n in r.nodes}
    assert [by[n.parent].op if n.parent else None for n in r.nodes] == ["or", "and", "and", None]


# ---- a plain evaluator


def money(x):
    return x.quantize(Decimal("0.01"), ROUND_HALF_UP)


def truth(node, seen, consts, dates, end):
    """True, False, or None where what it looks at is missing."""
    op, o = node["op"], seen.get(node.get("observation"))
    if op in ("and", "or"):
        below = [truth(c, seen, consts, dates, end) for c in node["children"]]
        strong = op == "or"
        return strong if strong in below else None if None in below else not strong
    if op == "event_exists":
        return o is not None
    name = node.get("value", {}).get("constant")
    if op.startswith("observed_date"):
        day, on = dates.get(name), o and o["date"]
        if day is None or on is None:
            return None
        return {"observed_date_before": on < day, "observed_date_on_or_before": on <= day, "observed_date_after": on > day, "observed_date_on_or_after": on >= day}[op]
    v = o and next((o[k] for k in ("amount", "value", "quantity") if o[k] is not None), None)
    if v is None:
        return None
    if op in ("date_reached", "date_before"):
        day = dates.get(name)
        return None if day is None else (end >= day if op == "date_reached" else end < day)
    if op == "between":
        low, high = consts.get(node["low"]["constant"]), consts.get(node["high"]["constant"])
        return None if low is None or high is None else low <= v <= high
    c = consts.get(name)
    return None if c is None else {"eq": v == c, "neq": v != c, "gt": v > c, "gte": v >= c, "lt": v < c, "lte": v <= c}[op]


def expected(calc, seen, consts):
    def first(name, *order):
        o = seen.get(name)
        return None if o is None else next((o[k] for k in order if o[k] is not None), None)

    amount, quantity = (lambda n: first(n, "amount", "value", "quantity")), (lambda n: first(n, "quantity", "value", "amount"))
    const = lambda k: consts.get((calc.get(k) or {}).get("constant"))
    ref = lambda r: consts.get(r["constant"]) if "constant" in r else amount(r["observation"])
    kind, out = calc["type"], None
    tiers = [(consts.get(t["up_to"]["constant"]) if t.get("up_to") else None, consts.get(t["rate"]["constant"])) for t in calc.get("tiers") or calc.get("bands") or []]
    over = quantity(calc.get("quantity_observation"))
    above = const("above") if calc.get("above") else Decimal(0)
    over = None if over is None or above is None else max(over - above, Decimal(0))

    def band(x):
        held = sorted(((Decimal(99999999999999) if u is None else u, r) for u, r in tiers), key=lambda t: t[0])
        return None if x is None or any(r is None for _, r in held) else next((r for u, r in held if x <= u), held[-1][1])

    if kind == "fixed_amount":
        out = const("amount")
    elif kind == "percentage_of":
        base = amount(calc["base_observation"])
        out = None if base is None or const("rate") is None else const("rate") * base
    elif kind == "per_unit":
        out = None if over is None or const("rate") is None else const("rate") * over
    elif kind == "difference":
        a, b = ref(calc["minuend"]), ref(calc["subtrahend"])
        out = None if a is None or b is None else a - b if calc.get("floor_zero") is False else max(a - b, Decimal(0))
    elif kind in ("min_of", "max_of"):
        held = [ref(o) for o in calc["operands"]]
        out = None if None in held else (min if kind == "min_of" else max)(held)
    elif kind == "volume_tiered":
        rate = band(over)
        out = None if rate is None else over * rate
    elif kind == "banded_percentage_of":
        base, rate = amount(calc["base_observation"]), band(amount(calc["band_observation"]))
        out = None if base is None or rate is None else rate * base
    elif kind == "tiered" and over is not None:
        low, out = Decimal(0), Decimal(0)
        rest = over
        for up, rate in tiers:
            if rate is None and rest > 0:
                out = None
                break
            part = rest if up is None else min(rest, max(up - low, Decimal(0)))
            if part > 0:
                out, rest, low = out + part * rate, rest - part, low + part
            else:
                low = low if up is None else up
    for key, pick in (("cap", min), ("floor", max)):
        if calc.get(key):
            out = None if out is None or const(key) is None else pick(out, const(key))
    return out


def outcome(s, seen, day, currencies):
    consts = {c["name"]: Decimal(str(c["value"])) for c in s["contractual_constants"] if c["kind"] != "date"}
    dates = {c["name"]: date.fromisoformat(c["value"]) for c in s["contractual_constants"] if c["kind"] == "date"}
    calc = s["calculation"]
    o = seen.get(calc.get("quantity_observation"))
    q = o and next((o[k] for k in ("quantity", "value", "amount") if o[k] is not None), None)
    if any(c != s["currency"] for c in currencies):
        return "currency mismatch", None
    if q is not None and q < 0:
        return "negative quantity", None
    if any(r not in seen for r in s["required_observations"]):
        return "missing required", None
    hit = truth(s["trigger"], seen, consts, dates, date(day.year, day.month, 30))
    if hit is not True:
        return ("trigger unknown" if hit is None else "not triggered"), None
    due = expected(calc, seen, consts)
    if due is None:
        return "operands unresolved", None
    act = seen.get(s["actual_observation"])
    found = act and next((act[k] for k in ("amount", "value", "quantity") if act[k] is not None), None)
    if found is None and not s["actual_observation_optional"]:
        return "missing actual", None
    return None, max(money(due) - (found or 0), Decimal(0))


def random_rule(rng, k):
    numbers = [f"n{i}" for i in range(6)]
    constants = [{"name": n, "value": rng.choice([0, 1, 5, 10, 12.5, 40, 100]), "kind": "amount"} for n in numbers[:-1]] + [{"name": f"d{i}", "value": f"2026-0{rng.randint(4, 8)}-15", "kind": "date"} for i in range(2)]
    const, obs = lambda: {"constant": rng.choice(numbers[:-1] if rng.random() < 0.97 else numbers)}, lambda: rng.choice(["usage", "seats", "base", "gone"] if rng.random() < 0.3 else ["usage", "seats", "base"])

    def trigger(depth):
        kind = rng.random()
        if depth < 5 and kind < 0.35:
            return {"op": rng.choice(["and", "or"]), "children": [trigger(depth + 1) for _ in range(rng.randint(1, 3))]}
        op = rng.choice(["event_exists", "date_reached", "date_before", "between", *R.COMPARISONS, *R.DATE_TESTS])
        node = {"op": op, "observation": obs()}
        if op == "between":
            node |= {"low": const(), "high": const()}
        elif op.startswith(("date", "observed")):
            node["value"] = {"constant": rng.choice(["d0", "d1"])}
        elif op != "event_exists":
            node["value"] = const()
        return node

    kind = R.CALCULATIONS[k % 9]
    calc = {"type": kind}
    operand = lambda: const() if rng.random() < 0.5 else {"observation": obs()}
    bands = lambda: [{"up_to": {"constant": f"n{i}"}, "rate": const()} for i in rng.sample(range(5), rng.randint(1, 3))] + [{"rate": const()}]
    if kind == "fixed_amount":
        calc["amount"] = const()
    if kind in ("percentage_of", "per_unit"):
        calc["rate"] = const()
    if kind in ("percentage_of", "banded_percentage_of"):
        calc["base_observation"] = obs()
    if kind in ("per_unit", "tiered", "volume_tiered"):
        calc["quantity_observation"] = obs()
        if rng.random() < 0.4:
            calc["above"] = const()
    if kind in ("tiered", "volume_tiered"):
        calc["tiers"] = bands()
    if kind == "banded_percentage_of":
        calc |= {"bands": bands(), "band_observation": obs()}
    if kind == "difference":
        calc |= {"minuend": operand(), "subtrahend": operand(), "floor_zero": rng.random() < 0.7}
    if kind in ("min_of", "max_of"):
        calc["operands"] = [operand() for _ in range(rng.randint(2, 4))]
    for key in ("cap", "floor"):
        if rng.random() < 0.2:
            calc[key] = const()
    return {"right_id": f"R-{k}", "trigger": trigger(0), "calculation": calc, "contractual_constants": constants, "currency": "USD", "actual_observation": rng.choice(["billed", "base"]), "actual_observation_optional": rng.random() < 0.6, "required_observations": [obs()] if rng.random() < 0.2 else []}


def test_300_random_rules_equal_a_plain_evaluator(spark):
    rng, day = random.Random(20260601), date(2026, 6, 1)
    specs = [random_rule(rng, k) for k in range(300)]
    rows, held = [], []
    for k in range(300):
        seen, currencies = {}, set()
        for kind in ("usage", "seats", "base", "billed"):
            if rng.random() < 0.85:
                number = lambda: Decimal(rng.choice([-3, 0, 1, 7, 12, 30, 55, 250]) if rng.random() < 0.95 else -1)
                o = {"amount": number() if kind in ("base", "billed") or rng.random() < 0.2 else None, "quantity": number() if kind in ("usage", "seats") else None, "value": number() if rng.random() < 0.2 else None, "date": date(2026, rng.randint(4, 8), 15) if rng.random() < 0.9 else None}
                seen[kind] = o
                currencies.add("EUR" if rng.random() < 0.02 else "USD")
                rows.append((k, day, kind, 0, o["amount"], o["quantity"], o["value"], o["date"], "EUR" if "EUR" in currencies else "USD"))
        held.append((seen, currencies))
    parsed = J.parse_rules(texts(spark, specs))
    got = {r.customer_id: (r.reason, r.recoverable) for r in R.evaluate_rules(parsed, spark.createDataFrame(rows, SEEN)).collect()}
    want = {k: outcome(specs[k], *([held[k][0], day, held[k][1]])) for k in range(300) if held[k][0]}
    wrong = {k: (got.get(k), want[k], specs[k]) for k in want if got.get(k) != want[k]}
    assert not wrong, next(iter(wrong.items()))
    reasons = {v[0] for v in want.values()}
    assert reasons >= {None, "trigger unknown", "not triggered", "operands unresolved", "missing actual", "negative quantity", "missing required"}


def test_a_text_is_validated_in_one_pass(spark):
    rules = J.parse_rules(spark.createDataFrame([(1, "", "{"), (1, "", '{"right_id":"a","colour":1}')], "customer_id long, quote string, spec string"))
    found = J.validate_texts(rules)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert len(found.collect()) == 2  # also of texts of one customer
