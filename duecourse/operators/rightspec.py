"""The rule language: every rule over every month of its customer's observations, in one projection without an interpreter.

A rule is a row: right_id, customer_id, quote, constants (map of name to number), dates (map of name to date), nodes (its
trigger, children before parents, the root last), calc, actual (an observation's type), actual_optional, required. Its
nested columns are bounded by the limits below, so they stay in the row and only the observations are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The limits of a rule, and the names it may use.
MAX_CONSTANTS = 64
MAX_TIERS = 32
MAX_NODES = 64
COMPARISONS = ["eq", "neq", "gt", "gte", "lt", "lte"]
DATE_TESTS = ["observed_date_before", "observed_date_on_or_before", "observed_date_after", "observed_date_on_or_after"]
OPERATORS = ["and", "or", "event_exists", "date_reached", "date_before", "between", *COMPARISONS, *DATE_TESTS]
CALCULATIONS = ["fixed_amount", "percentage_of", "per_unit", "difference", "tiered", "volume_tiered", "banded_percentage_of", "min_of", "max_of"]

NUMBER = "decimal(18,4)"
WIDE = "decimal(28,8)"
NODES = "array<struct<id:int,parent:int,op:string,observation:string,value:string,low:string,high:string>>"
CALC = "struct<type:string,amount:string,rate:string,base:string,quantity:string,above:string,band:string,minuend:string,subtrahend:string,floor_zero:boolean,cap:string,floor:string,tiers:array<struct<up_to:string,rate:string>>,operands:array<struct<constant:string,observation:string>>>"


def _const(name: Column) -> Column:
    return F.try_element_at("constants", name)


def _amount(kind: Column) -> Column:
    o = F.try_element_at("seen", kind)
    return F.coalesce(o["amount"], o["value"], o["quantity"])


def _quantity(kind: Column) -> Column:
    o = F.try_element_at("seen", kind)
    return F.coalesce(o["quantity"], o["value"], o["amount"])


def _leaf(n: Column) -> Column:
    """A test's truth; null where what it looks at is missing."""
    op, seen, value = n["op"], n["amount"], n["constant"]
    day, on = F.try_element_at("dates", n["value"]), F.try_element_at("seen", n["observation"])["date"]
    truth = F.when(op == "event_exists", F.map_contains_key("seen", n["observation"]))
    for name, test in zip(DATE_TESTS, (on < day, on <= day, on > day, on >= day), strict=True):
        truth = truth.when(op == name, test)
    truth = truth.when(seen.isNull(), F.lit(None).cast("boolean")).when(op == "date_reached", F.col("period_end") >= day).when(op == "date_before", F.col("period_end") < day)
    truth = truth.when(op == "between", (seen >= _const(n["low"])) & (seen <= _const(n["high"])) & _const(n["low"]).isNotNull() & _const(n["high"]).isNotNull())
    for name, test in zip(COMPARISONS, (seen == value, seen != value, seen > value, seen >= value, seen < value, seen <= value), strict=True):
        truth = truth.when(op == name, test)
    return truth


def trigger_truth() -> Column:
    """0 false, 1 unknown, 2 true: of a conjunction the least of its children's, of a disjunction the greatest."""

    def step(done: Column, n: Column) -> Column:
        below = F.transform(F.filter(done, lambda d: d["parent"] == n["id"]), lambda d: d["truth"])
        leaf = _leaf(n)
        truth = F.when(n["op"] == "and", F.array_min(below)).when(n["op"] == "or", F.array_max(below)).otherwise(F.when(leaf, 2).when(~leaf, 0).otherwise(1))
        return F.concat(done, F.array(F.struct(n["parent"].alias("parent"), truth.alias("truth"))))

    start = F.array().cast("array<struct<parent:int,truth:int>>")
    looked = F.transform("nodes", lambda n: F.struct(*[n[c].alias(c) for c in ("id", "parent", "op", "observation", "value", "low", "high")], _amount(n["observation"]).alias("amount"), _const(n["value"]).alias("constant")))
    return F.aggregate(looked, start, step, lambda done: F.try_element_at(done, F.lit(-1))["truth"])


def _marginal(quantity: Column) -> Column:
    """Each band of the quantity at its own rate, tiers in the given order; null if a tier that is reached has no rate."""

    def step(a: Column, t: Column) -> Column:
        up_to, rate = _const(t["up_to"]), _const(t["rate"])
        band = F.when(up_to.isNull(), a["rest"]).otherwise(F.least(a["rest"], F.greatest(up_to - a["low"], F.lit(0)))).cast(WIDE)
        return F.struct(
            (a["rest"] - band).cast(WIDE).alias("rest"),
            F.when(band > 0, a["low"] + band).otherwise(F.coalesce(up_to, a["low"])).cast(WIDE).alias("low"),
            (a["total"] + F.when(band > 0, (band.cast(NUMBER) * F.coalesce(rate, F.lit(0).cast(NUMBER))).cast(WIDE)).otherwise(F.lit(0).cast(WIDE))).cast(WIDE).alias("total"),
            (a["bad"] | (rate.isNull() & (a["rest"] > 0))).alias("bad"),
        )

    zero = F.lit(0).cast(WIDE)
    start = F.struct(quantity.cast(WIDE).alias("rest"), zero.alias("low"), zero.alias("total"), F.lit(False).alias("bad"))
    return F.aggregate(F.col("calc.tiers"), start, step, lambda a: F.when(~a["bad"], a["total"]))


def _band_rate(value: Column) -> Column:
    """The rate of the one band that holds the value; above the last bound, the last rate."""
    bands = F.array_sort(F.transform("calc.tiers", lambda t: F.struct(F.coalesce(_const(t["up_to"]), F.lit("99999999999999").cast(NUMBER)).alias("up_to"), _const(t["rate"]).alias("rate"))))
    fit = F.coalesce(F.get(F.filter(bands, lambda b: value <= b["up_to"]), F.lit(0)), F.try_element_at(bands, F.lit(-1)))
    return F.when(value.isNotNull() & ~F.exists(bands, lambda b: b["rate"].isNull()), fit["rate"])


def with_expected(rows: DataFrame) -> DataFrame:
    """rows with what the calculation gives, after cap and floor, as `expected`; null where an operand can't be resolved.

    What several calculations or tests look at is a column first, so that it is worked out once a row.
    """
    c, kind = F.col("calc"), F.col("calc.type")
    above = F.when(c["above"].isNull(), F.lit(0).cast(NUMBER)).otherwise(_const(c["above"]))
    rows = rows.withColumns({"_rate": _const(c["rate"]), "_base": _amount(c["base"]), "_quantity": _quantity(c["quantity"]), "_above": above, "_cap": _const(c["cap"]), "_floor": _const(c["floor"])})
    rate, base, quantity, above = (F.col(f"_{n}") for n in ("rate", "base", "quantity", "above"))
    rows = rows.withColumn("_over", F.when(quantity.isNotNull() & above.isNotNull(), F.greatest(quantity - above, F.lit(0))).cast(NUMBER))
    over = F.col("_over")
    of = lambda name: F.coalesce(_const(name), _amount(name)).cast(NUMBER)
    less = of(c["minuend"]) - of(c["subtrahend"])
    operands = F.transform("calc.operands", lambda o: F.when(o["constant"].isNotNull(), _const(o["constant"]).cast(NUMBER)).otherwise(_amount(o["observation"]).cast(NUMBER)))
    known = (F.size(operands) > 0) & ~F.exists(operands, lambda v: v.isNull())
    amount = (
        F.when(kind == "fixed_amount", _const(c["amount"]).cast(WIDE))
        .when(kind == "percentage_of", (rate * base.cast(NUMBER)).cast(WIDE))
        .when(kind == "per_unit", (rate * over).cast(WIDE))
        .when(kind == "difference", F.when(less.isNull(), F.lit(None)).when(F.coalesce(c["floor_zero"], F.lit(True)), F.greatest(less, F.lit(0))).otherwise(less).cast(WIDE))
        .when(kind == "tiered", F.when(over.isNotNull(), _marginal(over)))
        .when(kind == "volume_tiered", (over * _band_rate(over)).cast(WIDE))
        .when(kind == "banded_percentage_of", (_band_rate(_amount(c["band"])) * base.cast(NUMBER)).cast(WIDE))
        .when(kind == "min_of", F.when(known, F.array_min(operands)).cast(WIDE))
        .when(kind == "max_of", F.when(known, F.array_max(operands)).cast(WIDE))
    )
    rows = rows.withColumn("_amount", amount)
    cap, floor, amount = F.col("_cap"), F.col("_floor"), F.col("_amount")
    rows = rows.withColumn("_capped", F.when(c["cap"].isNull(), amount).when(cap.isNotNull() & amount.isNotNull(), F.least(amount, cap)))
    capped = F.col("_capped")
    expected = F.when(c["floor"].isNull(), capped).when(floor.isNotNull() & capped.isNotNull(), F.greatest(capped, floor)).cast(WIDE)
    return rows.withColumn("expected", F.round(expected, 2).cast("decimal(18,2)"))


def observed(observations: DataFrame) -> DataFrame:
    """observations(customer_id, period, type, seq, amount, quantity, value, date, currency) to a row per customer and month:
    the first observation of each type, and the least and greatest of the currencies that occur: one, or two different ones."""
    key = ["customer_id", "period"]
    # dealt by month at once, so that both groupings are of one exchange
    first = observations.repartition(*key).groupBy(*key, "type").agg(F.min_by(F.struct("amount", "quantity", "value", "date"), "seq").alias("o"), F.min("currency").alias("least"), F.max("currency").alias("most"))
    return first.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("type", "o"))).alias("seen"), F.array_distinct(F.array_compact(F.array(F.min("least"), F.max("most")))).alias("currencies"))


def evaluate_rules(rules: DataFrame, observations: DataFrame) -> DataFrame:
    """A row per rule and month of its customer: status, reason, expected, actual and recoverable amount.

    In this order: limits, currency, negative quantity, required observations, trigger, calculation, actual amount.
    """
    return evaluate_months(rules, observed(observations))


def evaluate_months(rules: DataFrame, months: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """evaluate_rules() for months(customer_id, period, seen, currencies) as observed() has them; `kept` names columns of rules to keep."""
    rows = rules.join(months, "customer_id").withColumn("period_end", F.last_day("period"))
    rows = with_expected(rows.withColumn("truth", trigger_truth()))
    rows = rows.withColumn("found", _amount(F.col("actual")).cast("decimal(18,2)"))
    limits = (F.size("constants") > MAX_CONSTANTS) | (F.coalesce(F.size("calc.tiers"), F.lit(0)) > MAX_TIERS) | (F.size("nodes") > MAX_NODES)
    other = F.exists("currencies", lambda c: c != F.col("currency"))
    reason = (
        F.when(limits, "limits exceeded").when(other, "currency mismatch").when(_quantity(F.col("calc.quantity")) < 0, "negative quantity")
        .when(F.exists("required", lambda r: ~F.map_contains_key("seen", r)), "missing required").when(F.coalesce("truth", F.lit(1)) == 1, "trigger unknown").when(F.col("truth") == 0, "not triggered")
        .when(F.col("expected").isNull(), "operands unresolved").when(F.col("actual").isNotNull() & F.col("found").isNull() & ~F.col("actual_optional"), "missing actual")
    )
    rows = rows.withColumn("reason", reason)
    status = F.when(F.col("reason").isNull(), "evaluated").when(F.col("reason") == "not triggered", "not_triggered").when(F.col("reason").isin("limits exceeded", "operands unresolved"), "error").otherwise("not_evaluable")
    money = lambda c: F.when(F.col("reason").isNull(), c).cast("decimal(18,2)")
    actual = F.coalesce("found", F.lit(0).cast("decimal(18,2)"))
    return rows.select("right_id", "customer_id", "period", *kept, status.alias("status"), "reason", money(F.col("expected")).alias("expected"), money(actual).alias("actual"), money(F.greatest(F.col("expected") - actual, F.lit(0))).alias("recoverable"))


def rule_findings(evaluations: DataFrame) -> DataFrame:
    """Evaluated months with something to recover, with an id made of the rule, customer and month."""
    key = F.concat_ws("|", "right_id", F.col("customer_id").cast("string"), F.date_format("period", "yyyy-MM"))
    return evaluations.where("status = 'evaluated' and recoverable > 0").select(F.concat(F.lit("F-"), F.substring(F.sha1(key), 1, 8)).alias("finding_id"), "right_id", "customer_id", "period", "expected", "actual", "recoverable")


def flatten_rules(rules: DataFrame) -> dict[str, DataFrame]:
    """The nested parts as tables: constants, nodes, tiers, operands."""
    part = lambda column: rules.select("right_id", F.posexplode(column).alias("ordinal", "x")).select("right_id", "ordinal", "x.*")
    return {"constants": rules.select("right_id", F.explode("constants").alias("name", "value")), "nodes": part("nodes"), "tiers": part("calc.tiers"), "operands": part("calc.operands")}


def rule_faults() -> Column:
    """All that is wrong with a rule, as an array."""
    unknown = F.exists("nodes", lambda n: ~n["op"].isin(OPERATORS))
    declared = lambda name: F.map_contains_key("constants", name) | F.map_contains_key("dates", name)
    lost = F.exists("nodes", lambda n: F.exists(F.array_compact(F.array(n["value"], n["low"], n["high"])), lambda v: ~declared(v)))
    c = F.col("calc")
    named = F.array_compact(F.concat(F.array(c["amount"], c["rate"], c["above"], c["cap"], c["floor"]), F.coalesce(F.transform(c["tiers"], lambda t: t["rate"]), F.array().cast("array<string>")), F.coalesce(F.transform(c["tiers"], lambda t: t["up_to"]), F.array().cast("array<string>"))))
    few = c["type"].isin("min_of", "max_of") & ~F.coalesce(F.size(c["operands"]), F.lit(0)).between(2, 4)
    return F.array_compact(F.array(
        F.when(unknown, "unknown operator"), F.when(~c["type"].isin(CALCULATIONS), "unknown calculation"), F.when(lost | F.exists(named, lambda v: ~declared(v)), "undeclared constant"), F.when(few, "operands missing"),
        F.when(F.size("constants") > MAX_CONSTANTS, "too many constants"), F.when(F.coalesce(F.size(c["tiers"]), F.lit(0)) > MAX_TIERS, "too many tiers"), F.when(F.size("nodes") > MAX_NODES, "too many nodes"),
    ))


def validate_rules(rules: DataFrame) -> DataFrame:
    """What is wrong with each rule: (right_id, status, reasons); unsupported names weigh more than gaps."""
    rows = rules.select("right_id", rule_faults().alias("reasons"))
    status = F.when(F.size("reasons") == 0, "valid").when(F.exists("reasons", lambda r: r.startswith("unknown")), "unsupported").when(F.exists("reasons", lambda r: r.startswith("too many")), "rejected").otherwise("needs_review")
    return rows.select("right_id", status.alias("status"), F.array_join("reasons", "; ").alias("reasons"))


def ground_constants(rules: DataFrame, *more: str) -> DataFrame:
    """Each constant and whether its rule's quote has it, as it is or, for a rate, as a percentage; with more of the rule's columns, or its `value`."""
    numbers = F.transform(F.regexp_extract_all("quote", F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0)), lambda x: F.translate(x, ",", "").cast("double"))
    rows = rules.select("right_id", *[c for c in more if c != "value"], numbers.alias("numbers"), F.col("calc.rate").alias("rate"), F.explode("constants").alias("name", "value"))
    near = lambda scale: F.exists("numbers", lambda v: F.abs(v / scale - F.col("value").cast("double")) < 1e-9)
    return rows.select("right_id", "name", *more, (near(1.0) | (F.coalesce(F.col("name") == F.col("rate"), F.lit(False)) & near(100.0))).alias("grounded"))


def gate_candidates(candidates: DataFrame, checks: list[str], least: float = 0.85) -> DataFrame:
    """candidates(right_id, is_right, quote_supported, confidence, a boolean per check): rejected, needs_review with all reasons, or accepted."""
    failed = [F.when(~F.coalesce(F.col(c), F.lit(False)), c) for c in checks]
    reasons = F.array_compact(F.array(*failed, F.when(F.coalesce("confidence", F.lit(0.0)) < least, "low confidence")))
    status = F.when(~F.col("is_right") | ~F.col("quote_supported"), "rejected").when(F.size(reasons) > 0, "needs_review").otherwise("accepted")
    return candidates.select("right_id", status.alias("status"), F.array_join(reasons, "; ").alias("reasons"))
