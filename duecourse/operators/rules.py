"""The discrepancy rules: one aligned row per customer and month, one pass, no to many findings and reviews.

A row of facts may lack columns of which a book knows nothing; these count as null. Besides the roll-ups and the contract's
terms, facts may have `prorated`, `currencies` (an array), `conflicts` (an array of the terms whose values compete), `tiers`
(array of lower, up_to, rate), `applied` (array of the month's deductions: name, amount, expires; those whose discount had
not run out may be left out), or `discount_expires` for all of them, `active_seats`, `confirmed`, `term_confidence` (a map of
terms to confidences; a rule is as sure as the least sure of its terms and the contract).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import CONFIDENT, escalator_steps, is_supported, money
from ..staging import with_place

MONEY = "decimal(18,2)"
OPTIONAL = {
    "prorated": "boolean", "currencies": "array<string>", "conflicts": "array<string>", "tiers": "array<struct<lower:decimal(18,6),up_to:decimal(18,6),rate:decimal(18,6)>>",
    "applied": "array<struct<name:string,amount:decimal(18,2),expires:date>>", "active_seats": "decimal(18,2)", "confirmed": "boolean", "credit_lines": "array<string>", "discount_expires": "date", "term_confidence": "map<string,double>",
}
# The terms that each rule rests on.
RULE_TERMS = {
    "MISSING_BASE": ["committed_minimum"], "MINIMUM": ["committed_minimum"], "OVERAGE": ["included_units", "overage_rate"], "EXPIRED_DISCOUNT": ["discounts"], "ESCALATOR": ["committed_minimum", "annual_escalator"],
    "SEATS": ["committed_seats", "seat_price"],
}
#: Terms whose conflict stops a month, and those that only disable the minimum's rule.
STOPPING = ["term_start", "term_end"]


def with_optional(facts: DataFrame) -> DataFrame:
    return facts.withColumns({c: F.lit(None).cast(kind) for c, kind in OPTIONAL.items() if c not in facts.columns})


def with_gate(facts: DataFrame) -> DataFrame:
    """The first gate that stops a row, null if none does."""
    end = F.last_day("period")
    rows = with_optional(facts)
    currencies = F.coalesce("currencies", F.array().cast("array<string>"))
    gate = (
        F.when((F.size(F.array_distinct(currencies)) > 1) | F.exists(currencies, lambda c: ~F.coalesce(is_supported(c), F.lit(False))), "currency")
        .when(end < F.col("effective_date"), "not yet effective")
        .when((F.col("period") > F.col("term_end")) & ~F.coalesce("auto_renew", F.lit(False)), "after the term")
        .when(F.arrays_overlap(F.coalesce("conflicts", F.array().cast("array<string>")), F.array(*map(F.lit, STOPPING))), "term dates conflict")
    )
    return rows.withColumn("period_end", end).withColumn("gate", gate)


def escalated(amount: Column, rate: Column, steps: Column) -> Column:
    """amount raised by rate once a step, in exact decimals."""
    factor = (F.lit(1) + rate.cast("decimal(8,6)")).cast("decimal(10,6)")
    return money(F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), amount.cast("decimal(30,12)"), lambda a, _: (a * factor).cast("decimal(30,12)")))


def tiered(units: Column, tiers: Column) -> Column:
    """units priced band by band; those above a bounded last band aren't charged."""
    zero = F.lit(0).cast("decimal(30,12)")
    part = lambda t: (F.greatest(F.least(units, F.coalesce(t["up_to"], units)) - F.least(units, t["lower"]), F.lit(0)) * t["rate"]).cast("decimal(30,12)")
    return F.aggregate(tiers, zero, lambda a, t: (a + part(t)).cast("decimal(30,12)"))


def _text(*parts) -> Column:
    """Text and amounts in one line."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _outcomes() -> list[tuple[str, Column, Column, Column]]:
    """(code, condition, amount, formula) of each rule with one outcome a month; a null condition or amount doesn't fire."""
    base, minimum = F.coalesce("base", F.lit(0).cast(MONEY)), F.col("minimum")
    whole = ~F.coalesce("prorated", F.lit(False))
    sure = ~F.array_contains(F.coalesce("conflicts", F.array().cast("array<string>")), "committed_minimum")
    other = F.col("billed") - base > 0
    lost = (base <= 0.005) & other
    short = minimum - base
    beyond = F.greatest(F.col("units") - F.col("included_units"), F.lit(0).cast(MONEY))
    over = F.when(F.size("tiers") > 0, tiered(beyond, F.col("tiers"))).otherwise(beyond * F.col("overage_rate")) - F.col("overage")
    steps = escalator_steps(F.col("escalator_date"), F.col("period_end"))
    risen = escalated(minimum, F.col("escalator_pct"), steps) - F.greatest(base, minimum)
    seats = F.greatest("committed_seats", "active_seats") - F.col("seat_units")
    negative = F.coalesce((F.col("active_seats") < 0) | (F.col("seat_units") < 0), F.lit(False))
    return [
        ("MISSING_BASE", whole & lost & minimum.isNotNull(), minimum, _text("no base charge in ", money(F.col("billed")), " billed; the minimum is ", minimum)),
        ("MINIMUM", whole & sure & ~lost & (short > 0), short, _text("minimum ", minimum, " - base ", base, " = ", money(short))),
        ("OVERAGE", over > 0.01, over, _text(beyond.cast(MONEY), " units beyond ", F.col("included_units"), F.when(F.size("tiers") > 0, F.lit(" by tiers")).otherwise(_text(" at ", F.col("overage_rate"))), " - ", F.col("overage"), " billed = ", money(over))),
        ("ESCALATOR", whole & (steps > 0) & (risen > 0.01), risen, _text("minimum ", minimum, " raised ", steps, " times by ", (F.col("escalator_pct") * 100).cast("decimal(8,2)"), "% - ", F.greatest(base, minimum), " = ", money(risen))),
        ("SEATS", ~negative & (seats >= 1), seats * F.col("seat_price"), _text(seats.cast(MONEY), " seats beyond ", F.col("seat_units"), " billed, at ", F.col("seat_price"), " = ", money(seats * F.col("seat_price")))),
    ]


def _expired(explained: bool) -> Column:
    """A finding for each deduction whose discount had run out when the month began."""
    applied = F.when(F.col("applied").isNotNull(), F.col("applied")).otherwise(
        F.when(F.col("discounts") > 0, F.array(F.struct(F.lit(None).cast("string").alias("name"), F.col("discounts").alias("amount"), F.col("discount_expires").alias("expires"))))
    )
    late = F.filter(applied, lambda x: (x["expires"] < F.col("period")) & (x["amount"] > 0))
    return F.coalesce(F.transform(late, lambda x: F.struct(F.lit("EXPIRED_DISCOUNT").alias("code"), money(x["amount"]).alias("amount"), (_text(F.coalesce(x["name"], F.lit("a discount")), " ended ", x["expires"], ", ", money(x["amount"]), " taken off") if explained else F.lit(None).cast("string")).alias("formula"), x["name"].alias("discount"))), F.array().cast("array<struct<code:string,amount:decimal(18,2),formula:string,discount:string>>"))


def fired(explained: bool = True) -> Column:
    """What the rules find in a month that no gate stops, in order: an array of (code, amount, formula, discount)."""
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(code).alias("code"), money(amount).alias("amount"), (formula if explained else F.lit(None).cast("string")).alias("formula"), F.lit(None).cast("string").alias("discount"))) for code, test, amount, formula in _outcomes()]))
    return F.concat(found, _expired(explained))


def finding_id(x: Column, at: Column) -> Column:
    """The id of x, which is at place `at` (from 0) of the month's `every`: findings of one code are numbered from the second on."""
    nth = F.size(F.filter(F.slice("every", 1, at + 1), lambda y: y["code"] == x["code"]))
    return F.concat_ws("-", F.lit("F"), F.col("customer_id"), F.date_format("period", "yyyyMM"), x["code"], F.when(nth > 1, nth.cast("string")))


def run_book(facts: DataFrame, explained: bool = True, kept: tuple[str, ...] = ()) -> DataFrame:
    """facts (aligned rows with `minimum`) to findings: finding_id, customer_id, period, code, amount, formula, discount, status.

    A finding without a clause or with low confidence is held for review with its amount; a contract that a human
    confirmed is sure. All months and rules are in one plan, and the rules add no shuffle to that of the alignment.
    Where a rule fires more than once in a month its findings are numbered from the second on. Unless explained, formulas
    are null: for totals, which would make them for nothing. `kept` names more columns of the facts to keep.
    """
    rows = with_gate(facts).where("gate is null")
    rows = rows.select("customer_id", "customer_name", "period", "confidence", "confirmed", "term_confidence", "clause", *kept, fired(explained).alias("every"))
    # an inner explode would evaluate all outcomes once more, in a filter of its own
    rows = rows.select("*", F.posexplode_outer("every").alias("at", "x")).where("x is not null")
    number = finding_id(F.col("x"), F.col("at"))
    least = F.coalesce(F.col("confidence"), F.lit(0.0))
    for code, names in RULE_TERMS.items():
        least = F.when(F.col("x.code") == code, F.least(F.coalesce(F.col("confidence"), F.lit(0.0)), *[F.try_element_at("term_confidence", F.lit(n)) for n in names])).otherwise(least)
    confidence = F.when(F.col("confirmed"), 1.0).otherwise(least)
    held = F.when(F.coalesce(F.trim("clause"), F.lit("")) == "", "no clause").when(confidence < CONFIDENT, "low confidence").otherwise("open")
    return rows.select("customer_id", "customer_name", "period", "confidence", "clause", *kept, held.alias("status"), "x.*", number.alias("finding_id"))


def reviews(facts: DataFrame) -> DataFrame:
    """Rows for a human: gates that stopped a month, competing terms, prorated months, credits that are never netted,
    months whose usage is incomplete, and what keeps a rule from being judged."""
    rows = with_gate(facts)
    past = (F.col("period") > F.col("term_end")) & F.col("auto_renew") & F.col("escalator_pct").isNotNull() & F.col("escalator_date").isNull()
    no_seats = F.col("committed_seats").isNotNull() & F.col("seat_units").isNull()
    reason = F.array_compact(F.array(
        F.col("gate"), F.when(F.col("n_credits") > 0, "credits"), F.when(F.col("incomplete"), "several meters"), F.when(F.col("base").isNull(), "no base charge"),
        F.when(F.col("prorated"), "prorated"), F.when(past, "renewed without an escalator date"), F.when(no_seats, "no seat line"), F.when(F.col("seat_units") < 0, "negative seats"),
    ))
    reason = F.concat(reason, F.transform(F.coalesce("conflicts", F.array().cast("array<string>")), lambda c: F.concat(F.lit("conflict: "), c)))
    return rows.select("customer_id", "period", F.explode(reason).alias("reason")).distinct()


def by_recoverable(findings: DataFrame) -> DataFrame:
    """findings with their place in the whole book in order of amount, largest first; of equal amounts the least id first."""
    return with_place(findings, F.desc("amount"), F.col("finding_id"))
