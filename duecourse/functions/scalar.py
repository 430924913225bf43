"""Scalar functions on columns: periods, amounts, line roles, name keys, ids and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date formats in the order they are tried, line-role words, and the name keys' words.
DATE_FORMATS = ("yyyy-MM-dd", "M/d/yyyy", "MMM d yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "yyyy-MM", "yyyy/MM/dd", "M/d/yy")
PRORATION = r"(?i)\b(prorat\w*|partial period|unused time|remaining time)\b"
TAX = r"(?i)\b(sales tax|vat|gst|hst|pst|qst|tax)\b"
CREDIT = r"(?i)\b(credit note|credit memo|service credit|credit|refund|chargeback|goodwill|adjustment|write-?off)\b"
SEAT = r"(?i)\b(seat|user|license|licence)s?\b"
# a word of each is in every text that the pattern of its name fits
PRORATION_WORDS = ("prorat", "partial", "unused", "remaining")
TAX_WORDS = ("tax", "vat", "gst", "hst", "pst", "qst")
CREDIT_WORDS = ("credit", "refund", "chargeback", "goodwill", "adjustment", "write")
SEAT_WORDS = ("seat", "user", "licen")
SUFFIXES = ("llc", "inc", "co", "corp", "corporation", "company", "group", "grp", "ltd", "limited", "plc", "gmbh", "the", "and")
ABBREVIATIONS = {"intl": "international", "svcs": "services", "mfg": "manufacturing", "tech": "technology", "assoc": "associates", "bros": "brothers"}
CONFIDENT = 0.85
CURRENCIES = ("USD",)
SEAT_QUANTITY = r"(?i)(\d[\d,]*)\s*(?:x\s*)?(?:seat|user|licen[cs]e)s?\b"
ANNIVERSARY = r"anniversary of the (effective|commencement) date"
LITERAL = r"^-?\$?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d{1,6})?%?$"
AMENDMENT = r"amendment\s*(?:no\.?|number|#)?\s*(\d+)"
ROLE_PATTERNS = (
    (r"amendment|addendum", "amendment"),
    (r"order[ _-]?form|sales[ _-]?order|quote", "order_form"),
    (r"exhibit|schedule|attachment", "exhibit"),
    (r"statement[ _-]of[ _-]work|\bsow\b", "sow"),
)
# Families of rules that the fixed rules own, by the names they go by.
OWNED = (
    "committed_minimum", "usage_overage", "discount_expiration", "annual_escalator", "committed_seat_charge", "minimum_commitment", "monthly_minimum", "minimum_monthly_fee", "overage", "overage_rate",
    "discount", "promotional_discount", "escalator", "price_escalator", "price_increase", "seats", "committed_seats", "seat_price", "seat_charge",
)


def parse_date(text: Column) -> Column:
    """The first format that fits; null if none does. Years of two digits from 69 on are of the last century."""
    read = lambda f: F.try_to_timestamp(F.trim(text), F.lit(f)).cast("date")
    short = read(DATE_FORMATS[-1])
    return F.coalesce(*[read(f) for f in DATE_FORMATS[:-1]], F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short))


def parse_period(text: Column) -> Column:
    return F.date_format(parse_date(text), "yyyy-MM")


def parse_amount(text: Column) -> Column:
    """Dollar signs and thousands commas go; parentheses negate; null if no number is left."""
    plain = F.regexp_replace(F.trim(text), r"[$,\s]", "")
    inside = F.regexp_extract(plain, r"^\((.*)\)$", 1)
    return F.when(inside != "", -inside.try_cast("decimal(18,6)")).otherwise(plain.try_cast("decimal(18,6)"))


def _says(text: Column, low: Column, words: tuple[str, ...], pattern: str) -> Column:
    """text.rlike(pattern), asked only of texts that have one of the words, without which the pattern can't fit."""
    some = low.contains(words[0])
    for w in words[1:]:
        some = some | low.contains(w)
    return some & text.rlike(pattern)


def line_role(description: Column, amount: Column, metered: Column, prorated: Column, is_contract_discount: Column) -> Column:
    """Role of a billing line; the first rule that holds counts."""
    text = F.coalesce(description, F.lit(""))
    low = F.lower(text)
    return (
        F.when(prorated | _says(text, low, PRORATION_WORDS, PRORATION), "proration")
        .when(_says(text, low, TAX_WORDS, TAX), "tax")
        .when((amount < 0) & is_contract_discount, "discount")
        .when((amount < 0) & _says(text, low, CREDIT_WORDS, CREDIT), "credit")
        .when(amount < 0, "discount")
        .when(metered | low.contains("overage"), "overage")
        .when(_says(text, low, SEAT_WORDS, SEAT), "seat")
        .otherwise("base")
    )


def name_key(name: Column, suffixes: bool) -> Column:
    """Lower-case words joined by _, abbreviations spelt out; without corporate suffixes unless asked for."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda x: x != "")
    full = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    parts = F.transform(parts, lambda x: F.coalesce(F.element_at(full, x), x))
    return F.array_join(parts if suffixes else F.filter(parts, lambda x: ~x.isin(*SUFFIXES)), "_")


def verbatim_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\s+", " "))


def money(x: Column) -> Column:
    return F.round(x, 2).cast("decimal(18,2)")


def cents(x: Column) -> Column:
    return (F.round(x.cast("decimal(20,6)"), 2) * 100).cast("long")


def currency_code(x: Column) -> Column:
    code = F.upper(F.trim(x))
    return F.when(code.rlike("^[A-Z]{3}$"), code)


def is_supported(x: Column) -> Column:
    return currency_code(x).isin(*CURRENCIES)


def row_period(period: Column, start: Column) -> Column:
    """The period column's month if that isn't empty, else the start date's; null where neither can be read."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return parse_period(F.coalesce(filled(period), filled(start)))


def seat_quantity(units: Column, description: Column) -> Column:
    """How many seats a line is for: its units, else the number before the word for seats in its description."""
    said = F.regexp_replace(F.regexp_extract(F.coalesce(description, F.lit("")), SEAT_QUANTITY, 1), ",", "")
    return F.coalesce(parse_amount(units), said.try_cast("decimal(18,6)"))


def first_anniversary(date: Column, term_start: Column, quote: Column) -> Column:
    """An escalator's date: one on the term's start moves by a year if the quote names the anniversary, else it is unknown."""
    named = F.lower(F.coalesce(quote, F.lit(""))).rlike(ANNIVERSARY)
    return F.when(~F.coalesce(date == term_start, F.lit(False)), date).when(named, F.add_months(date, 12))


def parse_literal(text: Column, signed: Column) -> Column:
    """A number as contracts write it, or null: dollar sign, digits plain or in groups, six decimals, percent sign; a minus only where `signed`."""
    t = F.trim(F.coalesce(text, F.lit("")))
    plain = F.regexp_replace(t, r"[$,%]", "").try_cast("decimal(38,6)")
    fits = (F.length(t) <= 32) & t.rlike(LITERAL) & (signed | ~t.startswith("-"))
    return F.when(fits & (F.abs(plain) <= F.lit("1000000000000").cast("decimal(38,6)")), plain)


def numbers_in_text(text: Column) -> Column:
    """All numbers of a text as an array; N% gives N and N/100."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\$?\s*\d[\d,]*(?:\.\d+)?\s*%?"), F.lit(0))
    value = lambda t: F.regexp_replace(t, r"[$,%\s]", "").cast("decimal(28,8)")
    return F.flatten(F.transform(tokens, lambda t: F.when(t.contains("%"), F.array(value(t), (value(t) / 100).cast("decimal(28,8)"))).otherwise(F.array(value(t)))))


def next_step(held: Column, status: Column, verified: Column, actions: Column, realized: Column) -> Column:
    """What to do with a case, from whether it is held, its status, whether it is verified, its actions' statuses and whether anything came in."""
    has = lambda *s: F.arrays_overlap(F.coalesce(actions, F.array().cast("array<string>")), F.array(*map(F.lit, s)))
    acting = status.isin("approved", "invoiced", "disputed")
    return (
        F.when(held, "Inspect the document structure before recovery")
        .when((status == "open") & verified, "Approve for recovery")
        .when(status == "open", "Review evidence / confirm term")
        .when(acting & has("sent", "awaiting_response"), "Await counterparty response")
        .when(acting & has("approved"), "Execute approved action")
        .when(acting & has("pending_approval"), "Approve recovery action")
        .when(acting & has("draft"), "Submit for approval")
        .when(status == "approved", "Prepare recovery action")
        .when(status == "invoiced", "Follow up on payment")
        .when(status == "disputed", "Resolve dispute")
        .when((status == "recovered") & realized, "Closed — verified realized")
        .when(status == "recovered", "Record realized value")
        .otherwise("None")
    )


def evidence_completeness(*fields: Column) -> Column:
    """The share of fields that are there, in two decimals; an empty text isn't."""
    there = [F.coalesce(c.cast("string") != "", F.lit(False)).cast("int") for c in fields]
    total = there[0]
    for t in there[1:]:
        total = total + t
    return F.round(total / len(fields), 2)


def fused_confidence(extraction: Column, found: Column, moved: Column, verdict: Column, ocr: Column, gate: float = 0.85) -> Column:
    """The least of the extraction's confidence and what each check leaves of it."""
    said = F.when(verdict == "unclear", 0.7).when(verdict == "contradicts", 0.2).otherwise(1.0)
    return F.least(extraction, F.when(~found, 0.5).otherwise(1.0), F.when(found & moved, 0.9).otherwise(1.0), said, F.when(ocr < gate, 0.7).otherwise(1.0))


def document_role(role: Column, file_name: Column, head: Column) -> Column:
    """A document's role by its file name or first words, the first pattern that is in either; else the role it came with."""
    name, start = F.lower(F.coalesce(file_name, F.lit(""))), F.lower(F.substring(F.coalesce(head, F.lit("")), 1, 300))
    out = F.when(role.isin("master", "amendment", "order_form", "exhibit", "sow"), role).otherwise("other")
    for pattern, value in reversed(ROLE_PATTERNS):
        out = F.when(name.rlike(pattern) | start.rlike(pattern), value).otherwise(out)
    return out


def amendment_number(*texts: Column) -> Column:
    found = [F.regexp_extract(F.lower(F.coalesce(t, F.lit(""))), AMENDMENT, 1).try_cast("int") for t in texts]
    return F.coalesce(*found)


def rule_family(family: Column, name: Column) -> Column:
    """legacy for families that the fixed rules own, by family or by a word in the rule's name; else generic."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(family, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(key.isin(*OWNED) | F.lower(F.coalesce(name, F.lit(""))).rlike("minimum|overage|discount|escalat|seat"), "legacy").otherwise("generic")


def dollars(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount.cast("decimal(18,2)"), 2))


def recovery_letter(customer: Column, period: Column, title: Column, amount: Column, clause: Column) -> Column:
    """A letter that asks for the amount and quotes at most 400 characters of the clause."""
    quote = F.when(F.length(clause) > 400, F.concat(F.substring(clause, 1, 400), F.lit("…"))).otherwise(clause)
    because = F.when(F.coalesce(quote, F.lit("")) != "", F.concat(F.lit('The clause reads: "'), quote, F.lit('"\n\n'))).otherwise("")
    return F.concat(F.lit("Dear "), customer, F.lit(",\n\nfor "), period, F.lit(" the agreement asks for more than was billed: "), title, F.lit(", "), dollars(amount), F.lit(".\n\n"), because, F.lit("Please pay "), dollars(amount), F.lit(" or tell us within 15 days what is wrong."))


def letter_fault(text: Column, amount: Column, allowed: Column) -> Column:
    """Why a letter may not go out, null if it may: the amount must stand in it, and no other dollar figure but the allowed."""
    figures = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\$\d[\d,]*(?:\.\d+)?"), F.lit(0))
    others = F.array_except(figures, F.array_union(allowed, F.array(dollars(amount))))
    return F.when(~F.coalesce(F.array_contains(figures, dollars(amount)), F.lit(False)), "amount missing").when(F.size(others) > 0, "unexpected amount")


def monthly_amount(amount: Column, declared: Column, quote: Column) -> Column:
    """A yearly, quarterly or monthly amount per month; null where the quote names no single period or another one."""
    text = F.lower(F.coalesce(quote, F.lit("")))
    named = {"year": r"\b(annual(ly)?|year(ly)?|per annum)\b", "quarter": r"\bquarter(ly)?\b", "month": r"\bmonth(ly)?\b"}
    found = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in named.items()]))
    period = F.when((F.size(found) == 1) & (declared.isNull() | (declared == F.get(found, F.lit(0)))), F.get(found, F.lit(0)))
    months = F.when(period == "year", 12).when(period == "quarter", 3).when(period == "month", 1)
    return money(amount / months)


def escalator_steps(start: Column, period_end: Column) -> Column:
    """Anniversaries of start that have begun by period_end, its own day included."""
    later = (F.month(period_end) * 100 + F.dayofmonth(period_end)) < (F.month(start) * 100 + F.dayofmonth(start))
    return F.greatest(F.lit(0), 1 + F.year(period_end) - F.year(start) - later.cast("int"))


def stable_id(prefix: str, *parts: Column) -> Column:
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(text, 256), 1, 20))


def rank_score(value: Column, confidence: Column, evidence: Column, age_days: Column, status_weight: Column) -> Column:
    part = lambda x: F.least(x, F.lit(1.0))
    score = 0.4 * part(value / 10000) + 0.25 * confidence + 0.15 * evidence + 0.1 * part(age_days / 90) + 0.1 * status_weight
    return F.round(score.cast("decimal(12,8)"), 4).cast("double")  # as a decimal, so that halves round alike everywhere
