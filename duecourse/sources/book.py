"""The book: contracts, terms, usage and invoice lines. Derived from the star schema's tables, or read from CSV files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators.identity import resolve_customers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(base: str, days) -> F.Column:
    return F.date_add(F.lit(base).cast("date"), days.cast("int"))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(
        k.alias("customer_id"), F.col("c_name").alias("customer_name"),
        (k % 40 * 2).cast("decimal(18,2)").alias("included_units"), ((k % 7 + 1) * 10).cast("decimal(18,2)").alias("overage_rate"),
        F.when(k % 5 == 0, F.lit(0.04)).alias("escalator_pct"), _day("1995-01-01", k % 700).alias("escalator_date"),
        _day("1994-06-01", k % 900).alias("effective_date"), _day("1998-01-01", k % 1200).alias("term_end"), F.when(k % 17 != 0, k % 3 == 0).alias("auto_renew"),
        F.when(k % 11 == 0, 0.80).otherwise(0.95).alias("confidence"), F.when(k % 13 != 0, F.concat(F.lit("clause "), k.cast("string"))).alias("clause"),
        F.array_compact(F.array(
            F.struct(F.lit("Launch promo").alias("name"), _day("1996-01-01", k % 1500).alias("expires")),
            F.when(k % 3 != 1, F.struct(F.lit("Loyalty rebate").alias("name"), _day("1995-06-01", k % 1300).alias("expires"))),
            F.when(k % 4 == 0, F.struct(F.lit("Volume").alias("name"), F.lit(None).cast("date").alias("expires"))),
        )).alias("discount_list"),
        F.when(k % 6 == 0, (k % 9 + 40).cast("decimal(18,2)")).alias("committed_seats"), F.lit("12.50").cast("decimal(18,2)").alias("seat_price"),
    )


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated term values: customer_id, term_type, scope, effective, value, seq."""
    return _table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("customer_id"), F.col("o_orderpriority").alias("term_type"), F.col("o_orderstatus").alias("scope"),
        F.trunc("o_orderdate", "quarter").alias("effective"), (F.col("o_totalprice").cast("decimal(18,2)") * F.lit("0.1").cast("decimal(2,1)")).cast("decimal(18,2)").alias("value"), F.col("o_orderkey").alias("seq"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their order's customer: customer_id, ordered and shipped (months), invoice_id, number, flag, status, price, cut, tax, quantity.

    Amounts become decimals before the join, once a line item; as doubles they take twice the room in a shuffle.
    """
    amounts = {"price": "l_extendedprice", "cut": "l_discount", "tax": "l_tax", "quantity": "l_quantity"}
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("number"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.trunc("l_shipdate", "month").alias("shipped"), *[F.col(c).cast("decimal(18,2)").alias(n) for n, c in amounts.items()])
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("customer_id"), F.trunc("o_orderdate", "month").alias("ordered"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("invoice_id", F.col("o_orderkey")).drop("l_orderkey", "o_orderkey")


def _billed(*more) -> list[F.Column]:
    """A line item's charge, deduction and tax line; of `more`, the columns that each begins with."""
    price, cut, tax, quantity = (F.col(c) for c in ("price", "cut", "tax", "quantity"))
    charge = F.when(F.col("flag") == "R", "Metered usage overage").when((F.col("flag") == "N") & (F.col("status") == "O"), "Workspace seats").otherwise("Platform subscription")
    less = F.when(cut >= 0.09, "Service credit").when(F.col("number") % 3 == 0, "Loyalty").when(F.col("number") % 3 == 1, "Launch promo applied").otherwise("VOLUME price")
    return [
        F.struct(*more, charge.alias("description"), price.alias("amount"), quantity.alias("quantity")),
        F.struct(*more, less.alias("description"), (-F.round(price * cut, 2)).cast("decimal(18,2)").alias("amount"), F.lit(None).cast("decimal(18,2)").alias("quantity")),
        F.struct(*more, F.lit("Sales tax").alias("description"), F.round(price * tax, 2).cast("decimal(18,2)").alias("amount"), F.lit(None).cast("decimal(18,2)").alias("quantity")),
    ]


def usage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("customer_id", F.col("shipped").alias("period"), F.col("flag").alias("metric"), F.col("quantity").alias("units"))


def invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A charge, a deduction and a tax line for each line item: customer_id, period, invoice_id, description, amount, quantity."""
    rows = items(spark, sf_dir).select("customer_id", F.col("ordered").alias("period"), "invoice_id", F.explode(F.array(*_billed())).alias("x"))
    return rows.select("customer_id", "period", "invoice_id", "x.*").where("amount <> 0")


def feed_lines(items: DataFrame, *kept: str) -> DataFrame:
    """The lines of both feeds of items(), with more of its columns: those of usage_lines() are `used` and have a metric and their
    units as quantity, those of invoice_lines() a description and an amount. A line item is read once for all four.
    """
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    used = F.struct(F.lit(True).alias("used"), F.col("shipped").alias("period"), F.col("flag").alias("metric"), none("string", "description"), none("decimal(18,2)", "amount"), F.col("quantity").alias("quantity"))
    billed = _billed(F.lit(False).alias("used"), F.col("ordered").alias("period"), none("string", "metric"))
    return items.select("customer_id", "invoice_id", *kept, F.explode(F.array(used, *billed)).alias("x")).select("customer_id", "invoice_id", *kept, "x.*").where("used or amount <> 0")


def _records(spark: SparkSession, path: str, wrapper: str, schema: str) -> DataFrame:
    """The records of a JSON file: a list, or an object with the list under `wrapper`."""
    text = spark.read.text(path, wholetext=True).select(F.col("value"))
    wrapped = F.from_json("value", f"struct<{wrapper}: array<struct<{schema}>>>")[wrapper]
    return text.select(F.explode(F.coalesce(wrapped, F.from_json("value", f"array<struct<{schema}>>"))).alias("x")).select("x.*")


MONEY = "decimal(18,2)"
_CONTRACT = """customer_id: string, name: string, customer_name: string, currency: string, contract_start: date, contract_end: date, minimum_monthly_commit: decimal(18,2), annual_escalator_pct: double,
  escalator_effective_month: string, notes: string, committed_tier: struct<product: string, included_units: decimal(18,6), unit: string, base_monthly_fee: decimal(18,2), overage_rate_per_unit: decimal(18,6)>,
  discounts: array<struct<type: string, name: string, amount_pct: double, starts: date, expires: date, notes: string>>"""
_INVOICE = "invoice_id: string, customer_id: string, period: string, line_items: array<struct<description: string, amount: decimal(18,2), quantity: decimal(18,2)>>"
_USAGE = "customer_id: string, period: string, units: decimal(18,2), units_consumed: decimal(18,2), total_units: decimal(18,2), usage: decimal(18,2), metric: string, unit: string"


def read_book(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """contracts, usage lines and invoice lines from contracts.json, usage.json and invoices.json, each a list or wrapped in an object.

    A contract's clause is its notes or its first discount's; fields that aren't there are null.
    """
    c = _records(spark, f"{folder}/contracts.json", "customers", _CONTRACT)
    name = lambda d: F.coalesce(d["name"], F.nullif(F.regexp_extract(d["notes"], "^([^:]+):", 1), F.lit("")))
    has = F.col("annual_escalator_pct") > 0
    contracts = c.select(
        "customer_id", F.coalesce("customer_name", "name").alias("customer_name"), "currency", F.col("committed_tier.included_units").alias("included_units"), F.col("committed_tier.overage_rate_per_unit").alias("overage_rate"),
        F.when(has, F.col("annual_escalator_pct")).alias("escalator_pct"), F.when(has, F.to_date("escalator_effective_month", "yyyy-MM")).alias("escalator_date"),
        F.col("contract_start").alias("effective_date"), F.col("contract_end").alias("term_end"), F.lit(False).alias("auto_renew"), F.lit(1.0).alias("confidence"),
        F.coalesce("notes", F.get("discounts", F.lit(0))["notes"]).alias("clause"), F.transform("discounts", lambda d: F.struct(name(d).alias("name"), d["expires"].alias("expires"))).alias("discount_list"),
        F.lit(None).cast(MONEY).alias("committed_seats"), F.lit(None).cast(MONEY).alias("seat_price"), F.col("minimum_monthly_commit").alias("minimum"),
    )
    month = lambda p: F.to_date(p, "yyyy-MM")
    usage = _records(spark, f"{folder}/usage.json", "usage_records", _USAGE).select("customer_id", month("period").alias("period"), F.coalesce("metric", "unit", F.lit("units")).alias("metric"), F.coalesce("units", "units_consumed", "total_units", "usage").alias("units"))
    lines = _records(spark, f"{folder}/invoices.json", "invoices", _INVOICE).select("customer_id", month("period").alias("period"), "invoice_id", F.explode("line_items").alias("x")).select("customer_id", "period", "invoice_id", "x.*")
    return contracts, usage, lines


# Headers by role, the first that is there counts; statuses of bills that don't count.
ALIASES = {
    "customer": ["customer_id", "customer", "customer_name", "account", "account_name", "account_id", "client", "client_name", "contactname", "contact_name", "customer_name_", "display_name", "name"],
    "period": ["period", "month", "billing_period", "billing_month"],
    "period_start": ["period_start", "start", "start_date", "invoice_date", "date", "created", "service_start", "invoicedate", "txn_date", "transaction_date", "period_start_utc", "created_utc"],
    "amount": ["amount", "amount_usd", "amount_billed", "subtotal", "net_amount", "lineamount", "line_amount_", "amount_line", "total", "total_billed", "amount_due", "line_amount"],
    "description": ["description", "line_item", "item", "product", "memo", "plan", "memo_description", "product_service", "line_description", "item_description", "description_"],
    "units": ["units", "qty", "quantity", "units_consumed", "total_units", "usage", "value", "quantity_", "usage_quantity", "aggregated_usage"],
    "invoice_id": ["invoice", "invoice_id", "invoice_number", "id", "number", "invoicenumber", "num", "invoice_number_", "doc_number"],
    "metric": ["metric", "meter", "usage_type", "unit"],
    "status": ["status", "state"],
    "currency": ["currency", "currency_code", "ccy"],
}
UNCOUNTED = ("void", "draft", "uncollectible")


def read_feed(spark: SparkSession, path: str, contracts: DataFrame) -> tuple[str, DataFrame, DataFrame]:
    """One export as ('invoices' or 'usage' or 'unknown', its lines, its reviews): by its columns, labels resolved against the contracts.

    A file with amounts has invoice lines, else one with units has usage lines. Exact duplicates count once. Rows of bills
    that don't count, without a month that can be read or without a customer become reviews (file, label, reason).
    """
    raw = read_aliased_csv(spark, path, {"customer": ALIASES["customer"]}, {k: v for k, v in ALIASES.items() if k != "customer"}, keep_missing=False)
    there = set(raw.columns)
    kind = "invoices" if "amount" in there else "usage" if "units" in there else "unknown"
    role = lambda c: F.col(c) if c in there else F.lit(None).cast("string")
    rows = raw.distinct().select(F.col("customer").alias("label"), S.row_period(role("period"), role("period_start")).alias("month"), S.parse_amount(role("amount")).cast(MONEY).alias("amount"), role("description").alias("description"), S.seat_quantity(role("units"), F.when(role("description").rlike(S.SEAT), role("description"))).cast(MONEY).alias("units"), role("metric").alias("metric"), role("invoice_id").alias("invoice_id"), F.lower(role("status")).alias("status"))
    found = resolve_customers(rows.select("label"), contracts)
    rows = rows.join(found.select("label", "customer_id"), "label")
    reason = F.when(F.col("status").isin(*UNCOUNTED), "not billed").when(F.col("customer_id").isNull(), "unknown customer").when(F.col("month").isNull(), "no month").when(F.lit(kind == "invoices") & F.col("amount").isNull(), "no amount").when(F.lit(kind == "usage") & F.col("units").isNull(), "no units")
    rows = rows.withColumn("reason", F.lit("columns not known") if kind == "unknown" else reason)
    bad = rows.where("reason is not null").select(F.lit(path.rsplit("/", 1)[-1]).alias("file"), "label", "reason").distinct()
    good = rows.where("reason is null").withColumn("period", F.to_date("month", "yyyy-MM"))
    if kind == "usage":
        return kind, good.select("customer_id", "period", F.coalesce("metric", F.lit("units")).alias("metric"), "units"), bad
    return kind, good.select("customer_id", "period", "invoice_id", "description", "amount", F.col("units").alias("quantity")), bad


def read_book_dir(spark: SparkSession, files: list[str], contracts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """usage lines, invoice lines and reviews of any number of exports; a file that can't be read is a review."""
    empty = lambda schema: spark.createDataFrame([], schema)
    kind = dict(contracts.dtypes)["customer_id"]
    usage, lines, bad = empty(f"customer_id {kind}, period date, metric string, units {MONEY}"), empty(f"customer_id {kind}, period date, invoice_id string, description string, amount {MONEY}, quantity {MONEY}"), empty("file string, label string, reason string")
    for path in sorted(files):
        try:
            what, rows, failed = read_feed(spark, path, contracts)
        except ValueError as e:  # a required column is missing
            bad = bad.union(spark.createDataFrame([(path.rsplit("/", 1)[-1], None, str(e))], "file string, label string, reason string"))
            continue
        bad = bad.union(failed)
        if what == "usage":
            usage = usage.unionByName(rows)
        elif what == "invoices":
            lines = lines.unionByName(rows)
    return usage, lines, bad


def processor_lines(invoices: DataFrame) -> DataFrame:
    """invoices(invoice_id, customer_id, status, discount, lines: array of description, amount, quantity, usage_type, proration,
    start, end) of a payment processor, amounts in cents and times in epoch seconds, as invoice lines by month of their start.

    Charges count as positive, prorations with their sign; a discount of the whole invoice is a line of its own; void,
    draft and uncollectible invoices don't count.
    """
    live = invoices.where(~F.coalesce(F.col("status").isin(*UNCOUNTED), F.lit(False)))
    start = F.to_date(F.timestamp_seconds("x.start"))
    dollars = lambda c: (c.cast("decimal(18,0)") / 100).cast(MONEY)
    amount = F.when(F.col("x.proration"), F.col("x.amount")).otherwise(F.abs("x.amount"))
    label = F.when(F.col("x.usage_type") == "metered", F.concat(F.lit("Metered overage: "), F.coalesce("x.description", F.lit("")))).otherwise(F.col("x.description"))
    lines = live.select("*", F.explode("lines").alias("x")).select("customer_id", F.trunc(start, "month").alias("period"), "invoice_id", label.alias("description"), dollars(amount).alias("amount"), F.col("x.quantity").cast(MONEY).alias("quantity"), F.coalesce("x.proration", F.lit(False)).alias("proration"))
    first = F.array_min(F.transform("lines", lambda x: x["start"]))
    less = live.where("discount > 0").select("customer_id", F.trunc(F.to_date(F.timestamp_seconds(first)), "month").alias("period"), "invoice_id", F.lit("Invoice discount").alias("description"), dollars(-F.col("discount")).alias("amount"), F.lit(None).cast(MONEY).alias("quantity"), F.lit(False).alias("proration"))
    return lines.unionByName(less)


def processor_usage(summaries: DataFrame) -> DataFrame:
    """summaries(customer_id, usage_type, quantity, at in epoch seconds): metered units per customer and month."""
    return summaries.where("usage_type = 'metered'").groupBy("customer_id", F.trunc(F.to_date(F.timestamp_seconds("at")), "month").alias("period")).agg(F.sum("quantity").cast(MONEY).alias("units"))


def first_usage(rows: DataFrame) -> DataFrame:
    """A provider's usage for each customer and month: that of its first row, by seq."""
    return rows.groupBy("customer_id", "period").agg(F.min_by("units", "seq").alias("units"))


def read_aliased_csv(spark: SparkSession, path: str, required: dict[str, list[str]], optional: dict[str, list[str]], keep_missing: bool = True) -> DataFrame:
    """A CSV whose headers vary, with its columns named by role: the first alias that is there counts.

    Headers are compared in lower case with _ for all else; a missing required role raises ValueError with its aliases;
    optional roles that are missing are null, or left out; blank rows are dropped.
    """
    raw = spark.read.csv(path, header=True, encoding="UTF-8")
    key = lambda h: re.sub(r"[^a-z0-9]+", "_", h.lstrip("﻿").strip().lower()).strip("_")
    there = {}
    for c in raw.columns:
        there.setdefault(key(c), c)
    out = []
    for role, aliases in {**required, **optional}.items():
        found = next((there[key(a)] for a in aliases if key(a) in there), None)
        if found is None and role in required:
            raise ValueError(f"no column for {role}; one of {', '.join(aliases)} is needed")
        if found is None and not keep_missing:
            continue
        out.append((F.trim(F.col(f"`{found}`")) if found else F.lit(None).cast("string")).alias(role))
    rows = raw.select(*out)
    return rows.where(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in rows.columns]).isNotNull())


def prefer_uploaded(up_usage: DataFrame, up_invoices: DataFrame, own_usage: DataFrame, own_invoices: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Uploaded rows win per key; a key that was uploaded on one side only isn't completed from the connector."""
    taken = up_usage.select(keys).union(up_invoices.select(keys)).distinct()
    add = lambda up, own: up.unionByName(own.join(taken, keys, "left_anti"), allowMissingColumns=True)
    return add(up_usage, own_usage), add(up_invoices, own_invoices)
