"""Change events: identities, replays, panels, and the fold of payment events; on batch or streaming frames alike."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


def money_payload(row: DataFrame, fields: list[str], lists: tuple[str, ...] = ()) -> DataFrame:
    """row with `payload`, a hash of its money-bearing fields alone, in order of name; arrays among them (lists) in order of value, so that neither other fields nor an array's order make another event."""
    parts = [F.sort_array(c).alias(c) if c in lists else F.col(c) for c in sorted([*fields, *lists])]
    return row.withColumn("payload", F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256))


def event_identity(changes: DataFrame) -> DataFrame:
    """Adds a content-derived event key, so that a replay has its first event's key."""
    parts = [c for c in ("account_id", "trigger", "customer_id", "period", "payload") if c != "account_id" or c in changes.columns]
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in parts])
    return changes.withColumn("event_key", F.substring(F.sha2(text, 256), 1, 32))


def dedupe_events(changes: DataFrame, late: str = "7 days") -> DataFrame:
    """One event per key. On a stream the watermark bounds the keys that are held."""
    rows = event_identity(changes)
    if rows.isStreaming:
        return rows.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["event_key"])
    first = rows.groupBy("event_key").agg(F.min_by(F.struct(*changes.columns), F.struct("received_at", "event_id")).alias("x"))
    return first.select("event_key", "x.*")


def event_panel(changes: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Events and their value per tumbling window and trigger."""
    rows = changes.withWatermark("received_at", late) if changes.isStreaming else changes
    return rows.groupBy(F.window("received_at", width).alias("w"), "trigger").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "trigger", "events", "value")


# A payment processor's events and what each makes of a fee.
FEE_STATES = {
    "invoice.paid": "paid", "invoice.payment_succeeded": "paid", "invoice.payment_failed": "payment_failed", "invoice.voided": "uncollectible", "invoice.marked_uncollectible": "uncollectible",
    "charge.dispute.created": "disputed", "charge.dispute.closed/lost": "dispute_lost", "charge.dispute.closed/won": "paid", "credit_note.created": "adjusted",
}


def fee_status(events: DataFrame, states: dict[str, str]) -> DataFrame:
    """The latest status per customer from payment events, by a map of event types."""
    table = F.create_map(*[F.lit(x) for kv in states.items() for x in kv])
    rows = events.withColumn("status", F.element_at(table, F.col("trigger"))).where("status is not null")
    return rows.groupBy("customer_id").agg(F.max_by("status", F.struct("received_at", "event_id")).alias("status"), F.count("*").alias("events"))


# Triggers that concern one month; any other concerns all months of the customer.
PERIOD_TRIGGERS = ["new_invoice", "new_usage", "new_billing_period", "new_payment", "new_credit_refund"]


def impacted_scope(changes: DataFrame, keys: DataFrame) -> DataFrame:
    """changes(customer_id, trigger, period as yyyy-MM) to the customer-months on file that they touch.

    A change of the contract touches every month of its customer, a change within a month that month alone. Customers
    without any month on file are unresolved, with a null month. Without a trigger column all changes are of contracts.
    """
    rows = changes if "trigger" in changes.columns else changes.withColumns({"trigger": F.lit("pricing_change"), "period": F.lit(None).cast("string")})
    within = F.col("trigger").isin(PERIOD_TRIGGERS)
    per = rows.groupBy("customer_id").agg(F.max((~within).cast("int")).alias("every"))
    months = rows.where(within).select("customer_id", F.col("period").alias("month")).distinct().withColumn("named", F.lit(True))
    on_file = keys.select("customer_id", "period").distinct()
    held = per.join(on_file.withColumn("there", F.lit(True)), "customer_id", "left")
    month = F.col("period").cast("string") if dict(keys.dtypes)["period"] == "string" else F.date_format("period", "yyyy-MM")
    held = held.withColumn("month", month).join(months, ["customer_id", "month"], "left")
    return held.where((F.col("every") == 1) | F.col("named") | F.col("there").isNull()).select("customer_id", "period")


def start_assurance(stream: DataFrame, reevaluate, checkpoint: str) -> StreamingQuery:
    """Runs reevaluate(batch, batch_id) on each micro-batch of deduplicated changes, until what is there now is done."""
    return dedupe_events(stream).writeStream.foreachBatch(reevaluate).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# The terms whose change reprices an agreement.
PRICING = ["minimum", "included_units", "overage_rate", "escalator_pct", "escalator_date", "seat_price", "committed_seats", "discount_list"]


def contract_changes(old: DataFrame, new: DataFrame, today: str) -> DataFrame:
    """new contracts with the trigger that their difference from the old ones of the same customer gives; the first that holds counts.

    Unchanged contracts don't appear.
    """
    terms = [c for c in new.columns if c != "customer_id"]
    priced = [c for c in PRICING if c in terms]
    was = old.select("customer_id", F.struct(*terms).alias("was"))
    rows = new.join(was, "customer_id", "left")
    ended, before = F.col("term_end"), F.col("was.term_end")
    other = lambda names: F.exists(F.array(F.lit(False), *[~F.col(c).eqNullSafe(F.col(f"was.{c}")) for c in names]), lambda x: x)
    trigger = (
        F.when(F.col("was").isNull(), "new_agreement")
        .when(ended < F.lit(today).cast("date"), "term_expiration")
        .when((ended > before) | (ended.isNotNull() & before.isNull()), "contract_renewal")
        .when(other(priced), "pricing_change")
        .when(other([c for c in terms if c not in priced]), "agreement_amendment")
    )
    return rows.select("customer_id", trigger.alias("trigger")).where("trigger is not null")


def invoice_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """new invoices (customer_id, period, credits, ...) against the old ones of the same month: a row per trigger."""
    money = [c for c in new.columns if c not in ("customer_id", "period")]
    rows = new.join(old.select("customer_id", "period", F.struct(*money).alias("was")), ["customer_id", "period"], "left")
    fresh = F.col("was").isNull()
    changed = ~F.struct(*money).eqNullSafe(F.col("was"))
    credited = ~F.col("credits").eqNullSafe(F.col("was.credits")) & (F.coalesce("credits", F.lit(0)) != 0)
    triggers = F.array_compact(F.array(F.when(fresh | changed, "new_invoice"), F.when(fresh, "new_billing_period"), F.when(credited, "new_credit_refund")))
    return rows.select("customer_id", "period", F.explode(triggers).alias("trigger"))


def withdraw_stale(store: DataFrame, scope: DataFrame, fresh: DataFrame) -> DataFrame:
    """store with the open findings of fully covered months (scope) that came out no more rejected in the system's name; all others stay."""
    rows = store.join(scope.select("customer_id", "period").distinct().withColumn("covered", F.lit(True)), ["customer_id", "period"], "left")
    rows = rows.join(fresh.select("finding_id").distinct().withColumn("again", F.lit(True)), "finding_id", "left")
    stale = F.col("covered").isNotNull() & F.col("again").isNull() & (F.col("status") == "open")
    return rows.withColumns({"status": F.when(stale, "rejected").otherwise(F.col("status")), "withdrawn_by": F.when(stale, "system").otherwise(F.col("withdrawn_by"))}).select(store.columns)


FEE = "0.20"
# The statuses of a finding on which money may be realized, and the basis that closes a case at any amount.
REALIZABLE = ["approved", "invoiced", "disputed", "recovered"]
SETTLEMENT = "settlement"
#: For how many days a stream knows event ids, and holds the net of a case that has no events.
LIFETIME = 400

_TAKEN = "event_id long, case_id long, accepted boolean, reason string, net long, part long, settled boolean"


class Intake:
    """The net of one case, in cents, as its events are taken in order."""

    def __init__(self, net: int = 0):
        self.net = net

    def take(self, kind: str, cents: int | None, status: str | None) -> tuple[bool, str | None, int, int]:
        """Whether an event is taken, else why not; the net after it, and its own part of it."""
        if status not in REALIZABLE:
            return False, "finding status", self.net, 0
        if cents is None or cents <= 0:
            return False, "no amount", self.net, 0
        part = -cents if kind == "reversal" else cents
        if self.net + part < 0:
            return False, "exceeds what is left", self.net, 0
        self.net += part
        return True, None, self.net, part


def _due(events: DataFrame, cases: DataFrame | None) -> DataFrame:
    """events with cents, and their case's status and requested amount; without cases all are approved and none closes by amount."""
    rows = events.select("event_id", "case_id", "kind", (F.col("amount").cast("decimal(18,2)") * 100).cast("long").alias("cents"), (F.col("basis") if "basis" in events.columns else F.lit(None).cast("string")).alias("basis"), "ts")
    if cases is None:
        return rows.withColumns({"status": F.lit(REALIZABLE[0]), "requested": F.lit(None).cast("decimal(18,2)")})
    return rows.join(cases.select("case_id", "status", F.col("requested").cast("decimal(18,2)").alias("requested")), "case_id", "left")


def _fees(taken: DataFrame) -> DataFrame:
    """What an intake gives, from its rows in cents: the fee on the event's part, and whether the case is closed after it."""
    money = lambda c: (F.col(c).cast("decimal(20,0)") / 100).cast("decimal(18,2)")
    closed = F.col("accepted") & (F.coalesce("settled", F.lit(False)) | F.coalesce(money("net") >= F.col("requested"), F.lit(False)))
    fee = F.round(money("part") * F.lit(FEE).cast("decimal(3,2)"), 2).cast("decimal(18,2)")
    return taken.select("event_id", "case_id", "accepted", "reason", money("net").alias("net"), fee.alias("fee"), closed.alias("closed"))


def realization_intake(events: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Takes events(event_id, case_id, kind, amount, ts, perhaps basis) of each case in order of ts and event_id.

    An id counts once over all cases, its first event by ts; others are no-ops without a row. An event is taken on a case
    of cases(case_id, status, requested) in a status on which money may be realized, with an amount above 0; a reversal
    may not exceed what is left. Each row says whether its event was taken, else why not, the net after it, the fee on
    its part, and whether it closes the case: by reaching what was requested, or as a settlement.

    A rejected event doesn't count for those after it, so a case is taken event by event; its rows come sorted and stream
    through, and a task holds one net at a time. A null case_id is a case without a finding.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        case, held = None, Intake()
        for batch in batches:
            rows = []
            for event_id, case_id, kind, cents, basis, status, requested in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if case_id != case:
                    case, held = case_id, Intake()
                taken, reason, net, part = held.take(kind, cents, status)
                rows.append((event_id, case_id, taken, reason, net, part, basis == SETTLEMENT and kind != "reversal", requested))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.decimal128(18, 2))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 8, kinds, strict=True)], [*[f.split()[0] for f in _TAKEN.split(", ")], "requested"])

    rest = [c for c in events.columns if c not in ("event_id", "ts")]
    once = events.groupBy("event_id").agg(F.min_by(F.struct("ts", *rest), F.struct("ts", "case_id")).alias("e")).select("event_id", "e.*")
    rows = _due(once, cases).repartition("case_id").sortWithinPartitions("case_id", "ts", "event_id")
    return _fees(rows.select("event_id", "case_id", "kind", "cents", "basis", "status", "requested").mapInArrow(run, f"{_TAKEN}, requested decimal(18,2)"))


class _CaseProcessor(StatefulProcessor):
    """The intake of one case on a stream: its net and the time of its last event are a value state, which a timer clears
    when nothing has come for the lifetime."""

    def __init__(self, lifetime_ms: int):
        self.lifetime_ms = lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("net", "cents long, last_ms long")

    def handleInputRows(self, key, rows, timer_values):  # noqa: N802
        net, last = self.state.get() if self.state.exists() else (0, None)
        held = Intake(net)
        for r in sorted(rows, key=lambda r: (r.ts_ms, r.event_id)):
            taken, reason, net, part = held.take(r.kind, r.cents, r.status)
            if last is None:
                self.handle.registerTimer(r.ts_ms + self.lifetime_ms)
            last = max(last or 0, r.ts_ms)
            yield Row(event_id=r.event_id, case_id=key[0], accepted=taken, reason=reason, net=net, part=part, settled=r.basis == SETTLEMENT and r.kind != "reversal", requested=r.requested)
        self.state.update((held.net, last))

    def handleExpiredTimer(self, key, timer_values, expired):  # noqa: N802
        net, last = self.state.get()
        if last + self.lifetime_ms > expired.get_expiry_time_in_ms():
            self.handle.registerTimer(last + self.lifetime_ms)
        else:
            self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def intake_stream(stream: DataFrame, cases: DataFrame | None = None, days: int = LIFETIME) -> DataFrame:
    """realization_intake() on a stream: what a micro-batch brings to a case is taken in order of ts and event_id.

    Ids are known over all cases for `days` of event time, by the watermark; a case's net is held for as long without an
    event, by a timer. Cases are a static table. Needs the state store that keeps state on disk (RocksDB).
    """
    once = stream.withWatermark("ts", f"{days} days").dropDuplicatesWithinWatermark(["event_id"])
    rows = _due(once, cases).withColumn("ts_ms", F.unix_millis("ts"))
    return _fees(rows.groupBy("case_id").transformWithState(_CaseProcessor(days * 86_400_000), f"{_TAKEN}, requested decimal(18,2)", "Append", "EventTime"))
