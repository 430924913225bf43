"""Change events on streams against the same in batch."""

import shutil
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Row


from duecourse.operators import rules
from duecourse.sources import sinks
from duecourse.streaming import assurance

CHANGE = "event_id long, trigger string, customer_id long, period string, payload string, value decimal(18,2), received_at timestamp"


def changes():
    start = datetime(2026, 6, 1)
    rows = [(i, "new_invoice" if i % 3 else "new_usage", i % 7, "2026-06", str(i % 11), Decimal(i), start + timedelta(hours=i)) for i in range(200)]
    return rows + [(500 + i, *rows[i][1:6], rows[i][6] + timedelta(minutes=1)) for i in range(0, 50, 5)]  # replays


def files(spark, folder, rows, schema, parts=4):
    """The rows as parquet files, one for each micro-batch."""
    for k in range(parts):
        part = folder / f"part{k}"
        spark.createDataFrame(rows[k::parts] if schema != CHANGE else rows[len(rows) * k // parts : len(rows) * (k + 1) // parts], schema).coalesce(1).write.parquet(str(part))
        (folder / "in").mkdir(exist_ok=True)
        for f in part.glob("*.parquet"):
            shutil.copy(f, folder / "in" / f"{k}-{f.name}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def test_replays_are_dropped_on_a_stream_as_in_batch(spark, tmp_path):
    rows = changes()
    stream = files(spark, tmp_path, rows, CHANGE)
    seen = []
    query = assurance.start_assurance(stream, lambda batch, _: seen.extend(r.event_key for r in batch.collect()), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    batch = assurance.dedupe_events(spark.createDataFrame(rows, CHANGE))
    assert sorted(seen) == sorted(r.event_key for r in batch.collect()) and len(seen) == len(set(seen)) < len(rows)


def test_panel_on_a_stream_as_in_batch(spark, tmp_path):
    rows = changes()
    stream = files(spark, tmp_path, rows, CHANGE)
    query = assurance.event_panel(stream).writeStream.format("memory").queryName("panel").outputMode("complete").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = assurance.event_panel(spark.createDataFrame(rows, CHANGE)).collect()
    assert sorted(map(tuple, spark.table("panel").collect())) == sorted(map(tuple, want))


EVENT = "event_id long, case_id long, kind string, amount decimal(18,2), ts timestamp"


def intake(rows, cases):
    """Plain intake, an event at a time."""
    net, seen, out = {}, set(), {}
    for e, c, kind, amount, basis, ts in sorted(rows, key=lambda r: (r[5], r[0])):
        if e in seen:
            continue
        seen.add(e)
        status, requested = cases.get(c, (None, None))
        part = -amount if kind == "reversal" else amount
        reason = "finding status" if status not in assurance.REALIZABLE else "no amount" if amount is None or amount <= 0 else "exceeds what is left" if net.get(c, 0) + part < 0 else None
        part = Decimal(0) if reason else part
        net[c] = net.get(c, Decimal(0)) + part
        fee = (part * Decimal("0.20")).quantize(Decimal("0.01"), ROUND_HALF_UP)
        out[e] = (c, not reason, reason, net[c], fee, not reason and ((basis == "settlement" and kind != "reversal") or net[c] >= requested))
    return out


def test_intake_on_a_stream_as_in_batch(spark, tmp_path):
    start = datetime(2026, 1, 1)
    kind = EVENT.replace("ts timestamp", "basis string, ts timestamp")
    rows = [(i, i % 5 if i % 19 else 77, "reversal" if i % 3 == 0 else "realization", Decimal(i % 17 * 37 + 3) / 100 if i % 23 else Decimal(0), "settlement" if i % 11 == 0 else None, start + timedelta(hours=i)) for i in range(120)]
    rows += [(rows[k][0], (rows[k][1] + 1) % 5, *rows[k][2:5], rows[k][5] + timedelta(minutes=k)) for k in (3, 7, 50, 101)]  # the same id again, in another case
    rows.sort(key=lambda r: r[5])
    held = {0: ("approved", Decimal(9)), 1: ("invoiced", Decimal(20)), 2: ("open", Decimal(1)), 3: ("recovered", Decimal("30.5")), 4: ("disputed", Decimal(1000))}
    cases = spark.createDataFrame([(k, *v) for k, v in held.items()], "case_id long, status string, requested decimal(18,2)")
    want = intake(rows, held)
    assert {v[2] for v in want.values()} == {None, "finding status", "no amount", "exceeds what is left"} and {v[5] for v in want.values()} == {True, False}
    line = lambda r: (r.case_id, r.accepted, r.reason, r.net, r.fee, r.closed)
    got = assurance.realization_intake(spark.createDataFrame(rows, kind), cases).collect()
    assert len(got) == len(want) and {r.event_id: line(r) for r in got} == want
    ordered = [rows[k * 31 : (k + 1) * 31] for k in range(4)]
    for k, part in enumerate(ordered):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / f"p{k}").glob("*.parquet"):
            shutil.copy(f, tmp_path / "in" / f"{k}-{f.name}")
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = assurance.intake_stream(stream, cases).writeStream.format("memory").queryName("intake").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(100)
        query.stop()
    finally:
        spark.conf.unset(store)
    out = spark.table("intake").collect()
    assert len(out) == len(want) and {r.event_id: line(r) for r in out} == want


def test_scoped_reevaluation(spark):
    """A change's months are judged again, and what came out no more is withdrawn, but for what a human decided."""
    store = spark.createDataFrame([("F-1", 1, "2026-06", 5.0, "open", None, "2020"), ("F-2", 1, "2026-06", 5.0, "approved", None, "2020"), ("F-3", 2, "2026-06", 5.0, "open", None, "2020"), ("F-4", 1, "2026-06", 7.0, "open", None, "2020")], "finding_id string, customer_id long, period string, amount double, status string, withdrawn_by string, created_at string")
    keys = spark.createDataFrame([(1, "2026-06"), (2, "2026-06")], "customer_id long, period string")
    scope = assurance.impacted_scope(spark.createDataFrame([(1,), (9,)], "customer_id long"), keys)
    assert {tuple(r) for r in scope.collect()} == {(1, "2026-06"), (9, None)}
    fresh = spark.createDataFrame([("F-4", 1, "2026-06", 8.0, "open", None, "2026")], store.schema)
    after = assurance.withdraw_stale(sinks.upsert_findings(store, fresh).select(store.columns), scope.where("period is not null"), fresh)
    assert {r.finding_id: (r.status, r.withdrawn_by, r.amount, r.created_at) for r in after.collect()} == {"F-1": ("rejected", "system", 5.0, "2020"), "F-2": ("approved", None, 5.0, "2020"), "F-3": ("open", None, 5.0, "2020"), "F-4": ("open", None, 8.0, "2020")}
    again = sinks.upsert_findings(after, store.where("finding_id = 'F-1'"))
    assert again.where("finding_id = 'F-1'").first().status == "open"


def test_holds_block_customers_or_all(spark):
    from duecourse.operators.identity import apply_holds

    keys = spark.createDataFrame([(1,), (2,), (3,)], "customer_id long")
    some = spark.createDataFrame([("customers", [2])], "scope string, customers array<long>")
    free, blocked = apply_holds(keys, some)
    assert [r[0] for r in free.collect()] == [1, 3] and [r[0] for r in blocked.collect()] == [2]
    every = some.union(spark.createDataFrame([("account", None)], some.schema))
    assert apply_holds(keys, every)[0].isEmpty() and apply_holds(keys, some.limit(0))[1].isEmpty()


def test_by_recoverable(spark):
    f = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 3.0), ("c", "x", 3.0), ("d", "y", 2.0)], "finding_id string, period string, amount double")
    assert {r.finding_id: r.place for r in rules.by_recoverable(f).collect()} == {"b": 1, "c": 2, "d": 3, "a": 4}


def test_payloads_hash_money_alone(spark):
    rows = spark.createDataFrame([(1, 5, [2, 1], "x"), (2, 5, [1, 2], "y"), (3, 6, [1, 2], "x"), (4, None, None, "x")], "id int, amount int, items array<int>, note string")
    got = {r.id: r.payload for r in assurance.money_payload(rows, ["amount"], ("items",)).collect()}
    assert got[1] == got[2] != got[3] and got[4] and len(set(got.values())) == 3


def test_a_case_without_events_is_forgotten():
    class Held:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    class Handle:
        def __init__(self):
            self.timers, self.state = [], Held()

        def getValueState(self, *_):  # noqa: N802
            return self.state

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

    class Expired:
        def __init__(self, at):
            self.at = at

        def get_expiry_time_in_ms(self):
            return self.at

    event = lambda k, ms: Row(event_id=k, kind="realization", cents=100, status="approved", basis=None, requested=None, ts_ms=ms)
    handle, case = Handle(), assurance._CaseProcessor(1000)
    case.init(handle)
    assert [r.net for r in case.handleInputRows((1,), iter([event(1, 50), event(2, 10)]), None)] == [100, 200]
    assert handle.timers == [1010] and handle.state.value == (200, 50)
    assert list(case.handleExpiredTimer((1,), None, Expired(1010))) == [] and handle.timers == [1010, 1050] and handle.state.exists()
    case.handleExpiredTimer((1,), None, Expired(1050))
    assert not handle.state.exists()
