"""Stores with manifests: replays, untouched partitions, failed and competing commits."""

import pytest

from duecourse.sources import sinks, snapshots
from duecourse.streaming import assurance

SCHEMA = "finding_id string, period string, amount double, status string, withdrawn_by string, created_at string"


def rows(spark, *given):
    return spark.createDataFrame([(f, p, a, "open", None, "2026") for f, p, a in given], SCHEMA)


def held(spark, root):
    return {r.finding_id: (r.period, r.amount, r.status) for r in snapshots.read(spark, root, SCHEMA).collect()}


def upsert(fresh, root, batch):
    return snapshots.upsert(fresh, root, SCHEMA, "period", lambda s, f: sinks.upsert_findings(s, f).select(s.columns), batch)


def test_commits_replays_and_untouched_partitions(spark, tmp_path):
    root = str(tmp_path / "store")
    assert held(spark, root) == {}
    assert upsert(rows(spark, ("a", "2026-05", 1.0), ("b", "2026-06", 2.0)), root, "0")
    first = snapshots.manifest(spark, root)["partitions"]
    assert upsert(rows(spark, ("b", "2026-06", 3.0), ("c", "2026-06", 4.0)), root, "1")
    second = snapshots.manifest(spark, root)["partitions"]
    assert first["2026-05"] == second["2026-05"] and first["2026-06"] != second["2026-06"]
    want = {"a": ("2026-05", 1.0, "open"), "b": ("2026-06", 3.0, "open"), "c": ("2026-06", 4.0, "open")}
    assert held(spark, root) == want
    assert not upsert(rows(spark, ("b", "2026-06", 99.0)), root, "1") and held(spark, root) == want  # the batch again
    assert not upsert(rows(spark), root, "1") and upsert(rows(spark), root, "2") and held(spark, root) == want
    assert snapshots.commit(rows(spark), root, "period", ["2026-05"], "3") and set(held(spark, root)) == {"b", "c"}


def test_a_failed_commit_is_never_seen(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    upsert(rows(spark, ("a", "2026-05", 1.0)), root, "0")
    with pytest.raises(ValueError, match="aren't named"):
        snapshots.commit(rows(spark, ("a", "2026-06", 5.0)), root, "period", ["2026-05"], "1")
    assert held(spark, root) == {"a": ("2026-05", 1.0, "open")}
    stale = snapshots.manifest(spark, root)
    upsert(rows(spark, ("b", "2026-05", 2.0)), root, "2")
    monkeypatch.setattr(snapshots, "manifest", lambda *_: stale)  # another run that read before
    with pytest.raises(snapshots.ConflictError):
        snapshots.commit(rows(spark, ("z", "2026-05", 9.0)), root, "period", ["2026-05"], "3")
    monkeypatch.undo()
    assert set(held(spark, root)) == {"a", "b"}


def test_micro_batches_commit_once(spark, tmp_path):
    root, folder = str(tmp_path / "store"), tmp_path / "in"
    changes = "event_id long, trigger string, customer_id long, period string, payload string, value decimal(18,2), received_at timestamp"
    spark.sql("select 1L event_id, 'new_invoice' trigger, 7L customer_id, '2026-06' period, 'x' payload, 5.00BD value, timestamp'2026-06-01' received_at union all select 2L, 'new_usage', 8L, '2026-07', 'y', 6.00BD, timestamp'2026-06-02'").select("*").coalesce(1).write.parquet(str(folder))
    done = []

    def judge(batch, batch_id):
        fresh = batch.selectExpr("concat('F-', customer_id) as finding_id", "period", "cast(value as double) as amount", "'open' as status", "cast(null as string) as withdrawn_by", "'2026' as created_at")
        done.append(upsert(fresh, root, str(batch_id)))

    for k in range(2):  # a second query without the first one's checkpoint sends the same batch again
        stream = spark.readStream.schema(changes).parquet(str(folder))
        assert assurance.start_assurance(stream, judge, str(tmp_path / f"c{k}")).awaitTermination(120)
    half = len(done) // 2
    assert half and all(done[:half]) and not any(done[half:]) and held(spark, root) == {"F-7": ("2026-06", 5.0, "open"), "F-8": ("2026-07", 6.0, "open")}
