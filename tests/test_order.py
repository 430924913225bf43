"""Places in a whole table, traces through a graph, and the state of competing terms, on small rows."""

import random
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from duecourse import staging
from duecourse.operators import provenance, terms


def test_places_of_a_whole_table(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, 1.0, 2.0, 3.5]), "clash") for k in range(200)] + [(7, 1.0, "clash")] * 3
    df = spark.createDataFrame(rows, "id long, score double, place string").repartition(5)
    got = sorted((r.place, r.score, r.id) for r in staging.with_place(df, F.desc("score"), F.col("id")).collect())
    want = sorted(((r[1] is None, -(r[1] or 0), r[0]) for r in rows))
    assert [p for p, *_ in got] == list(range(1, len(rows) + 1))
    assert [(s is None, -(s or 0), i) for _, s, i in got] == want
    assert staging.with_place(df.limit(0), F.col("id")).isEmpty()
    assert staging.with_place(df, F.col("id"), name="nth").columns == ["id", "score", "place", "nth"]


def test_traces_both_ways(spark):
    edges = spark.createDataFrame([("e", "r", "supports"), ("r", "d", "owed"), ("o", "d", "seen"), ("d", "f", "ground"), ("f", "a", "leads to"), ("a", "v", "brings"), ("f", "w", "brings"), ("x", "y", "supports")], "source string, target string, kind string")
    asked = spark.createDataFrame([("e",), ("d",), ("w",), ("gone",), (None,), ("e",)], "id string")
    got = {(r.asked, r.id, r.way): r.steps for r in provenance.trace(asked, edges).collect()}
    assert got == {
        ("e", "r", "down"): 1, ("e", "d", "down"): 2, ("e", "f", "down"): 3, ("e", "a", "down"): 4, ("e", "w", "down"): 4, ("e", "v", "down"): 5, ("d", "f", "down"): 1, ("d", "a", "down"): 2, ("d", "w", "down"): 2, ("d", "v", "down"): 3,
        ("d", "r", "up"): 1, ("d", "o", "up"): 1, ("d", "e", "up"): 2, ("w", "f", "up"): 1, ("w", "d", "up"): 2, ("w", "r", "up"): 3, ("w", "o", "up"): 3, ("w", "e", "up"): 4,
    }
    assert provenance.trace(asked.limit(0), edges).isEmpty()


def test_state_of_competing_terms(spark):
    a, b = date(2025, 1, 1), date(2025, 6, 1)
    D = Decimal
    rows = [("c", "rate", a, D(1), 0.9), ("c", "rate", b, D(2), 0.8), ("c", "end", a, D(1), 0.9), ("c", "end", a, D(2), 0.9), ("d", "rate", None, D(1), 0.95), ("d", "rate", None, D(1), 0.7), ("e", "rate", None, D(1), 0.95), ("e", "rate", None, D(2), 0.95)]
    scalar = spark.createDataFrame(rows, "customer_id string, term_type string, effective date, value decimal(18,2), confidence double")
    schedule = spark.createDataFrame(
        [("c", "m", "x", a, D(1), 0.9), ("c", "m", "x", a, D(2), 0.6), ("d", "m", "x", a, D(1), 0.9), ("d", "m", "x", b, D(2), 0.9), ("f", "m", "x", a, D(1), 0.5), ("f", "m", "x", None, D(3), 0.9)], "customer_id string, term_type string, scope string, effective date, value decimal(18,2), confidence double"
    )
    got = {r.customer_id: (r.conflicts, r.term_confidence) for r in terms.term_state(scalar, schedule).collect()}
    assert got == {
        "c": (["committed_minimum", "end"], {"rate": 0.8, "end": 0.0, "committed_minimum": 0.6}), "d": ([], {"rate": 0.7, "committed_minimum": 0.9}), "e": (["rate"], {"rate": 0.0}), "f": (["committed_minimum"], {"committed_minimum": 0.5}),
    }
