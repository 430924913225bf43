"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from duecourse.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", catalog.ORACLES)
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    sql = duck.sql(catalog.ORACLES[name])
    columns = sorted(sql.columns)
    assert sorted(df.columns) == columns
    want = sorted((tuple(r[sql.columns.index(c)] for c in columns) for r in sql.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == want


@pytest.mark.parametrize("name", ["run_book", "reviews", "missing_side_review", "rank_cases", "evaluate_rules", "case_ledger"])
def test_plans_stay_in_the_engine(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
