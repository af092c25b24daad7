"""Driver contract: entry(), queries() and oracle_sql() on the smoke data."""

import os

import pytest
from muster_helpers import SMOKE_DIR

import __spark_entry__ as E
from muster.plans import catalog

pytestmark = pytest.mark.skipif(not os.path.isdir(SMOKE_DIR), reason="no driver test data")


def test_entry_runs(spark):
    df = E.entry(spark)
    assert "total_records" in df.columns
    assert len(df.collect()) > 0


def test_every_query_has_a_name_and_most_have_oracles():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 60


@pytest.mark.parametrize("name", ["list_sessions", "fk_audit", "delete_cascade", "access_decision",
                                  "ndjson_ingest", "token_bucket", "paginate_all"])
def test_query_builds_and_runs(spark, name):
    df = E.queries()[name](spark, SMOKE_DIR)
    df.write.format("noop").mode("overwrite").save()


def test_against_duckdb_oracle(spark):
    import duckdb
    from tools.oracle_check import TABLES, digest
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE_DIR}/{t}.parquet')")
    for name in ["list_officers", "validate_sessions", "unique_audit", "optimistic_update_report",
                 "bulk_insert", "token_user_join"]:
        sdf = E.queries()[name](spark, SMOKE_DIR)
        res = con.execute(E.oracle_sql()[name])
        s = digest(sdf.columns, [tuple(r) for r in sdf.collect()])[0]
        d = digest([x[0] for x in res.description], res.fetchall())[0]
        assert s == d, name


PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas",
                "FlatMapGroupsInPandasWithState", "MapInArrow")


def test_no_python_in_plans_outside_the_bucket_fold(spark):
    catalog.load_all()
    for name, fn in catalog.QUERIES.items():
        if name.startswith("token_bucket") or name == "outcome_classes":  # which counts its decisions
            continue
        plan = fn(spark, SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
        assert not any(n in plan for n in PYTHON_NODES), name
