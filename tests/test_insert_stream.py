"""Bulk insert as a stream: equal to the batch form, and a batch that runs again inserts nothing twice."""

from decimal import Decimal

import pytest

from muster.operators import ingest as I
from muster.plans.standins import AS_OF
from muster.schemas import SCHEMAS
from muster.streaming.insert import insert_batch, read_created, read_report, run_insert_stream

ROW = "seq long, id string, officer_id string, session_id string, status string, credited_hours decimal(14,2)"


def row(seq, officer, session, status="attended", hours=1):
    return (seq, f"n{seq}", officer, session, status, Decimal(hours))


#: three files; a key held by the base, one repeated within a file and one repeated over files, a hot key
FILES = [
    [row(1, "o1", "s1"), row(2, "o1", "s2"), row(3, "o1", "s2"), row(4, "o2", "s1", "maybe"), row(5, "none", "s1"), row(6, "o2", "s2", hours=1000)],
    [row(10, "o1", "s2"), row(11, "o2", "s1"), row(12, "o2", "s1"), row(13, None, "s1"), *[row(20 + i, "o3", "s1") for i in range(30)]],
    [row(100, "o2", "s2"), row(101, "o3", "s1"), row(102, "o2", "s1"), (103, "n2", "o3", "s2", "absent", Decimal(0))],
]


@pytest.fixture(scope="module")
def tables(spark):
    parents = {"officers": spark.createDataFrame([("o1",), ("o2",), ("o3",)], "id string"),
               "sessions": spark.createDataFrame([("s1",), ("s2",)], "id string")}
    base = spark.createDataFrame([("b1", "o1", "s1", "attended", None, None, 1)], "id string, officer_id string, session_id string, "
                                 "status string, credited_hours decimal(4,1), created_at timestamp_ntz, version int") \
        .select(*[f.name for f in SCHEMAS["attendance"].fields])
    return base, parents


def content(df):
    return sorted(map(repr, df.collect()))


def outcomes(df):
    return {r.seq: r.outcome for r in df.collect()}


def run(spark, tables, folder, files=None):
    base, parents = tables
    for f in FILES if files is None else files:
        spark.createDataFrame(f, ROW).coalesce(1).write.mode("append").parquet(f"{folder}/rows")
    rows = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{folder}/rows")
    q = run_insert_stream(rows, base, "attendance", AS_OF, f"{folder}/out", lambda: parents)
    q.awaitTermination()
    assert q.exception() is None
    return f"{folder}/out"


def test_equals_one_bulk_insert_and_a_replay_adds_nothing(spark, tables, tmp_path):
    base, parents = tables
    out = run(spark, tables, str(tmp_path))
    new, report = I.bulk_insert(base, spark.createDataFrame([r for f in FILES for r in f], ROW), "attendance", AS_OF, parents=parents)
    created, said = read_created(base, out), read_report(spark, out).drop("batch_id")
    assert content(base.unionByName(created)) == content(new)
    assert content(said.select(*sorted(said.columns))) == content(report.select(*sorted(report.columns)))
    got = outcomes(said)
    assert got[1] == got[3] == got[10] == got[12] == got[21] == got[101] == got[103] == "duplicate"
    assert got[2] == got[11] == got[20] == got[100] == "created"
    assert (got[4], got[5], got[6], got[13]) == ("invalid", "fk_violation", "numeric_overflow", "invalid")
    # each batch once more, in any order: its folders are written again with the same rows
    before, reported = content(created), content(said)
    for batch in (1, 0, 2, 2):
        landed = spark.createDataFrame(FILES[batch], ROW)
        insert_batch(landed, batch, base, "attendance", AS_OF, out, lambda: parents)
        assert content(read_created(base, out)) == before
        assert content(read_report(spark, out).drop("batch_id")) == reported


def test_a_restart_goes_on_where_it_stopped(spark, tables, tmp_path):
    base, _ = tables
    out = run(spark, tables, str(tmp_path), FILES[:1])
    n = read_created(base, out).count()
    assert n == 1
    out = run(spark, tables, str(tmp_path), FILES[1:])
    assert outcomes(read_report(spark, out))[10] == "duplicate"
    assert read_created(base, out).count() == 4
    assert read_report(spark, out).select("batch_id").distinct().count() == 3


def test_a_batch_without_created_rows(spark, tables, tmp_path):
    base, _ = tables
    out = run(spark, tables, str(tmp_path), [[row(1, "o1", "s1")], [row(2, "o1", "s1"), row(3, "o2", "s2")]])
    assert outcomes(read_report(spark, out)) == {1: "duplicate", 2: "duplicate", 3: "created"}
    assert read_created(base, out).count() == 1


def test_a_pinned_batch_is_judged_once(spark, tables):
    """Created rows and report come from the stored judgement, without its joins."""
    base, parents = tables
    batch = spark.createDataFrame([r for f in FILES for r in f], ROW)
    got = I.insert_rows(base, batch, "attendance", AS_OF, parents=parents, pin_batch=True)
    want = I.insert_rows(base, batch, "attendance", AS_OF, parents=parents)
    for g, w in zip(got, want):
        assert content(g) == content(w)
        plan = g._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan


def test_keys_of_the_base_are_not_grouped(spark, tables):
    """The base's keys meet the batch's as they are; only the batch is grouped by key."""
    base, parents = tables
    batch = spark.createDataFrame(FILES[0], ROW)
    _, report = I.insert_rows(base.repartition(3), batch, "attendance", AS_OF, parents=parents)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2  # id; officer and session


def test_a_report_checks_the_batch_once(spark, tables):
    """The numerics of a row are brought to their scale once, not again for the first row of every key."""
    base, parents = tables
    batch = spark.createDataFrame([r for f in FILES for r in f], ROW)
    _, report = I.insert_rows(base.repartition(3), batch.repartition(3), "attendance", AS_OF, parents=parents)
    got = outcomes(report)
    assert got[2] == got[11] == got[20] == "created" and got[3] == got[49] == got[101] == "duplicate"
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("raise_error") == 1  # the check of seq
