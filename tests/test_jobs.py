"""Histories of import jobs against a walk of the log."""

import datetime as dt
import random

import pytest

from muster.operators.jobs import import_job_history

T0 = dt.datetime(2024, 1, 1)
LOG = "job_id string, seq long, at timestamp_ntz, status string"
NEXT = {None: ("pending",), "pending": ("running",), "running": ("completed", "failed"), "failed": ("running",), "completed": ()}


def walk(log):
    state, attempt, out = {}, {}, {}
    for job, seq, at, status in sorted((r for r in log if r[0] is not None and r[2] is not None), key=lambda r: (r[2], r[1])):
        legal = status in NEXT[state.get(job)]
        if legal:
            state[job] = status
            attempt[job] = attempt.get(job, 0) + (status == "running")
        out[seq] = ("applied" if legal else "illegal", state.get(job), attempt.get(job, 0))
    return out | {r[1]: ("illegal", None, None) for r in log if r[0] is None or r[2] is None}


def got(df):
    return {r.seq: (r.outcome, r.state, r.attempt) for r in df.collect()}


@pytest.mark.parametrize("seed,bucket", [(1, 86_400), (2, 3_600), (3, 10**9)])
def test_equals_a_walk(spark, seed, bucket):
    rnd = random.Random(seed)
    kinds = ["pending", "running", "running", "failed", "failed", "completed", "cancelled", None]
    jobs = ["hot"] * 5 + list("abcdefgh") + [None]
    log = [(rnd.choice(jobs), i, rnd.choice([None] + [T0 + dt.timedelta(hours=rnd.randint(0, 60))] * 30),
            rnd.choices(kinds, [2, 6, 6, 6, 6, 1, 1, 1])[0]) for i in range(900)]
    log += [("hot", 5000, T0 - dt.timedelta(1), "pending"), ("x", 5001, T0, "running"), ("x", 5002, T0, "pending"),
            ("x", 5003, T0, "pending"), ("x", 5004, T0, "failed"), ("x", 5005, T0, "running")]
    found = got(import_job_history(spark.createDataFrame(log, LOG), bucket_seconds=bucket))
    assert found == walk(log)
    assert found[5001] == ("illegal", None, 0) and found[5004] == ("illegal", "pending", 0) and found[5005] == ("applied", "running", 1)


def test_retries_are_numbered_and_completed_is_final(spark):
    kinds = ["pending", "running", "failed", "running", "failed", "failed", "running", "completed", "running", "completed", "pending"]
    log = [("j", i, T0 + dt.timedelta(hours=i * 20), s) for i, s in enumerate(kinds)]
    found = got(import_job_history(spark.createDataFrame(log, LOG)))
    assert [found[i][2] for i in range(11)] == [0, 1, 1, 2, 2, 2, 3, 3, 3, 3, 3]
    assert [found[i][0] for i in (5, 8, 9, 10)] == ["illegal"] * 4 and found[10][1] == "completed"


def test_empty_log_and_no_group_of_a_whole_job(spark):
    none = spark.createDataFrame([], LOG)
    assert import_job_history(none).collect() == []
    plan = import_job_history(none)._jdf.queryExecution().optimizedPlan().toString()
    # windows over events are by job and bucket; windows by job alone are over one row per bucket
    for line in plan.splitlines():
        if "Window [" in line and "], [_b" in line:
            assert "_row" not in line
