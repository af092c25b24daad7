"""Access decisions on streams: late tokens, outer rows after the interval, replays; equal to the batch form."""

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from muster.functions.tokens import token_hash
from muster.operators.access import access_asof
from muster.streaming.access import read_decisions, run_access_stream

T0 = dt.datetime(2024, 1, 1)
REQ = "id int, auth_header string, guarded boolean, at timestamp_ntz"
TOK = "token string, user_id string, scope string, issued_at timestamp_ntz, expiry timestamp_ntz"


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def token(letter, user, hour, scope="authentication"):
    return (letter * 26, user, scope, at(hour), at(hour + 24))


def asks(i, letter, hour, guarded=True):
    return (i, "Bearer " + letter * 26, guarded, at(hour))


#: three deliveries of (requests, tokens); in the second a token arrives after a request that presents it
DELIVERIES = [
    ([asks(1, "A", 1), asks(2, "Z", 2), asks(3, "B", 3), (4, None, True, at(1)), (5, None, False, at(2)), (6, "Basic x", False, at(2)),
      (7, "Bearer " + "A" * 26, True, None)],
     [token("A", "u1", 0), token("C", "u1", 1, "activation")]),
    ([asks(8, "A", 23.9), asks(9, "A", 24.5), asks(10, "C", 4)], [token("B", "u2", 2.9), token("D", "u1", 24)]),
    ([asks(11, "D", 30), asks(12, "B", 26.8), asks(13, "B", 26.95), asks(14, "D", 48)], [token("E", "u3", 29)]),
    ([asks(99, "!", 24 * 400)], [token("?", "nobody", 24 * 400)]),  # moves both watermarks on
]


@pytest.fixture(scope="module")
def versions(spark):
    return spark.createDataFrame([("u1", at(-5), False), ("u1", at(3), True), ("u2", at(0), None), ("u2", at(26.9), True)],
                                 "user_id string, valid_from timestamp_ntz, activated boolean")


def with_hash(df):
    return df.withColumn("hash", token_hash("token")).drop("token")


class Run:
    def __init__(self, spark, versions, folder):
        self.spark, self.versions, self.folder = spark, versions, folder

    def deliver(self, requests, tokens):
        self.spark.createDataFrame(requests, REQ).coalesce(1).write.mode("append").parquet(f"{self.folder}/requests")
        with_hash(self.spark.createDataFrame(tokens, TOK)).coalesce(1).write.mode("append").parquet(f"{self.folder}/tokens")

    def go(self):
        r = self.spark.readStream.schema(REQ).parquet(f"{self.folder}/requests")
        schema = with_hash(self.spark.createDataFrame([], TOK)).schema
        k = self.spark.readStream.schema(schema).parquet(f"{self.folder}/tokens")
        q = run_access_stream(r, k, lambda: self.versions, f"{self.folder}/out", delay="2 hours")
        q.awaitTermination()
        assert q.exception() is None
        return {x.id: x for x in read_decisions(self.spark, f"{self.folder}/out").collect()}

    def count(self):
        return read_decisions(self.spark, f"{self.folder}/out").count()


def test_equals_the_batch_form_over_several_deliveries(spark, versions, tmp_path):
    run = Run(spark, versions, str(tmp_path))
    run.deliver(*DELIVERIES[0])
    first = run.go()
    # decided at once: what presents no token, and what met its token; the unknown token waits for the watermark
    assert {1, 4, 5, 6, 7} <= set(first) and 3 not in first
    for d in DELIVERIES[1:]:
        run.deliver(*d)
        got = run.go()
    assert set(got) >= set(range(1, 15)) and got[2].outcome == "invalid_token"
    assert run.count() == len(got)  # nothing twice
    requests = spark.createDataFrame([r for d in DELIVERIES for r in d[0]], REQ)
    tokens = with_hash(spark.createDataFrame([k for d in DELIVERIES for k in d[1]], TOK))
    want = {r.id: r for r in access_asof(requests, tokens, versions).collect()}
    for i in range(1, 15):
        assert (got[i].outcome, got[i].status, got[i].user_id, got[i].at) == \
            (want[i].outcome, want[i].status, want[i].user_id, want[i].at), i
    assert [got[i].outcome for i in (1, 3, 7, 8, 9, 10, 11, 12, 13, 14)] == \
        ["inactive", "inactive", "invalid_token", "allowed", "invalid_token", "invalid_token", "allowed", "inactive",
         "invalid_token", "invalid_token"]


def test_a_restart_without_new_files_and_a_repeated_batch_add_nothing(spark, versions, tmp_path):
    run = Run(spark, versions, str(tmp_path))
    for d in DELIVERIES:
        run.deliver(*d)
    got = run.go()
    n = run.count()
    assert run.go().keys() == got.keys() and run.count() == n
    # the last commit is lost, as after a crash between the write of a batch and its commit: the batch runs again
    commits = sorted((tmp_path / "out" / "_checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    (tmp_path / "kept").mkdir()
    shutil.move(commits[-1], tmp_path / "kept" / commits[-1].name)
    for crc in (tmp_path / "out" / "_checkpoint" / "commits").glob(f".{commits[-1].name}.crc"):
        shutil.move(crc, tmp_path / "kept" / crc.name)
    again = run.go()
    assert again.keys() == got.keys() and run.count() == n
    assert {i: r.outcome for i, r in again.items()} == {i: r.outcome for i, r in got.items()}


def test_the_join_has_bounded_state(spark, tmp_path, versions):
    """Both sides carry a watermark and the join a time interval: the plan is a stream-stream join, not a table join."""
    run = Run(spark, versions, str(tmp_path))
    run.deliver(*DELIVERIES[0])
    from muster.streaming.access import own_requests
    r = spark.readStream.schema(REQ).parquet(f"{tmp_path}/requests")
    schema = with_hash(spark.createDataFrame([], TOK)).schema
    k = spark.readStream.schema(schema).parquet(f"{tmp_path}/tokens")
    df = own_requests(r, k, "auth_header", "at", "2 hours")
    plan = df._jdf.queryExecution().logical().toString()
    assert df.isStreaming and plan.count("EventTimeWatermark") >= 2
    assert df.where(F.lit(False)).columns == ["id", "auth_header", "guarded", "at", "_state", "_user"]
