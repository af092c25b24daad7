"""File sources and sinks, and idle-key eviction of the streaming token bucket."""

import datetime as dt
import os
import tempfile

from muster_helpers import rows
from pyspark.sql import functions as F

from muster.sources import ndjson as N
from muster.sources import sinks as S


def test_read_ndjson_text_files(spark, tmp_path):
    path = tmp_path / "bodies.ndjson"
    path.write_text('{"type":"officers"}\n{"type":5}\n\n{"type":"courses"} {}\n')
    got = rows(N.read_ndjson(spark, str(path), N.INPUTS["import_jobs"]), "type", "reject_code")
    assert sorted(got, key=str) == sorted([("officers", None), (None, "wrong_type:type"),
                                           (None, "empty"), (None, "multiple_values")], key=str)


def test_bodies_that_are_not_json_or_name_no_time(spark):
    times = ["2024-02-30T00:00:00Z", "2024-01-01T25:00:00Z", "2024-01-01T00:00:00+99:00", "2024-01-01t00:00:00z"]
    lines = ["{'course_id':'x'}", '{"course_id":NaN}', "NaN", "Infinity", '{course_id:"x"}', '{"course_id":"x"}\r'] + [
        f'{{"start_datetime":"{t}"}}' for t in times] + ['{"start_datetime":"2024-01-01T00:00:00.1234567+01:00"}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "seq int, value string")
    got = {r.seq: r for r in N.ingest_ndjson(df, N.INPUTS["sessions"]).collect()}
    assert [got[i].reject_code for i in range(6)] == ["malformed"] * 5 + [None]
    assert [got[6 + i].reject_code for i in range(4)] == ["bad_time:start_datetime"] * 4
    assert got[10].reject_code is None
    assert got[10].start_datetime == dt.datetime(2023, 12, 31, 23, 0, 0, 123456)


def test_json_times_in_full_and_numbers_in_short_form(spark):
    df = spark.createDataFrame(
        [("c1", "T", "x", 2.0, dt.datetime(2024, 1, 1, 0, 0, 0, 123400)), ("c2", "T", "x", 12.5, dt.datetime(2024, 1, 1)),
         ("c3", "T", "x", 100.0, None)],
        "id string, title string, category string, hours double, created_at timestamp_ntz").withColumn(
        "hours", F.col("hours").cast("decimal(4,1)"))
    got = [r.json for r in S.json_rows(df, "courses", "c", ["hours", "created_at"]).orderBy("id").collect()]
    assert got == ['{"c":{"hours":2,"created_at":"2024-01-01T00:00:00.1234Z"}}',
                   '{"c":{"hours":12.5,"created_at":"2024-01-01T00:00:00Z"}}', '{"c":{"hours":100}}']


def test_stored_instants_and_wall_clock_times_agree_in_any_session_zone(spark, tmp_path):
    from muster.operators.access import live_tokens
    from muster.sources.tables import load_table
    spark.createDataFrame([("h", "u", dt.datetime(2024, 1, 1, 12), "s")],
                          "hash string, user_id string, expiry timestamp_ntz, scope string") \
        .withColumn("expiry", F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01'"), "expiry"))) \
        .write.parquet(str(tmp_path / "tokens"))
    for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            raw = spark.read.parquet(str(tmp_path / "tokens"))
            assert raw.dtypes[2][1] == "timestamp"
            for tokens in (raw, load_table(spark, str(tmp_path), "tokens")):
                assert live_tokens(tokens, "s", "2024-01-01 11:59:59").count() == 1
                assert live_tokens(tokens, "s", "2024-01-01 12:00:00").count() == 0
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_jdbc_needs_a_way_to_read_in_parallel(spark):
    import pytest

    from muster.schemas import SCHEMAS
    from muster.sources.tables import load_jdbc
    with pytest.raises(ValueError):
        load_jdbc(spark, "jdbc:none", "officers", SCHEMAS["officers"], partition_column="id")


def test_write_snapshot_new_directory_only(spark, tmp_path):
    import pytest
    df = spark.createDataFrame([("a", 1)], "id string, version int")
    S.write_snapshot(df, str(tmp_path / "v2"))
    assert rows(spark.read.parquet(str(tmp_path / "v2")), "id", "version") == [("a", 1)]
    with pytest.raises(Exception):
        S.write_snapshot(df, str(tmp_path / "v2"))  # never overwrites a version in place


def test_json_rows_omit_nulls_and_empty_description(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("c1", "T", "elective", None, "", t, None, 1)],
                               "id string, title string, category string, "
                               "default_credit_hours decimal(4,1), description string, "
                               "created_at timestamp_ntz, updated_at timestamp_ntz, version int")
    got = S.json_rows(df, "courses", "course").collect()[0].json
    assert got == ('{"course":{"id":"c1","title":"T","category":"elective",'
                   '"created_at":"2024-01-01T00:00:00Z","version":1}}')


def test_idle_keys_are_evicted(spark):
    from muster.streaming.token_bucket import token_bucket_stream
    base = dt.datetime(2024, 1, 1)
    src = tempfile.mkdtemp(prefix="muster-idle-src-")
    batches = [[(1, base, 1), (2, base, 2)], [(2, base + dt.timedelta(days=1), 3)],
               [(2, base + dt.timedelta(days=2), 4)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, "user_id bigint, ts timestamp_ntz, event_id bigint") \
            .coalesce(1).write.parquet(os.path.join(src, f"part{i}"))
    schema = "user_id bigint, ts timestamp_ntz, event_id bigint"
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    out = tempfile.mkdtemp(prefix="muster-idle-out-")
    q = (token_bucket_stream(stream).writeStream.format("parquet")
         .option("checkpointLocation", os.path.join(out, "_ck")).option("path", os.path.join(out, "o"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    state_rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress
                  if p.get("stateOperators")]
    assert state_rows and state_rows[-1] == 1  # key 1 idle for days: dropped
    assert sorted(rows(spark.read.parquet(os.path.join(out, "o")), "event_id", "admitted")) == [
        (1, True), (2, True), (3, True), (4, True)]


def test_ingest_stream_splits_accepted_and_rejects(spark, tmp_path):
    from muster.streaming.ingest import read_results, run_ingest_stream
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.ndjson").write_text('{"type":"officers"}\n{"type":1}\n')
    (src / "b.ndjson").write_text('{"type":"courses","x":2}\n{"TYPE":"attendance"}\n')
    out = tmp_path / "out"
    q = run_ingest_stream(spark, str(src), N.INPUTS["import_jobs"], str(out))
    q.awaitTermination()
    good, bad = read_results(spark, str(out))
    assert sorted(r.type for r in good.collect()) == ["attendance", "officers"]
    assert sorted((r.reject_code, r.line) for r in bad.collect()) == [
        ("unknown_field:x", '{"type":"courses","x":2}'), ("wrong_type:type", '{"type":1}')]
    assert all(r.source_file and r.line_id for r in bad.collect())
