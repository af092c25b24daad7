"""Strict JSON ingest: every decode outcome of the reference's request reader."""

import pytest
from muster_helpers import ts

from muster.sources import ndjson as N

CASES = [
    ('{"title":"a","category":"elective","default_credit_hours":2}', None),
    ("", "empty"),
    ("  \n ", "empty"),
    ('{"title":', "malformed"),
    ('{"title":"a"} {"title":"b"}', "multiple_values"),
    ('{"title":"a"}garbage', "multiple_values"),
    ('{"title":"a"},{"title":"b"}', "multiple_values"),
    ('{"title":"a","nick":1}', "unknown_field:nick"),
    ('{"nick":1,"title":5}', "unknown_field:nick"),
    ('{"title":5,"nick":1}', "wrong_type:title"),
    ('{"default_credit_hours":"8"}', "wrong_type:default_credit_hours"),
    ('[1]', "wrong_type"),
    ('"text"', "wrong_type"),
    ('null', None),
    ('{"TITLE":"a"}', None),
    ('{"title":"a","title":"b"}', None),
    ('{"title":"a","title":3}', "wrong_type:title"),
    ('{"title":null,"description":null}', None),
    ("null x", "multiple_values"),
    ("null,1", "multiple_values"),
    ("nullx", "malformed"),
]


@pytest.fixture(scope="module")
def decoded(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(CASES)], "i int, value string")
    return {r.i: r for r in N.ingest_ndjson(df, N.INPUTS["courses"]).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_reject_codes(decoded, i):
    assert decoded[i].reject_code == CASES[i][1], CASES[i][0]


def test_values_case_insensitive_last_wins(decoded):
    assert decoded[0].title == "a" and decoded[0].default_credit_hours == 2.0
    assert decoded[14].title == "a"
    assert decoded[15].title == "b"
    assert decoded[13].title is None


def test_too_large(spark):
    body = '{"title":"' + "x" * 1_048_600 + '"}'
    df = spark.createDataFrame([(body,)], "value string")
    assert N.ingest_ndjson(df, N.INPUTS["courses"]).collect()[0].reject_code == "too_large"


def test_times_rfc3339(spark):
    lines = ['{"course_id":"c","start_datetime":"2024-01-02T10:00:00Z",'
             '"end_datetime":"2024-01-02T12:00:00+02:00","location_text":"x"}',
             '{"start_datetime":"2024-01-02"}', '{"start_datetime":17}']
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    got = N.ingest_ndjson(df, N.INPUTS["sessions"]).collect()
    assert got[0].reject_code is None
    assert got[0].start_datetime == ts("2024-01-02 10:00:00")
    assert got[0].end_datetime == ts("2024-01-02 10:00:00")
    assert got[1].reject_code == "bad_time:start_datetime"
    assert got[2].reject_code == "wrong_type:start_datetime"


def test_parse_is_not_copied_into_predicates(spark):
    df = spark.createDataFrame([('{"title":"a"}',)], "value string")
    accepted = N.split_rejects(N.ingest_ndjson(df, N.INPUTS["courses"]))[0]
    plan = accepted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2  # the member map and the array wrap, once each
