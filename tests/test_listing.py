"""Listings: the reference's list tests (filters, sort, page) plus edge cases."""

import pytest
from muster_helpers import rows, ts

from muster.operators import listing as L
from muster.plans.specs import LIST_SPECS, PageArgs

OFFICERS = "id string, regulation_number string, first_name string, last_name string, " \
           "sex string, rank_code string, created_at timestamp_ntz, updated_at timestamp_ntz, " \
           "version int"


@pytest.fixture()
def officers(spark):
    t = ts("2024-01-01 00:00:00")
    data = [("a1", None, "Alice", "Smith", "female", "CONSTABLE", t, None, 1),
            ("b2", None, "Bob", "Jones", "male", "SERGEANT", t, None, 1),
            ("c3", None, "Charlie", "Smith", "male", "CONSTABLE", t, None, 1)]
    return spark.createDataFrame(data, OFFICERS)


def page(df, **kw):
    return L.list_page(df, LIST_SPECS["officers"], PageArgs(**kw))


def test_all_and_filters(officers):
    assert len(page(officers).collect()) == 3
    assert rows(page(officers, filters={"first_name": "Alice"}), "first_name") == [("Alice",)]
    assert len(page(officers, filters={"last_name": "Smith"}).collect()) == 2
    assert rows(page(officers, filters={"rank_code": "sergeant"}), "first_name") == [("Bob",)]


def test_sort_desc_and_page(officers):
    got = rows(page(officers, sort="-first_name"), "first_name")
    assert got == [("Charlie",), ("Bob",), ("Alice",)]
    p2 = page(officers, page=2, page_size=2, sort="first_name")
    assert rows(p2, "first_name", "total_records") == [("Charlie", 3)]
    meta = L.page_metadata(p2, 2, 2).collect()[0].asDict()
    assert meta == {"current_page": 2, "page_size": 2, "first_page": 1, "last_page": 2,
                    "total_records": 3}


def test_past_end_gives_empty_metadata(officers):
    p = page(officers, page=5, page_size=2)
    assert p.collect() == []
    meta = L.page_metadata(p, 5, 2).collect()[0]
    assert all(v is None for v in meta)


def test_no_token_query_matches_nothing(officers):
    assert page(officers, filters={"first_name": "!!"}).collect() == []


def test_id_filter_is_case_sensitive(spark):
    df = spark.createDataFrame([("s1", "abc-def"), ("s2", "ABC-DEF")],
                               "id string, course_id string")
    spec = LIST_SPECS["sessions"]
    assert rows(L.apply_filters(df, spec, {"course_id": "abc-def"}), "id") == [("s1",)]


def test_fulltext_two_terms_and_null_text(spark):
    df = spark.createDataFrame(
        [("1", "Main Hall"), ("2", "Room 101"), ("3", "main hall, east"), ("4", None)],
        "id string, location_text string")
    got = rows(L.apply_filters(df, LIST_SPECS["sessions"], {"location": "Main Hall"}), "id")
    assert sorted(got) == [("1",), ("3",)]


def test_null_sort_keys_follow_postgres(spark):
    df = spark.createDataFrame([("a", None), ("b", "x"), ("c", "y")],
                               "id string, last_name string")
    spec = LIST_SPECS["facilitators"]
    asc = df.orderBy(*L.sort_columns(spec, "last_name"))
    desc = df.orderBy(*L.sort_columns(spec, "-last_name"))
    assert rows(asc, "id") == [("b",), ("c",), ("a",)]
    assert rows(desc, "id") == [("a",), ("c",), ("b",)]


def test_invalid_page_arguments(officers):
    with pytest.raises(ValueError):
        page(officers, page=0)
    errs = L.validate_page_args(LIST_SPECS["officers"], PageArgs(10_001, 101, "title"))
    assert errs == {"page": "must be a maximum of 10,000", "page_size": "must be a maximum of 100",
                    "sort": "invalid sort value"}


def test_page_plan_is_topk_without_single_partition(officers):
    plan = page(officers, page=2, page_size=2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    # the only single-partition exchange carries one partial count per task, never rows
    assert "Window" not in plan
    for part in plan.split("Exchange SinglePartition")[1:]:
        assert "partial_count" in part.split("\n")[1]


def test_paginate_all_matches_row_number(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    df = spark.range(0, 1000).select(
        F.format_string("id%04d", (F.col("id") * 7919) % 1000).alias("id"),
        (F.col("id") % 13).cast("string").alias("status"),
        F.lit(None).cast("timestamp_ntz").alias("created_at")).repartition(5)
    spec = LIST_SPECS["attendance"]
    got = L.paginate_all(df, spec, 7, sort="-status", columns=["id", "status", "created_at"])
    w = Window.orderBy(*L.sort_columns(spec, "-status"))
    want = df.withColumn("rn", F.row_number().over(w) - 1).select(
        "id", (F.floor(F.col("rn") / 7) + 1).alias("page"), (F.col("rn") % 7 + 1).alias("row"))
    assert sorted(rows(got, "id", "page", "row_in_page")) == sorted(rows(want, "id", "page", "row"))


def test_deep_page_equals_the_page(officers, spark):
    for n in (1, 2, 3, 4):
        args = PageArgs(n, 1, "first_name", {})
        deep = L.deep_page(officers, LIST_SPECS["officers"], args)
        assert rows(deep, "first_name", "total_records") == rows(
            L.list_page(officers, LIST_SPECS["officers"], args), "first_name", "total_records")


def test_a_far_page_has_the_same_plan_and_runs_no_job(officers, spark):
    far = L.list_page(officers, LIST_SPECS["officers"], PageArgs(10_000, 100, "first_name", {}))
    plan = far._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "checkpoint" not in plan.lower()
    assert far.collect() == []


def test_id_filter_and_projection_reach_parquet_scan(spark, tmp_path):
    from muster.schemas import SCHEMAS
    from muster.sources.tables import load_table
    t = ts("2024-01-01 10:00:00")
    data = [(f"s{i}", f"c{i % 3}", t, t, None, None, None, "Main Hall", None, None, t, None, 1)
            for i in range(30)]
    spark.createDataFrame(data, SCHEMAS["sessions"]).write.parquet(str(tmp_path / "sessions"))
    df = load_table(spark, str(tmp_path), "sessions")
    p = L.list_page(df, LIST_SPECS["sessions"], PageArgs(filters={"course_id": "c1"}))
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(course_id,c1)" in plan
    assert "facilitator_notes" not in plan.split("ReadSchema:")[1].split("\n")[0]
    assert sorted(rows(p, "id"))[:2] == [("s1",), ("s10",)]


def test_hyphenated_compounds_are_tokens_too(spark):
    df = spark.createDataFrame(
        [("1", "State-of-the-art design"), ("2", "the art of the state"), ("3", "state of the art")],
        "id string, title string")
    spec = LIST_SPECS["courses"]
    got = rows(L.apply_filters(df, spec, {"title": "state-of-the-art"}), "id")
    assert got == [("1",)]
    assert len(L.apply_filters(df, spec, {"title": "art state"}).collect()) == 3
