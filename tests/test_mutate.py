"""Versioned updates, patches, deletes and their propagation, inserts."""

from decimal import Decimal as D

import pytest
from muster_helpers import rows, ts
from pyspark.sql import functions as F

from muster.operators import ingest as I
from muster.operators import mutate as M
from muster.operators.validate import RULES
from muster.schemas import SCHEMAS

NOW = "2024-02-01 00:00:00"
COURSES = "id string, title string, category string, default_credit_hours decimal(4,1), " \
          "description string, created_by_user_id string, created_at timestamp_ntz, " \
          "updated_at timestamp_ntz, version int"


def courses(spark):
    t = ts("2024-01-01 00:00:00")
    return spark.createDataFrame(
        [("c1", "Firearms Safety", "mandatory", D(16), "d", "u1", t, None, 1),
         ("c2", "Community Policing", "elective", D(8), None, "u1", t, None, 3)], COURSES)


def patches(spark, data):
    return spark.createDataFrame(data, "id string, expected_version int, seq int, title string, "
                                       "category string, default_credit_hours decimal(4,1), "
                                       "description string")


def test_update_bumps_version_and_stamps(spark):
    base = courses(spark)
    p = patches(spark, [("c1", 1, 1, "New", "elective", D(4), None),     # current → updated
                        ("c2", 1, 1, "Stale", "elective", D(4), None),   # stale → conflict
                        ("c9", None, 1, "X", "elective", D(4), None)])   # missing → not_found
    new, rep = M.table_update(base, p, "courses", ["title", "category", "default_credit_hours",
                                                   "description"], NOW)
    assert sorted(rows(rep, "id", "outcome", "version")) == [
        ("c1", "updated", 2), ("c2", "conflict", 3), ("c9", "not_found", None)]
    c1 = new.where("id = 'c1'").collect()[0]
    assert (c1.title, c1.version, c1.description, c1.updated_at) == \
        ("New", 2, None, ts(NOW))  # a full update writes NULL
    assert new.where("id = 'c2'").collect()[0].title == "Community Policing"


def test_two_patches_same_id_first_wins(spark):
    p = patches(spark, [("c1", 1, 2, "Second", "elective", D(4), None),
                        ("c1", 1, 1, "First", "elective", D(4), None)])
    new, rep = M.optimistic_update(courses(spark), p, ["title"], NOW)
    assert sorted(rows(rep, "seq", "outcome")) == [(1, "updated"), (2, "conflict")]
    assert new.where("id = 'c1'").collect()[0].title == "First"


def test_partial_patch_keeps_nulls_and_revalidates(spark):
    p = patches(spark, [("c1", None, 1, None, None, None, "new text"),
                        ("c2", None, 1, None, "other", None, None)])
    new, rep = M.partial_patch(courses(spark), p, ["title", "category", "default_credit_hours",
                                                   "description"], RULES["courses"], NOW)
    got = {r.id: (r.outcome, r.errors) for r in rep.collect()}
    assert got["c1"] == ("updated", None)
    assert got["c2"] == ("invalid", {"category": "invalid category type"})
    c1 = new.where("id = 'c1'").collect()[0]
    assert (c1.title, c1.description, c1.version) == ("Firearms Safety", "new text", 2)


def test_delete_then_not_found(spark):
    base = courses(spark)
    keys = spark.createDataFrame([("c1",)], "id string")
    new, rep = M.delete_by_key(base, keys)
    assert rows(rep, "outcome") == [("deleted",)]
    _, rep2 = M.delete_by_key(new, keys)
    assert rows(rep2, "outcome") == [("not_found",)]


def _graph(spark):
    return {
        "users": spark.createDataFrame([("u1",), ("u2",)], "id string"),
        "courses": spark.createDataFrame([("c1", "u1"), ("c2", "u1")],
                                         "id string, created_by_user_id string"),
        "sessions": spark.createDataFrame([("s1", "c1", "f1"), ("s2", "c2", "f1")],
                                          "id string, course_id string, formation_id string"),
        "attendance": spark.createDataFrame([("a1", "s1"), ("a2", "s2")],
                                            "id string, session_id string"),
        "formations": spark.createDataFrame([("f1", "r1")], "id string, region_id string"),
        "regions": spark.createDataFrame([("r1",)], "id string"),
        "tokens": spark.createDataFrame([("h1", "u2"), ("h2", "u1")],
                                        "hash string, user_id string"),
    }


def test_cascade_two_levels(spark):
    g = _graph(spark)
    new, rep = M.propagate_delete(g, "courses", spark.createDataFrame([("c1",)], "id string"))
    assert sorted(rows(rep, "table_name", "id", "action")) == [
        ("attendance", "a1", "deleted"), ("courses", "c1", "deleted"), ("sessions", "s1", "deleted")]
    assert rows(new["attendance"], "id") == [("a2",)]


def test_set_null_and_restrict(spark):
    g = _graph(spark)
    new, rep = M.propagate_delete(g, "formations", spark.createDataFrame([("f1",)], "id string"))
    assert sorted(rows(rep, "table_name", "action")) == [
        ("formations", "deleted"), ("sessions", "set_null"), ("sessions", "set_null")]
    assert rows(new["sessions"], "formation_id") == [(None,), (None,)]
    new, rep = M.propagate_delete(g, "regions", spark.createDataFrame([("r1",)], "id string"))
    assert rows(rep, "action") == [("blocked",)]
    assert new["regions"].count() == 1


def test_restrict_per_root_and_cascade_of_the_rest(spark):
    g = _graph(spark)
    keys = spark.createDataFrame([("u1",), ("u2",), ("u9",)], "id string")
    new, rep = M.propagate_delete(g, "users", keys)
    assert sorted(rows(rep, "table_name", "id", "action")) == [
        ("tokens", "h1", "deleted"), ("users", "u1", "blocked"), ("users", "u2", "deleted"),
        ("users", "u9", "not_found")]
    assert rows(new["users"], "id") == [("u1",)]


def test_bulk_insert_duplicates_in_batch_and_base(spark):
    t = ts("2024-01-01 00:00:00")
    base = spark.createDataFrame([("a0", "o1", "s1", "attended", D(8), t, 1)],
                                 "id string, officer_id string, session_id string, status string, "
                                 "credited_hours decimal(4,1), created_at timestamp_ntz, version int")
    batch = spark.createDataFrame(
        [(1, "n1", "o1", "s1", "attended", 8.0),    # held by base
         (2, "n2", "o2", "s1", "attended", 8.0),    # first of two
         (3, "n3", "o2", "s1", "absent", 0.0),      # later duplicate in batch
         (4, "n4", "o3", "s1", "maybe", 0.0),       # rule failure
         (5, "n5", "o4", "s1", "excused", 1000.0),  # NUMERIC(4,1) overflow
         (6, "n6", "o9", "s1", "excused", 1.0)],    # unknown officer
        "seq int, id string, officer_id string, session_id string, status string, "
        "credited_hours double")
    parents = {"officers": spark.createDataFrame([(o,) for o in ("o1", "o2", "o3", "o4")],
                                                 "id string"),
               "sessions": spark.createDataFrame([("s1",)], "id string")}
    new, rep = I.bulk_insert(base, batch, "attendance", "2024-02-01 00:00:00", parents=parents)
    _, pinned = I.bulk_insert(base, batch, "attendance", "2024-02-01 00:00:00", parents=parents,
                              pin_batch=True)
    assert sorted(rows(pinned, "seq", "outcome")) == sorted(rows(rep, "seq", "outcome"))
    assert sorted(rows(rep, "seq", "outcome", "status")) == [
        (1, "duplicate", 422), (2, "created", 201), (3, "duplicate", 422), (4, "invalid", 422),
        (5, "numeric_overflow", 500), (6, "fk_violation", 500)]
    assert sorted(rows(new, "id", "version")) == [("a0", 1), ("n2", 1)]


def test_duplicate_email_on_insert(spark):
    t = ts("2024-01-01 00:00:00")
    base = spark.createDataFrame([("u1", "a@b.org", "h", "admin", t, None, 1, True)],
                                 "id string, email string, password_hash string, role string, "
                                 "created_at timestamp_ntz, last_login_at timestamp_ntz, "
                                 "version int, activated boolean")
    batch = spark.createDataFrame([(1, "u2", "a@b.org", "h", "viewer", "longpassword")],
                                  "seq int, id string, email string, password_hash string, "
                                  "role string, password string")
    _, rep = I.bulk_insert(base, batch, "users", "2024-02-01 00:00:00")
    assert rows(rep, "outcome") == [("duplicate",)]


def test_insert_if_absent(spark):
    base = spark.createDataFrame([("s1", "f1")], "session_id string, facilitator_id string")
    batch = spark.createDataFrame([(1, "s1", "f1"), (2, "s1", "f2"), (3, "s1", "f2")],
                                  "seq int, session_id string, facilitator_id string")
    got = I.insert_if_absent(base, batch, ("session_id", "facilitator_id"))
    assert rows(got, "seq") == [(2,)]


def test_generated_ids_are_deterministic(spark):
    base = spark.createDataFrame([], "id string, type string, status string, error_message string, "
                                     "created_by_user_id string, created_at timestamp_ntz, "
                                     "finished_at timestamp_ntz, version int")
    batch = spark.createDataFrame([(1, "officers", "pending", "u1"), (2, "officers", "pending", "u1")],
                                  "seq int, type string, status string, created_by_user_id string")
    parents = {"users": spark.createDataFrame([("u1",)], "id string")}
    ids1 = sorted(rows(I.bulk_insert(base, batch, "import_jobs", NOW, parents=parents)[1], "id"))
    ids2 = sorted(rows(I.bulk_insert(base, batch, "import_jobs", NOW, parents=parents)[1], "id"))
    assert ids1 == ids2 and len(set(ids1)) == 2
    assert all(len(i[0]) == 36 and i[0][14] == "5" for i in ids1)


def test_insert_checks_keys_nulls_and_parents(spark):
    t = ts("2024-01-01 00:00:00")
    base = spark.createDataFrame([("c0", "T", "elective", D(1), None, "u1", t, None, 1)], SCHEMAS["courses"])
    batch = spark.createDataFrame(
        [(1, "c0", "A", "elective", 1.0, "u1"), (2, "c1", "A", "elective", 1.0, "u1"), (3, "c1", "B", "elective", 1.0, "u1"),
         (4, "c2", "A", "elective", 1.0, None)],
        "seq int, id string, title string, category string, default_credit_hours double, created_by_user_id string")
    users = spark.createDataFrame([("u1",)], "id string")
    new, rep = I.bulk_insert(base, batch, "courses", NOW, parents={"users": users})
    assert sorted(rows(rep, "seq", "outcome")) == [
        (1, "duplicate"), (2, "created"), (3, "duplicate"), (4, "constraint_violation")]
    assert sorted(rows(new, "id")) == [("c0",), ("c1",)]
    with pytest.raises(ValueError):
        I.bulk_insert(base, batch, "courses", NOW)
    with pytest.raises(ValueError):
        I.insert_select(base, batch, "courses", NOW, {"title": "title"}, parents={"users": users})
    with pytest.raises(Exception, match="seq must not be NULL"):
        I.bulk_insert(base, batch.withColumn("seq", F.lit(None).cast("int")), "courses", NOW,
                      parents={"users": users})[1].collect()


def test_an_import_job_starts_pending(spark):
    base = spark.createDataFrame([], SCHEMAS["import_jobs"])
    batch = spark.createDataFrame([(1, "officers", "u1")], "seq int, type string, created_by_user_id string")
    new, rep = I.bulk_insert(base, batch, "import_jobs", NOW, parents={"users": spark.createDataFrame([("u1",)], "id string")})
    assert rows(rep, "outcome") == [("created",)] and rows(new, "status", "version") == [("pending", 1)]


def test_update_keeps_constraints_and_types(spark):
    t = ts("2024-01-01 00:00:00")
    base = spark.createDataFrame([(f"a{i}", "o1", f"s{i}", "attended", D(8), t, 1) for i in range(5)], SCHEMAS["attendance"])
    p = spark.createDataFrame(
        [("a0", 1, 1, "bogus", 1.0), ("a0", 1, 2, "excused", 2.0), ("a0", 1, 3, "bogus", 1.0), ("a1", 1, 1, "absent", 5000.04),
         ("a2", 1, 1, "absent", None), ("a3", 1, 1, "absent", 0.25), ("a4", 2, 1, "bogus", 1.0)],
        "id string, expected_version int, seq int, status string, credited_hours double")
    new, rep = M.table_update(base, p, "attendance", ["status", "credited_hours"], NOW)
    assert new.schema["credited_hours"].dataType == base.schema["credited_hours"].dataType
    assert sorted(rows(rep, "id", "seq", "outcome")) == [
        ("a0", 1, "check_violation"), ("a0", 2, "updated"), ("a0", 3, "conflict"), ("a1", 1, "numeric_overflow"),
        ("a2", 1, "constraint_violation"), ("a3", 1, "updated"), ("a4", 1, "conflict")]
    assert sorted(rows(new, "id", "status", "credited_hours", "version")) == [
        ("a0", "excused", D("2.0"), 2), ("a1", "attended", D("8.0"), 1), ("a2", "attended", D("8.0"), 1),
        ("a3", "absent", D("0.3"), 2), ("a4", "attended", D("8.0"), 1)]


def test_patch_revalidates_the_whole_stored_row(spark):
    t = ts("2024-01-01 00:00:00")
    base = spark.createDataFrame([("a0", "o1", "s1", "attended", D(8), t, 1), ("a1", "", "s1", "attended", D(8), t, 1)],
                                 SCHEMAS["attendance"])
    p = spark.createDataFrame([("a0", 1, 1, "excused", None), ("a1", 1, 1, "excused", None)],
                              "id string, expected_version int, seq int, status string, credited_hours double")
    new, rep = M.table_patch(base, p, "attendance", NOW)
    assert sorted(rows(rep, "id", "outcome")) == [("a0", "updated"), ("a1", "invalid")]
    assert ("a0", "excused", D("8.0")) in rows(new, "id", "status", "credited_hours")


def test_repeated_seq_never_duplicates_base_rows(spark):
    p = patches(spark, [("c1", 1, 1, "A", "elective", D(4), None),
                        ("c1", 1, 1, "B", "elective", D(4), None)])
    new, _ = M.optimistic_update(courses(spark), p, ["title"], NOW)
    assert new.count() == 2 and new.where("id = 'c1'").count() == 1


def test_duplicate_email_on_update(spark):
    t = ts("2024-01-01 00:00:00")
    users = spark.createDataFrame(
        [(u, e, "h", "viewer", t, None, 1, True) for u, e in
         [("u1", "a@b.org"), ("u2", "c@d.org"), ("u3", "x@y.org"), ("u4", "z@y.org")]],
        "id string, email string, password_hash string, role string, created_at timestamp_ntz, "
        "last_login_at timestamp_ntz, version int, activated boolean")
    p = spark.createDataFrame(
        [("u2", None, 1, "a@b.org", "viewer", True),    # held by u1 → duplicate
         ("u1", None, 2, "a@b.org", "admin", True),     # its own address → updated
         ("u3", None, 3, "e@f.org", "viewer", True),    # first to claim e@f.org → updated
         ("u4", None, 4, "e@f.org", "viewer", True)],   # second claim → duplicate
        "id string, expected_version int, seq int, email string, role string, activated boolean")
    new, rep = M.table_update(users, p, "users", ["email", "role", "activated"], NOW)
    assert sorted(rows(rep, "id", "outcome")) == [("u1", "updated"), ("u2", "duplicate"),
                                                 ("u3", "updated"), ("u4", "duplicate")]
    assert dict(rows(new, "id", "email")) == {"u1": "a@b.org", "u2": "c@d.org",
                                              "u3": "e@f.org", "u4": "z@y.org"}


def test_a_report_joins_its_patches_to_the_base_once(spark):
    """The winner per id comes from the joined rows, not from a second join of the same two tables."""
    base = courses(spark)
    p = patches(spark, [("c1", 1, 3, "Third", "elective", D(4), None), ("c1", 1, 1, "Wrong", "bogus", D(4), None),
                        ("c1", 1, 2, "Second", "elective", D(4), None), ("c1", 9, 4, "Stale", "elective", D(4), None),
                        (None, None, 1, "X", "elective", D(4), None), ("c2", 3, 1, "Big", "elective", D(4), None)])
    new, rep = M.table_update(base, p, "courses", ["title", "category"], NOW)
    assert sorted(rows(rep, "seq", "outcome", "version")) == [
        (1, "check_violation", 1), (1, "not_found", None), (1, "updated", 4), (2, "updated", 2), (3, "conflict", 1), (4, "conflict", 1)]
    assert sorted(rows(new, "id", "title")) == [("c1", "Second"), ("c2", "Big")]
    plan = rep._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Aggregate" not in plan
