"""Rule sets (the reference's validation tests) and constraint audits."""

from muster_helpers import rows, ts

from muster.operators import constraints as C
from muster.operators import validate as V


def errors_of(spark, ddl, data, rules):
    df = spark.createDataFrame(data, ddl)
    return [r["errors"] for r in V.validate(df, rules).collect()]


def test_officer_rules(spark):
    bad = errors_of(spark, "first_name string, last_name string, sex string, rank_code string",
                    [("", "", "other", ""), ("Al", "Smith", "male", "CONSTABLE")],
                    V.RULES["officers"])
    assert bad[0] == {"first_name": "must be provided", "last_name": "must be provided",
                      "sex": "must be male, female, or unknown", "rank_code": "must be provided"}
    assert bad[1] == {}


def test_byte_length_not_characters(spark):
    name = "é" * 51  # 51 characters, 102 bytes
    bad = errors_of(spark, "first_name string, last_name string, sex string, rank_code string",
                    [(name, "x", "male", "R")], V.RULES["officers"])
    assert bad[0] == {"first_name": "must not exceed 100 bytes"}


def test_course_rules_and_small_hours(spark):
    got = errors_of(spark, "title string, category string, default_credit_hours double",
                    [("", "other", 0.0), ("T", "elective", 0.04)], V.RULES["courses"])
    assert got[0] == {"title": "must be provided", "category": "invalid category type",
                      "default_credit_hours": "must be greater than zero"}
    assert got[1] == {}


def test_session_rules(spark):
    ddl = "course_id string, start_datetime timestamp_ntz, end_datetime timestamp_ntz, " \
          "location_text string"
    got = errors_of(spark, ddl, [(None, None, None, None),
                                 ("c", ts("2024-01-02 10:00:00"), ts("2024-01-02 09:00:00"), "x")],
                    V.RULES["sessions"])
    assert got[0] == {"course_id": "must be provided", "start_datetime": "must be provided",
                      "end_datetime": "must be provided", "location_text": "must be provided"}
    assert got[1] == {"end_datetime": "must be after start_datetime"}


def test_attendance_and_feedback_rules(spark):
    got = errors_of(spark, "officer_id string, session_id string, status string, "
                           "credited_hours double", [("", "", "maybe", -1.0)],
                    V.RULES["attendance"])
    assert set(got[0]) == {"officer_id", "session_id", "status", "credited_hours"}
    got = errors_of(spark, "session_id string, officer_id string, facilitator_id string, "
                           "rating double", [("s", "o", "f", 5.5), ("s", "o", "f", 1.0)],
                    V.RULES["session_feedback"])
    assert got == [{"rating": "must be between 1 and 5"}, {}]


def test_user_rules_and_trailing_newline(spark):
    got = errors_of(spark, "email string, password string",
                    [("not-an-email", "short"), ("a@b.org\n", "longenough"),
                     ("a@b.org", "x" * 73), ("a@b.org", "x" * 72)], V.RULES["users"])
    assert got[0] == {"email": "must be a valid email address",
                      "password": "must be at least 8 bytes long"}
    assert got[1] == {"email": "must be a valid email address"}
    assert got[2] == {"password": "must not be more than 72 bytes long"}
    assert got[3] == {}


def test_ddl_check_passes_null(spark):
    df = spark.createDataFrame([("a", "admin"), ("b", "user"), ("c", None)], "id string, role string")
    out = V.validate_columns(df, V.ddl_check_rules("users"))
    assert rows(out.orderBy("id"), "valid") == [(True,), (False,), (True,)]


def test_unique_audit_nulls_distinct(spark):
    df = spark.createDataFrame([("1", "R1"), ("2", "R1"), ("3", None), ("4", None)],
                               "id string, regulation_number string")
    got = C.duplicate_keys(df, "officers", ("regulation_number",)).collect()
    assert [(r.key_value, r.row_count) for r in got] == [("R1", 2)]


def test_unique_audit_shuffles_the_keys_of_repeated_hashes_alone(spark, monkeypatch):
    links = spark.createDataFrame(
        [("1", "a", "b|c"), ("2", "a|b", "c"), ("3", "s", "f"), ("3", "s", "f"), ("4", None, "f"), ("5", None, "f"), (None, "x", "y")],
        "id string, session_id string, facilitator_id string")
    users = spark.createDataFrame([("3", "m"), ("6", "m"), ("7", None), ("8", None)], "id string, email string")
    want = [("session_facilitators", "id", "3", 2), ("session_facilitators", "session_id,facilitator_id", "s|f", 2), ("users", "email", "m", 2)]
    for most in (C.BROADCAST_KEYS, 0):
        monkeypatch.setattr(C, "BROADCAST_KEYS", most)
        got = C.unique_audit({"session_facilitators": links, "users": users})
        assert sorted(rows(got, "table_name", "key_columns", "key_value", "row_count")) == want
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        # below the group-by of each table's keys, a semi-join leaves those whose hash occurs twice
        assert plan.count("LeftSemi") == 2


def test_fk_audit_null_exempt(spark):
    from muster.schemas import ForeignKey
    parent = spark.createDataFrame([("p1",)], "id string")
    child = spark.createDataFrame([("c1", "p1"), ("c2", "p9"), ("c3", None), ("c4", "p9")],
                                  "id string, parent_id string")
    fk = ForeignKey("kids", "parent_id", "parents", "id", "cascade")
    got = C.orphans(child, parent, fk).collect()
    assert [(r.key_value, r.row_count) for r in got] == [("p9", 2)]


def test_numeric_coercion_rounds_half_away_and_flags_overflow(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("2.25",), ("-2.25",), ("0.04",), ("999.95",), (None,)], "h string")
    out = C.numeric_coercion(df.select(F.col("h").cast("decimal(10,2)").alias("credited_hours")),
                             "attendance")
    got = [(None if r[0] is None else float(r[0]), r[1]) for r in
           out.select("credited_hours", "credited_hours_overflow").collect()]
    assert got == [(2.3, False), (-2.3, False), (0.0, False), (None, True), (None, False)]


def test_fk_audit_aggregates_before_the_parent_join(spark):
    from muster.schemas import ForeignKey
    parent = spark.createDataFrame([("p1",)], "id string")
    child = spark.createDataFrame([("c1", "p1"), ("c2", "p9")], "id string, parent_id string")
    fk = ForeignKey("kids", "parent_id", "parents", "id", "cascade")
    plan = C.fk_audit({"kids": child, "parents": parent}, (fk,)) \
        ._jdf.queryExecution().optimizedPlan().toString()
    # the join sits above the per-key aggregate: child rows are counted before any join
    join_at = plan.find("Join LeftOuter")
    assert join_at != -1 and plan.find("Aggregate", join_at) != -1
    assert "LeftAnti" not in plan
