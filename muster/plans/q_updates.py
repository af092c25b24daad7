"""Registered queries: versioned updates (M1) of every entity, reports and snapshots, the partial patch
of attendance (M2), and the password update with its token removal (M1 + M4).

Every row of a table gets one update; a digit of a key decides what is wrong with it: 0 an unknown id, 1 a
stale version, 2 and 3 a broken constraint (where the table has one to break), else nothing.
The SQL states the new values and the violations by hand.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import functions as F

from muster.operators import mutate as M
from muster.plans.catalog import query
from muster.plans.oracle_sql import AS_OF, with_tables
from muster.plans.standins import AS_OF as AS_OF_TEXT
from muster.plans.q_rules import _FAULTS as RULE_FAULTS
from muster.schemas import PATCHABLE, SCHEMAS, SCOPE_PASSWORD_RESET, UPDATABLE


@dataclass(frozen=True)
class Case:
    """``digit``: SQL (the same in Spark and DuckDB) of the deciding digit; ``values``: new column values
    by column, in the same SQL; ``violation``: DuckDB SQL over the patch ``p`` (NULL: none)."""

    digit: str
    values: dict[str, str]
    violation: str = "CAST(NULL AS VARCHAR)"
    parents: tuple[str, ...] = ()
    stamped: bool = False


CASES = {
    "officers": Case(
        "right(id, 1)",
        {"regulation_number": "concat('N-', id)", "first_name": "upper(first_name)", "last_name": "last_name",
         "sex": "CASE WHEN right(id, 1) = '2' THEN 'other' ELSE 'unknown' END",
         "rank_code": "CASE WHEN right(id, 1) = '3' THEN 'none' ELSE rank_code END"},
        "CASE WHEN p.sex NOT IN ('male', 'female', 'unknown') THEN 'check_violation' "
        "WHEN p.first_name IS NULL OR p.last_name IS NULL OR p.sex IS NULL OR p.rank_code IS NULL "
        "THEN 'constraint_violation' "
        "WHEN NOT EXISTS (SELECT 1 FROM ranks r WHERE r.code = p.rank_code) THEN 'fk_violation' END",
        ("ranks",), True),
    "courses": Case(
        "right(id, 1)",
        {"title": "upper(title)", "category": "CASE WHEN right(id, 1) = '2' THEN 'bogus' ELSE 'elective' END",
         "default_credit_hours": "CASE WHEN right(id, 1) = '3' THEN CAST(5000.04 AS DECIMAL(8,2)) "
                                 "ELSE CAST(2.25 AS DECIMAL(8,2)) END",
         "description": "CAST(NULL AS STRING)"},
        "CASE WHEN p.category NOT IN ('mandatory', 'elective', 'instructor') THEN 'check_violation' "
        "WHEN p.default_credit_hours >= 999.95 THEN 'numeric_overflow' "
        "WHEN p.title IS NULL OR p.category IS NULL OR p.default_credit_hours IS NULL THEN 'constraint_violation' END",
        stamped=True),
    "sessions": Case(
        "right(id, 1)",
        {"course_id": "CASE WHEN right(id, 1) = '2' THEN 'none' ELSE course_id END",
         "start_datetime": "CASE WHEN right(id, 1) = '3' THEN NULL ELSE start_datetime END",
         "end_datetime": "end_datetime", "location_text": "concat('Hall ', right(id, 2))"},
        "CASE WHEN p.course_id IS NULL OR p.start_datetime IS NULL OR p.end_datetime IS NULL THEN 'constraint_violation' "
        "WHEN NOT EXISTS (SELECT 1 FROM courses c WHERE c.id = p.course_id) THEN 'fk_violation' END",
        ("courses",), True),
    "facilitators": Case(
        "right(id, 1)", {"first_name": "'John'", "last_name": "last_name", "notes": "CAST(NULL AS STRING)"}),
    "attendance": Case(
        "right(session_id, 1)",
        {"status": "CASE WHEN right(session_id, 1) = '2' THEN 'bogus' ELSE 'excused' END",
         "credited_hours": "CASE WHEN right(session_id, 1) = '3' THEN CAST(1000 AS DECIMAL(8,2)) "
                           "ELSE CAST(0.25 AS DECIMAL(8,2)) END"},
        "CASE WHEN p.status NOT IN ('attended', 'absent', 'excused') THEN 'check_violation' "
        "WHEN p.credited_hours >= 999.95 THEN 'numeric_overflow' "
        "WHEN p.status IS NULL OR p.credited_hours IS NULL THEN 'constraint_violation' END"),
    "users": Case(
        "right(id, 1)",
        {"email": "concat('n.', email)", "role": "CASE WHEN right(id, 1) = '2' THEN 'boss' ELSE 'viewer' END",
         "activated": "CASE WHEN right(id, 1) = '3' THEN CAST(NULL AS BOOLEAN) ELSE true END"},
        "CASE WHEN p.role NOT IN ('admin', 'contributor', 'viewer') THEN 'check_violation' "
        "WHEN p.email IS NULL OR p.role IS NULL OR p.activated IS NULL THEN 'constraint_violation' END"),
}


def _patch_columns(case: Case) -> list[str]:
    return [f"CASE WHEN {case.digit} = '0' THEN concat(id, 'x') ELSE id END AS id",
            f"CAST(CASE WHEN {case.digit} = '1' THEN version + 1 ELSE version END AS INT) AS expected_version",
            "1 AS seq", *[f"{v} AS {c}" for c, v in case.values.items()]]


def _judged_sql(table: str, case: Case) -> str:
    patches = ", ".join(_patch_columns(case)).replace("AS STRING", "AS VARCHAR")
    return with_tables(table, *case.parents) + f""",
    p AS (SELECT {patches} FROM {table}),
    j AS (SELECT p.*, t.version AS stored, {case.violation} AS violation
          FROM p LEFT JOIN (SELECT DISTINCT id, version FROM {table}) t ON t.id = p.id),
    r AS (SELECT *, CASE WHEN stored IS NULL THEN 'not_found' WHEN expected_version <> stored THEN 'conflict'
                         WHEN violation IS NOT NULL THEN violation ELSE 'updated' END AS outcome FROM j)"""


def _report_sql(table: str, case: Case) -> str:
    return _judged_sql(table, case) + """
    SELECT id, seq, expected_version, outcome,
           CAST(CASE WHEN outcome = 'updated' THEN stored + 1 ELSE stored END AS INTEGER) AS version FROM r"""


def _snapshot_sql(table: str, case: Case) -> str:
    numeric = {"default_credit_hours", "credited_hours"}
    new = [f"CASE WHEN r.id IS NOT NULL THEN {f'CAST(r.{c} AS DECIMAL(4,1))' if c in numeric else f'r.{c}'} "
           f"ELSE t.{c} END AS {c}" for c in case.values]
    if case.stamped:
        new.append(f"CASE WHEN r.id IS NOT NULL THEN {AS_OF} ELSE t.updated_at END AS updated_at")
    return _judged_sql(table, case) + f"""
    SELECT t.id, {', '.join(new)},
           CAST(CASE WHEN r.id IS NOT NULL THEN t.version + 1 ELSE t.version END AS INTEGER) AS version
    FROM {table} t LEFT JOIN (SELECT * FROM r WHERE outcome = 'updated') r ON r.id = t.id"""


def _updated(t, table: str):
    case = CASES[table]
    base = t.table(table)
    # the digit is read from the key once per row, not once per column
    once = replace(case, digit="_digit", values={c: v.replace(case.digit, "_digit") for c, v in case.values.items()})
    patches = base.withColumn("_digit", F.expr(case.digit)).selectExpr(*_patch_columns(once))
    return M.table_update(base, patches, table, UPDATABLE[table], AS_OF_TEXT,
                          parents={p: t.table(p) for p in case.parents})


def _register(table: str, case: Case) -> None:
    @query(f"update_{table}_report", _report_sql(table, case))
    def report(t):
        return _updated(t, table)[1]

    @query(f"update_{table}", _snapshot_sql(table, case))
    def snapshot(t):
        shown = ["id", *case.values, *(["updated_at"] if case.stamped else []), "version"]
        return _updated(t, table)[0].select(*shown)


for _table, _case in CASES.items():
    _register(_table, _case)


# --- M2 on attendance ----------------------------------------------------------------------------
_ATTENDANCE_PATCH = [
    "CASE WHEN right(session_id, 1) = '0' THEN concat(id, 'x') ELSE id END AS id",
    "CAST(CASE WHEN right(session_id, 1) = '1' THEN version + 1 END AS INT) AS expected_version", "1 AS seq",
    "CASE WHEN right(session_id, 1) = '2' THEN 'bogus' WHEN right(session_id, 1) < '6' THEN 'excused' END AS status",
    "CASE WHEN right(session_id, 1) = '3' THEN CAST(-1 AS DECIMAL(8,2)) WHEN right(session_id, 1) = '4' "
    "THEN CAST(1000 AS DECIMAL(8,2)) WHEN right(session_id, 1) = '7' THEN CAST(0.25 AS DECIMAL(8,2)) END AS credited_hours"]
_ATTENDANCE_SQL = with_tables("attendance") + f""",
    p AS (SELECT {', '.join(_ATTENDANCE_PATCH)} FROM attendance),
    m AS (SELECT p.id, p.seq, p.expected_version, t.version AS stored, coalesce(p.status, t.status) AS status,
                 coalesce(p.credited_hours, t.credited_hours) AS credited_hours, t.officer_id, t.session_id
          FROM p LEFT JOIN (SELECT DISTINCT id, version, status, credited_hours, officer_id, session_id FROM attendance) t
          ON t.id = p.id),
    r AS (SELECT *, CASE WHEN stored IS NULL THEN 'not_found'
                         WHEN coalesce(status, '') NOT IN ('attended', 'absent', 'excused')
                              OR coalesce(credited_hours, 0) < 0 OR coalesce(officer_id, '') = ''
                              OR coalesce(session_id, '') = '' THEN 'invalid'
                         WHEN expected_version IS NOT NULL AND expected_version <> stored THEN 'conflict'
                         WHEN credited_hours >= 999.95 THEN 'numeric_overflow' ELSE 'updated' END AS outcome FROM m)"""


def _patched_attendance(t):
    return M.table_patch(t.attendance, t.attendance.selectExpr(*_ATTENDANCE_PATCH), "attendance", AS_OF_TEXT)


@query("patch_attendance_report", _ATTENDANCE_SQL + """
    SELECT id, seq, expected_version, outcome, CAST(CASE WHEN outcome IN ('invalid', 'not_found') THEN NULL
           WHEN outcome = 'updated' THEN stored + 1 ELSE stored END AS INTEGER) AS version FROM r""")
def patch_attendance_report(t):
    return _patched_attendance(t)[1].drop("errors")


@query("patch_attendance", _ATTENDANCE_SQL + """
    SELECT t.id, CASE WHEN r.id IS NOT NULL THEN r.status ELSE t.status END AS status,
           CASE WHEN r.id IS NOT NULL THEN CAST(r.credited_hours AS DECIMAL(4,1)) ELSE t.credited_hours END AS credited_hours,
           CAST(CASE WHEN r.id IS NOT NULL THEN t.version + 1 ELSE t.version END AS INTEGER) AS version
    FROM attendance t LEFT JOIN (SELECT * FROM r WHERE outcome = 'updated') r ON r.id = t.id""")
def patch_attendance(t):
    return _patched_attendance(t)[0].select("id", "status", "credited_hours", "version")


# --- M2 on the other entities: the cases of M1 as patches ---------------------------------------------
#: per table, a column and a value of it that breaks a rule (SQL of both engines); it is sent where the digit is 8
_BROKEN = {"officers": ("first_name", "''"), "courses": ("title", "''"), "sessions": ("end_datetime", "start_datetime"),
           "facilitators": ("last_name", "''"), "users": ("email", "'no address'")}


def _partial_columns(table: str, case: Case) -> list[str]:
    """Patches: where the digit is 6 or 7 all members but the unique ones are absent, where it is 5 no version is expected."""
    broken, value = _BROKEN[table]
    kept = {"regulation_number"}  # stored numbers repeat, so a patch always brings its own
    out = [f"CASE WHEN {case.digit} = '0' THEN concat(id, 'x') ELSE id END AS id",
           f"CAST(CASE WHEN {case.digit} = '1' THEN version + 1 WHEN {case.digit} <> '5' THEN version END AS INT) AS expected_version",
           "1 AS seq"]
    for c in PATCHABLE[table]:
        absent = "" if c in kept else f"WHEN {case.digit} IN ('6', '7') THEN NULL "
        wrong = f"WHEN {case.digit} = '8' THEN {value} " if c == broken else ""
        out.append(f"CASE {wrong}{absent}ELSE {case.values[c]} END AS {c}" if absent or wrong else f"{case.values[c]} AS {c}")
    return out


def _partial_sql(table: str, case: Case) -> str:
    patches = ", ".join(_partial_columns(table, case)).replace("AS STRING", "AS VARCHAR")
    columns = PATCHABLE[table]
    stored = {f.name for f in SCHEMAS[table].fields}
    faults = [line.split(" | ") for line in RULE_FAULTS[table].strip().splitlines() if line.strip()]
    wrong = " OR ".join(f"coalesce({' | '.join(f[1:-1])}, FALSE)" for f in faults if f[0] in stored)
    rest = [c for c in case.values if c not in columns]
    return with_tables(table, *case.parents) + f""",
    p AS (SELECT {patches} FROM {table}),
    m AS (SELECT p.id, p.seq, p.expected_version, t.version AS stored,
                 {', '.join([f'coalesce(p.{c}, t.{c}) AS {c}' for c in columns] + [f't.{c} AS {c}' for c in rest])}
          FROM p LEFT JOIN (SELECT DISTINCT * FROM {table}) t ON t.id = p.id),
    j AS (SELECT p.*, {case.violation} AS violation FROM m p),
    r AS (SELECT *, CASE WHEN stored IS NULL THEN 'not_found' WHEN {wrong} THEN 'invalid'
                         WHEN expected_version IS NOT NULL AND expected_version <> stored THEN 'conflict'
                         WHEN violation IS NOT NULL THEN violation ELSE 'updated' END AS outcome FROM j)"""


def _patched(t, table: str):
    case = CASES[table]
    base = t.table(table)
    return M.table_patch(base, base.selectExpr(*_partial_columns(table, case)), table, AS_OF_TEXT,
                         parents={p: t.table(p) for p in case.parents})


def _register_patch(table: str, case: Case) -> None:
    shown = [*PATCHABLE[table], *(["updated_at"] if case.stamped else [])]
    new = [f"CASE WHEN r.id IS NOT NULL THEN "
           + (AS_OF if c == "updated_at" else f"CAST(r.{c} AS DECIMAL(4,1))" if c == "default_credit_hours" else f"r.{c}")
           + f" ELSE t.{c} END AS {c}" for c in shown]

    @query(f"patch_{table}_report", _partial_sql(table, case) + """
    SELECT id, seq, expected_version, outcome, CAST(CASE WHEN outcome IN ('invalid', 'not_found') THEN NULL
           WHEN outcome = 'updated' THEN stored + 1 ELSE stored END AS INTEGER) AS version FROM r""")
    def report(t):
        return _patched(t, table)[1].drop("errors")

    @query(f"patch_{table}", _partial_sql(table, case) + f"""
    SELECT t.id, {', '.join(new)}, CAST(CASE WHEN r.id IS NOT NULL THEN t.version + 1 ELSE t.version END AS INTEGER) AS version
    FROM {table} t LEFT JOIN (SELECT * FROM r WHERE outcome = 'updated') r ON r.id = t.id""")
    def snapshot(t):
        return _patched(t, table)[0].select("id", *shown, "version")


for _table in _BROKEN:
    _register_patch(_table, CASES[_table])


# --- password update: M1 on the hash, then M4 on the reset tokens -----------------------------------
_PASSWORD_PATCH = [
    "CASE WHEN right(id, 1) = '0' THEN concat(id, 'x') ELSE id END AS id",
    "CAST(CASE WHEN right(id, 1) = '1' THEN version + 1 ELSE version END AS INT) AS expected_version", "1 AS seq",
    "concat('hash-', id) AS password_hash"]
_RESET = f"'{SCOPE_PASSWORD_RESET}'"


def _password(t):
    return M.update_password(t.users, t.tokens, t.users.selectExpr(*_PASSWORD_PATCH), AS_OF_TEXT)


@query("update_password", with_tables("users") + """
    SELECT id, CASE WHEN right(id, 1) IN ('0', '1') THEN password_hash ELSE 'hash-' || id END AS password_hash,
           CAST(version + CASE WHEN right(id, 1) IN ('0', '1') THEN 0 ELSE 1 END AS INTEGER) AS version FROM users""")
def update_password(t):
    return _password(t)[0].select("id", "password_hash", "version")


@query("update_password_tokens", with_tables("tokens", "users") + f"""
    SELECT * FROM tokens k WHERE NOT (scope = {_RESET} AND EXISTS (
        SELECT 1 FROM users u WHERE u.id = k.user_id AND right(u.id, 1) NOT IN ('0', '1')))""")
def update_password_tokens(t):
    """Tokens that stay: other scopes, and those of users whose update failed."""
    return _password(t)[1]


# --- C5: every outcome class in one report ----------------------------------------------------------
_REPORTS = {"update_attendance_report": "outcome", "update_users_report": "outcome", "update_sessions_report": "outcome",
            "bulk_insert": "outcome", "outcome_report": "outcome", "route_access": "outcome",
            "token_bucket": "CASE WHEN admitted THEN 'ok' ELSE 'rate_limited' END"}
# The status of every outcome.
_STATUS_SQL = """CASE outcome WHEN 'ok' THEN 200 WHEN 'allowed' THEN 200 WHEN 'updated' THEN 200 WHEN 'created' THEN 201
    WHEN 'bad_input' THEN 400 WHEN 'unauthenticated' THEN 401 WHEN 'invalid_token' THEN 401 WHEN 'inactive' THEN 403
    WHEN 'not_found' THEN 404 WHEN 'method_not_allowed' THEN 405 WHEN 'conflict' THEN 409 WHEN 'invalid' THEN 422
    WHEN 'duplicate' THEN 422 WHEN 'rate_limited' THEN 429 ELSE 500 END"""


def _register_outcomes() -> None:
    from muster.operators import constraints as C
    from muster.plans import q_access, q_ingest, q_stream  # noqa: F401
    from muster.plans.catalog import ORACLE, QUERIES

    parts = " UNION ALL ".join(f"SELECT '{name}' AS source, {column} AS outcome FROM ({ORACLE[name]}) q"
                               for name, column in _REPORTS.items())

    @query("outcome_classes", f"SELECT source, outcome, {_STATUS_SQL} AS status, count(*) AS row_count "
                              f"FROM ({parts}) a GROUP BY source, outcome")
    def outcome_classes(t):
        """Rows per source, outcome and status over updates, inserts, requests and rate limiting."""
        return C.outcome_summary({name: QUERIES[name](t.spark, t.root).selectExpr(f"{column} AS outcome")
                                  for name, column in _REPORTS.items()})


_register_outcomes()
