"""Registered queries: rule validation (V1-V13) and constraint audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from muster.operators import constraints as C
from muster.operators import validate as V
from muster.plans.catalog import query
from muster.plans.oracle_sql import with_tables


# --- the rules again, by hand (oracle side) -----------------------------------------------------
# Per rule set, in order: field | SQL of what is wrong | message.
_EMAIL_FAULTS = r"""
email | coalesce(email, '') = '' | must be provided
email | NOT regexp_matches(email, '^[a-zA-Z0-9.!#$%&''*+\/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*\z') | must be a valid email address
"""
_PASSWORD_FAULTS = """
password | coalesce(password, '') = '' | must be provided
password | strlen(password) < 8 | must be at least 8 bytes long
password | strlen(password) > 72 | must not be more than 72 bytes long
"""
_FAULTS = {
    "officers": """
first_name | coalesce(first_name, '') = '' | must be provided
first_name | strlen(first_name) > 100 | must not exceed 100 bytes
last_name | coalesce(last_name, '') = '' | must be provided
last_name | strlen(last_name) > 100 | must not exceed 100 bytes
sex | coalesce(sex, '') = '' | must be provided
sex | sex NOT IN ('male', 'female', 'unknown') | must be male, female, or unknown
rank_code | coalesce(rank_code, '') = '' | must be provided
""",
    "courses": """
title | coalesce(title, '') = '' | must be provided
title | strlen(title) > 255 | must not exceed 255 bytes
category | coalesce(category, '') = '' | must be provided
category | category NOT IN ('mandatory', 'elective', 'instructor') | invalid category type
default_credit_hours | coalesce(default_credit_hours, 0) <= 0 | must be greater than zero
""",
    "sessions": """
course_id | coalesce(course_id, '') = '' | must be provided
start_datetime | start_datetime IS NULL | must be provided
end_datetime | end_datetime IS NULL | must be provided
end_datetime | start_datetime IS NOT NULL AND end_datetime <= start_datetime | must be after start_datetime
location_text | coalesce(location_text, '') = '' | must be provided
""",
    "facilitators": """
first_name | coalesce(first_name, '') = '' | must be provided
last_name | coalesce(last_name, '') = '' | must be provided
""",
    "attendance": """
officer_id | coalesce(officer_id, '') = '' | must be provided
session_id | coalesce(session_id, '') = '' | must be provided
status | coalesce(status, '') NOT IN ('attended', 'absent', 'excused') | must be one of attended, absent, or excused
credited_hours | credited_hours < 0 | must be zero or greater
""",
    "session_feedback": """
session_id | coalesce(session_id, '') = '' | must be provided
officer_id | coalesce(officer_id, '') = '' | must be provided
facilitator_id | coalesce(facilitator_id, '') = '' | must be provided
rating | coalesce(rating, 0) < 1 OR rating > 5 | must be between 1 and 5
""",
    "session_facilitators": """
session_id | coalesce(session_id, '') = '' | must be provided
facilitator_id | coalesce(facilitator_id, '') = '' | must be provided
""",
    "import_jobs": """
type | coalesce(type, '') = '' | must be provided
""",
    "email": _EMAIL_FAULTS,
    "password": _PASSWORD_FAULTS,
    "users": _EMAIL_FAULTS + _PASSWORD_FAULTS,
    "token": """
token | coalesce(token, '') = '' | must be provided
token | strlen(token) <> 26 | must be 26 bytes long
""",
}


def _faults_sql(name: str) -> tuple[list[str], str]:
    """(fields, their message columns): the first fault of a field counts."""
    fields: dict[str, list[str]] = {}
    for line in _FAULTS[name].strip().splitlines():
        if line.strip():
            field, rest = line.split(" | ", 1)
            wrong, message = rest.rsplit(" | ", 1)
            fields.setdefault(field, []).append(f"WHEN {wrong} THEN '{message}'")
    return list(fields), ", ".join(f"CASE {' '.join(w)} END AS err_{f}" for f, w in fields.items())


def _validate_query(name: str, rule_set: str, source_sql: str, keep: list[str], build):
    fields, cols = _faults_sql(rule_set)
    keep_sql = ", ".join(keep)
    errors = [f"err_{f}" for f in fields]
    sql = (f"SELECT {keep_sql}, {', '.join(errors)}, {' AND '.join(f'{e} IS NULL' for e in errors)} AS valid "
           f"FROM (SELECT {keep_sql}, {cols} FROM ({source_sql}) s) v")

    def run(t):
        rules = V.RULES[rule_set]
        return V.validate_columns(build(t), rules).select(
            *keep, *[f"err_{f}" for f in V.fields_of(rules)], "valid")
    run.__name__ = name
    query(name, sql)(run)


_TABLE_RULES = {
    "officers": ["id", "first_name", "last_name", "sex", "rank_code"],
    "courses": ["id", "title", "category", "default_credit_hours"],
    "sessions": ["id", "course_id", "start_datetime", "end_datetime", "location_text"],
    "facilitators": ["id", "first_name", "last_name"],
    "attendance": ["id", "officer_id", "session_id", "status", "credited_hours"],
    "session_feedback": ["id", "session_id", "officer_id", "facilitator_id", "rating"],
    "session_facilitators": ["id", "session_id", "facilitator_id"],
    "import_jobs": ["id", "type"],
}
for _t, _keep in _TABLE_RULES.items():
    _validate_query(f"validate_{_t}", _t,
                    with_tables(_t) + f"SELECT * FROM {_t}", _keep,
                    (lambda name: (lambda t: t.table(name)))(_t))

# credentials as typed by users: e-mail from the users table, a password per customer
# segment that covers the 8- and 72-byte limits on both sides, a token per event.
_PASSWORD_SQL = ("CASE WHEN c_mktsegment = 'BUILDING' THEN lower(c_mktsegment) "
                 "WHEN c_mktsegment = 'HOUSEHOLD' THEN 'short' "
                 "WHEN c_mktsegment = 'AUTOMOBILE' THEN repeat(c_name, 4) "
                 "WHEN c_mktsegment = 'MACHINERY' THEN repeat(c_name, 5) ELSE c_name END")
_SIGNUP_SQL = (with_tables("users") +
               "SELECT u.id, u.email, " + _PASSWORD_SQL + " AS password FROM users u "
               "JOIN customer c ON u.id = '00000000-0000-4000-8000-' || "
               "lpad(CAST(c.c_custkey AS VARCHAR), 12, '0')")


def _signups(t):
    c = t.raw("customer")
    seg = F.col("c_mktsegment")
    password = (F.when(seg == "BUILDING", F.lower(seg))
                .when(seg == "HOUSEHOLD", F.lit("short"))
                .when(seg == "AUTOMOBILE", F.repeat(F.col("c_name"), 4))
                .when(seg == "MACHINERY", F.repeat(F.col("c_name"), 5))
                .otherwise(F.col("c_name")))
    from muster.functions.ids import key_uuid
    emails = t.users.select("id", "email")
    pw = c.select(key_uuid("c_custkey").alias("id"), password.alias("password"))
    return emails.join(pw, "id")


_validate_query("validate_email", "email", _SIGNUP_SQL, ["id", "email"], _signups)
_validate_query("validate_password", "password", _SIGNUP_SQL,
                ["id", "password"], _signups)
_validate_query("validate_users", "users", _SIGNUP_SQL,
                ["id", "email", "password"], _signups)

_TOKEN_SQL = (with_tables("requests") +
              "SELECT request_id, coalesce(split_part(auth_header, ' ', 2), '') AS token "
              "FROM requests")


def _presented_tokens(t):
    r = t.requests
    return r.select("request_id", F.coalesce(F.split_part(F.col("auth_header"), F.lit(" "),
                                                          F.lit(2)), F.lit("")).alias("token"))


_validate_query("validate_token", "token", _TOKEN_SQL, ["request_id", "token"],
                _presented_tokens)


# --- V13 DDL value checks ------------------------------------------------------------------------
_DDL_TABLES = ("users", "officers", "courses", "attendance")


# The CHECK lists.
_CHECKED = {("users", "role"): "'admin', 'contributor', 'viewer'", ("officers", "sex"): "'male', 'female', 'unknown'",
            ("courses", "category"): "'mandatory', 'elective', 'instructor'",
            ("attendance", "status"): "'attended', 'absent', 'excused'"}


def _ddl_sql() -> str:
    parts = [f"SELECT '{t}' AS table_name, id, '{c}' AS column_name, {c} AS value FROM {t} "
             f"WHERE {c} IS NOT NULL AND {c} NOT IN ({values})" for (t, c), values in _CHECKED.items()]
    return with_tables(*_DDL_TABLES) + " UNION ALL ".join(parts)


@query("validate_ddl_checks", _ddl_sql())
def validate_ddl_checks(t):
    """Rows whose value breaks a CHECK (role, sex, category, status)."""
    from functools import reduce
    parts = []
    for name in _DDL_TABLES:
        df = t.table(name)
        rules = V.ddl_check_rules(name)
        viol = F.filter(F.array(*[F.struct(F.lit(r.field).alias("column_name"),
                                           F.col(r.field).cast("string").alias("value"),
                                           V._ok(r).alias("ok")) for r in rules]),
                        lambda s: ~s["ok"])
        parts.append(df.select(F.lit(name).alias("table_name"), "id",
                               F.explode(viol).alias("v"))
                     .select("table_name", "id", "v.column_name", "v.value"))
    return reduce(lambda a, b: a.unionByName(b), parts)


# --- C1 NOT NULL audit ----------------------------------------------------------------------------
# The oracles state columns, keys and references by hand, apart from the schema the operators read.
# The columns of every table; "?" marks one that may be NULL.
_COLUMNS = """
regions: id name
postings: id name
ranks: code name
formations: id name region_id
users: id email password_hash role created_at last_login_at? version activated
officers: id regulation_number? first_name last_name sex rank_code region_id? formation_id? posting_id? \
created_at updated_at? archived_at? version
courses: id title category default_credit_hours description? created_by_user_id created_at updated_at? version
sessions: id course_id start_datetime end_datetime region_id? formation_id? posting_id? location_text? \
facilitator_notes? credit_hours_override? created_at updated_at? version
facilitators: id officer_id? first_name? last_name? rank_code? posting_id? notes? version
session_facilitators: id session_id facilitator_id role? version
attendance: id officer_id session_id status credited_hours created_at version
session_feedback: id session_id facilitator_id officer_id rating comments? created_at version
import_jobs: id type status error_message? created_by_user_id created_at finished_at? version
tokens: hash user_id expiry scope
"""
_AUDITED = {t: c.split() for t, c in (line.split(":") for line in _COLUMNS.strip().splitlines())}


def _nn_sql() -> str:
    parts = []
    for t, columns in _AUDITED.items():
        for c in columns:
            name, nullable = c.rstrip("?"), "TRUE" if c.endswith("?") else "FALSE"
            parts.append(
                f"SELECT '{t}' AS table_name, '{name}' AS column_name, {nullable} AS nullable, "
                f"CAST(count(*) FILTER (WHERE {name} IS NULL) AS BIGINT) AS null_count, "
                f"(NOT {nullable}) AND count(*) FILTER (WHERE {name} IS NULL) > 0 AS violation "
                f"FROM {t}")
    return with_tables(*_AUDITED) + " UNION ALL ".join(parts)


@query("not_null_audit", _nn_sql())
def not_null_audit(t):
    """Every column of all 14 tables."""
    return C.not_null_audit({n: t.table(n) for n in _AUDITED})


# --- C2 unique audit ---------------------------------------------------------------------------------
# Primary keys, then the other unique keys.
_KEYS = [(t, ("code",) if t == "ranks" else ("hash",) if t == "tokens" else ("id",)) for t in _AUDITED] + [
    ("users", ("email",)), ("officers", ("regulation_number",)),
    ("session_facilitators", ("session_id", "facilitator_id")), ("attendance", ("officer_id", "session_id")),
    ("session_feedback", ("officer_id", "session_id", "facilitator_id"))]


def _uq_sql() -> str:
    parts = []
    for t, keys in _KEYS:
        present = " AND ".join(f"{k} IS NOT NULL" for k in keys)
        kv = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
        parts.append(
            f"SELECT '{t}' AS table_name, '{','.join(keys)}' AS key_columns, "
            f"concat_ws('|', {kv}) AS key_value, count(*) AS row_count FROM {t} "
            f"WHERE {present} GROUP BY {', '.join(keys)} HAVING count(*) > 1")
    return with_tables(*_AUDITED) + " UNION ALL ".join(parts)


@query("unique_audit", _uq_sql())
def unique_audit(t):
    """Primary and unique keys of all 14 tables."""
    return C.unique_audit({n: t.table(n) for n in _AUDITED})


# --- C3 foreign-key audit ------------------------------------------------------------------------
# Child.column -> parent (its id; ranks by code).
_REFERENCES = """
formations.region_id regions
officers.rank_code ranks
officers.region_id regions
officers.formation_id formations
officers.posting_id postings
courses.created_by_user_id users
sessions.course_id courses
sessions.region_id regions
sessions.formation_id formations
sessions.posting_id postings
facilitators.officer_id officers
facilitators.rank_code ranks
facilitators.posting_id postings
session_facilitators.session_id sessions
session_facilitators.facilitator_id facilitators
attendance.officer_id officers
attendance.session_id sessions
session_feedback.session_id sessions
session_feedback.facilitator_id facilitators
session_feedback.officer_id officers
import_jobs.created_by_user_id users
tokens.user_id users
"""
_FK_TABLES = tuple(_AUDITED)


def _fk_sql() -> str:
    parts = []
    for line in _REFERENCES.strip().splitlines():
        reference, parent = line.split()
        child, column = reference.split(".")
        key = "code" if parent == "ranks" else "id"
        parts.append(
            f"SELECT '{child}' AS child_table, '{column}' AS column_name, "
            f"'{parent}' AS parent_table, CAST(c.{column} AS VARCHAR) AS key_value, "
            f"count(*) AS row_count FROM {child} c "
            f"WHERE c.{column} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM {parent} p WHERE p.{key} = c.{column}) GROUP BY c.{column}")
    return with_tables(*_FK_TABLES) + " UNION ALL ".join(parts)


@query("fk_audit", _fk_sql())
def fk_audit(t):
    """Orphan key values of all 22 foreign keys, with the rows holding each."""
    return C.fk_audit({n: t.table(n) for n in _FK_TABLES})


# --- C4 numeric precision --------------------------------------------------------------------------
_LINE_ID_SQL = ("concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
                "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), "
                "CAST(CAST(l_quantity AS BIGINT) AS VARCHAR))")


@query("numeric_coercion", f"""
    SELECT id,
           TRY_CAST(credited_hours AS DECIMAL(4,1)) AS credited_hours,
           TRY_CAST(credited_hours AS DECIMAL(4,1)) IS NULL AS credited_hours_overflow,
           TRY_CAST(rating AS DECIMAL(2,1)) AS rating,
           TRY_CAST(rating AS DECIMAL(2,1)) IS NULL AS rating_overflow,
           TRY_CAST(credited_hours AS DECIMAL(4,1)) IS NOT NULL
             AND TRY_CAST(rating AS DECIMAL(2,1)) IS NOT NULL AS numeric_ok
    FROM (SELECT {_LINE_ID_SQL} AS id,
                 CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(0.01 AS DECIMAL(3,2)) AS credited_hours,
                 CAST(l_discount AS DECIMAL(12,2)) * CAST(100 AS DECIMAL(3,0)) AS rating
          FROM lineitem) s""")
def numeric_coercion(t):
    """C4: hours (price / 100) into NUMERIC(4,1) and rating (discount x 100) into NUMERIC(2,1)."""
    from muster.plans.standins import StandIns
    li = t.raw("lineitem")
    batch = li.select(
        StandIns._line_id().alias("id"),
        (F.col("l_extendedprice").cast("decimal(12,2)") * F.lit(0.01).cast("decimal(3,2)"))
        .alias("credited_hours"),
        (F.col("l_discount").cast("decimal(12,2)") * F.lit(100).cast("decimal(3,0)")).alias("rating"))
    out = C.numeric_coercion(batch, columns=[("credited_hours", 4, 1), ("rating", 2, 1)])
    return out.select("id", "credited_hours", "credited_hours_overflow", "rating",
                      "rating_overflow", "numeric_ok")
