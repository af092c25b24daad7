"""Domain data model as data: schemas, public projections, keys and constraints.

Nothing in here executes; the operators read these tables of facts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# times are UTC wall-clock time, whatever zone a session has
S, TS, I, B = T.StringType(), T.TimestampNTZType(), T.IntegerType(), T.BooleanType()
HOURS = T.DecimalType(4, 1)
RATING = T.DecimalType(2, 1)


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


# --- table schemas (column, type, nullable) ------------------------------------
SCHEMAS: dict[str, T.StructType] = {
    "regions": _schema(("id", S, False), ("name", S, False)),
    "postings": _schema(("id", S, False), ("name", S, False)),
    "ranks": _schema(("code", S, False), ("name", S, False)),
    "formations": _schema(("id", S, False), ("name", S, False), ("region_id", S, False)),
    "users": _schema(
        ("id", S, False), ("email", S, False), ("password_hash", S, False), ("role", S, False),
        ("created_at", TS, False), ("last_login_at", TS, True), ("version", I, False),
        ("activated", B, False)),
    "officers": _schema(
        ("id", S, False), ("regulation_number", S, True), ("first_name", S, False),
        ("last_name", S, False), ("sex", S, False), ("rank_code", S, False),
        ("region_id", S, True), ("formation_id", S, True), ("posting_id", S, True),
        ("created_at", TS, False), ("updated_at", TS, True), ("archived_at", TS, True),
        ("version", I, False)),
    "courses": _schema(
        ("id", S, False), ("title", S, False), ("category", S, False),
        ("default_credit_hours", HOURS, False), ("description", S, True),
        ("created_by_user_id", S, False), ("created_at", TS, False), ("updated_at", TS, True),
        ("version", I, False)),
    "sessions": _schema(
        ("id", S, False), ("course_id", S, False), ("start_datetime", TS, False),
        ("end_datetime", TS, False), ("region_id", S, True), ("formation_id", S, True),
        ("posting_id", S, True), ("location_text", S, True), ("facilitator_notes", S, True),
        ("credit_hours_override", HOURS, True), ("created_at", TS, False),
        ("updated_at", TS, True), ("version", I, False)),
    "facilitators": _schema(
        ("id", S, False), ("officer_id", S, True), ("first_name", S, True), ("last_name", S, True),
        ("rank_code", S, True), ("posting_id", S, True), ("notes", S, True), ("version", I, False)),
    "session_facilitators": _schema(
        ("id", S, False), ("session_id", S, False), ("facilitator_id", S, False),
        ("role", S, True), ("version", I, False)),
    "attendance": _schema(
        ("id", S, False), ("officer_id", S, False), ("session_id", S, False), ("status", S, False),
        ("credited_hours", HOURS, False), ("created_at", TS, False), ("version", I, False)),
    "session_feedback": _schema(
        ("id", S, False), ("session_id", S, False), ("facilitator_id", S, False),
        ("officer_id", S, False), ("rating", RATING, False), ("comments", S, True),
        ("created_at", TS, False), ("version", I, False)),
    "import_jobs": _schema(
        ("id", S, False), ("type", S, False), ("status", S, False), ("error_message", S, True),
        ("created_by_user_id", S, False), ("created_at", TS, False), ("finished_at", TS, True),
        ("version", I, False)),
    # the hash is kept as 64 lower-case hex characters so it compares across engines
    "tokens": _schema(("hash", S, False), ("user_id", S, False), ("expiry", TS, False),
                      ("scope", S, False)),
}

PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    t: (("code",) if t == "ranks" else ("hash",) if t == "tokens" else ("id",)) for t in SCHEMAS
}

# --- public projections: the columns a read returns -----------------------------
PUBLIC: dict[str, tuple[str, ...]] = {
    "officers": ("id", "regulation_number", "first_name", "last_name", "sex", "rank_code",
                 "created_at", "updated_at", "version"),
    "courses": ("id", "title", "category", "default_credit_hours", "description",
                "created_at", "updated_at", "version"),
    "sessions": ("id", "course_id", "start_datetime", "end_datetime", "location_text",
                 "created_at", "updated_at", "version"),
    "facilitators": ("id", "first_name", "last_name", "notes", "version"),
    "attendance": ("id", "officer_id", "session_id", "status", "credited_hours", "created_at",
                   "version"),
    "session_feedback": ("id", "session_id", "officer_id", "facilitator_id", "rating", "comments",
                         "created_at", "version"),
    "session_facilitators": ("id", "session_id", "facilitator_id", "role", "version"),
    "import_jobs": ("id", "type", "status", "error_message", "created_by_user_id", "created_at",
                    "finished_at", "version"),
    "users": ("id", "email", "role", "activated", "created_at", "last_login_at"),
    "tokens": ("expiry",),
}


# --- foreign keys and delete actions --------------------------------------------
@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    parent_column: str
    on_delete: str  # "cascade" | "set_null" | "restrict"


def _fk(child, column, parent, action, parent_column="id"):
    return ForeignKey(child, column, parent, parent_column, action)


FOREIGN_KEYS: tuple[ForeignKey, ...] = (
    _fk("formations", "region_id", "regions", "restrict"),
    _fk("officers", "rank_code", "ranks", "restrict", "code"),
    _fk("officers", "region_id", "regions", "set_null"),
    _fk("officers", "formation_id", "formations", "set_null"),
    _fk("officers", "posting_id", "postings", "set_null"),
    _fk("courses", "created_by_user_id", "users", "restrict"),
    _fk("sessions", "course_id", "courses", "cascade"),
    _fk("sessions", "region_id", "regions", "set_null"),
    _fk("sessions", "formation_id", "formations", "set_null"),
    _fk("sessions", "posting_id", "postings", "set_null"),
    _fk("facilitators", "officer_id", "officers", "set_null"),
    _fk("facilitators", "rank_code", "ranks", "set_null", "code"),
    _fk("facilitators", "posting_id", "postings", "set_null"),
    _fk("session_facilitators", "session_id", "sessions", "cascade"),
    _fk("session_facilitators", "facilitator_id", "facilitators", "cascade"),
    _fk("attendance", "officer_id", "officers", "cascade"),
    _fk("attendance", "session_id", "sessions", "cascade"),
    _fk("session_feedback", "session_id", "sessions", "cascade"),
    _fk("session_feedback", "facilitator_id", "facilitators", "cascade"),
    _fk("session_feedback", "officer_id", "officers", "cascade"),
    _fk("import_jobs", "created_by_user_id", "users", "restrict"),
    _fk("tokens", "user_id", "users", "cascade"),
)

# --- unique keys (NULLs distinct), primary keys included --------------------------
UNIQUE_KEYS: dict[str, tuple[tuple[str, ...], ...]] = {
    "users": (("id",), ("email",)),
    "officers": (("id",), ("regulation_number",)),
    "session_facilitators": (("id",), ("session_id", "facilitator_id")),
    "attendance": (("id",), ("officer_id", "session_id")),
    "session_feedback": (("id",), ("officer_id", "session_id", "facilitator_id")),
}
for _t, _pk in PRIMARY_KEYS.items():
    UNIQUE_KEYS.setdefault(_t, (_pk,))


def not_null_columns(table: str) -> tuple[str, ...]:
    return tuple(f.name for f in SCHEMAS[table].fields if not f.nullable)


# --- fixed values: CHECK constraints and rule value lists -------------------------
# These values must equal the reference's for right results.
ROLES = ("admin", "contributor", "viewer")
SEXES = ("male", "female", "unknown")
CATEGORIES = ("mandatory", "elective", "instructor")
ATTENDANCE_STATUSES = ("attended", "absent", "excused")
CHECKS: dict[str, tuple[tuple[str, tuple[str, ...]], ...]] = {
    "users": (("role", ROLES),),
    "officers": (("sex", SEXES),),
    "courses": (("category", CATEGORIES),),
    "attendance": (("status", ATTENDANCE_STATUSES),),
}
# NUMERIC(p, s) columns
NUMERIC_COLUMNS: dict[str, tuple[tuple[str, int, int], ...]] = {
    "courses": (("default_credit_hours", 4, 1),),
    "sessions": (("credit_hours_override", 4, 1),),
    "attendance": (("credited_hours", 4, 1),),
    "session_feedback": (("rating", 2, 1),),
}

# token scopes and lifetimes (fixed values)
SCOPE_ACTIVATION = "activation"
SCOPE_AUTHENTICATION = "authentication"
SCOPE_PASSWORD_RESET = "password-reset"
TOKEN_LIFETIME_SECONDS = {
    SCOPE_ACTIVATION: 3 * 24 * 3600,
    SCOPE_AUTHENTICATION: 24 * 3600,
    SCOPE_PASSWORD_RESET: 45 * 60,
}
TOKEN_TEXT_BYTES = 26

# --- mutation facts -------------------------------------------------------------
# columns a full update replaces, per table
UPDATABLE: dict[str, tuple[str, ...]] = {
    "officers": ("regulation_number", "first_name", "last_name", "sex", "rank_code"),
    "courses": ("title", "category", "default_credit_hours", "description"),
    "sessions": ("course_id", "start_datetime", "end_datetime", "location_text"),
    "facilitators": ("first_name", "last_name", "notes"),
    "attendance": ("status", "credited_hours"),
    "users": ("email", "role", "activated"),
    "users_password": ("password_hash",),
}
# columns a partial patch may set
PATCHABLE: dict[str, tuple[str, ...]] = {
    "officers": ("regulation_number", "first_name", "last_name", "sex", "rank_code"),
    "courses": ("title", "category", "default_credit_hours", "description"),
    "sessions": ("course_id", "start_datetime", "end_datetime", "location_text"),
    "facilitators": ("first_name", "last_name", "notes"),
    "attendance": ("status", "credited_hours"),
    "users": ("email", "role"),
}
# tables whose update also stamps updated_at
STAMPS_UPDATED_AT = frozenset({"officers", "courses", "sessions"})

# --- routes (fixed values): method, path, and whether only activated users may call it ----------
_ROUTES = """
GET /v1/healthcheck open
POST /v1/users open
PUT /v1/users/activated open
POST /v1/tokens/authentication open
POST /v1/tokens/password-reset open
PUT /v1/users/password open
GET /v1/users/:id open
PATCH /v1/users/:id open
DELETE /v1/users/:id open
GET /v1/users guarded
POST /v1/officers guarded
GET /v1/officers/:id open
PATCH /v1/officers/:id guarded
DELETE /v1/officers/:id guarded
GET /v1/officers open
POST /v1/courses guarded
GET /v1/courses/:id open
PATCH /v1/courses/:id guarded
DELETE /v1/courses/:id guarded
GET /v1/courses open
POST /v1/sessions guarded
GET /v1/sessions/:id open
PATCH /v1/sessions/:id guarded
DELETE /v1/sessions/:id guarded
GET /v1/sessions open
POST /v1/facilitators guarded
GET /v1/facilitators/:id open
PATCH /v1/facilitators/:id guarded
DELETE /v1/facilitators/:id guarded
GET /v1/facilitators open
POST /v1/attendance guarded
DELETE /v1/attendance/:id guarded
GET /v1/attendance/:id open
PATCH /v1/attendance/:id guarded
GET /v1/attendance open
POST /v1/session-facilitators guarded
DELETE /v1/session-facilitators/:id guarded
GET /v1/session-facilitators open
POST /v1/session-feedback guarded
GET /v1/session-feedback open
POST /v1/import-jobs guarded
GET /v1/import-jobs open
GET /v1/import-jobs/:id open
"""
ROUTES: dict[tuple[str, str], bool] = {
    (method, path): kind == "guarded" for method, path, kind in map(str.split, _ROUTES.strip().splitlines())}
