"""Rule validation over whole tables.

A rule set is data: ``(field, check, argument, message)`` in the order the rules
run. For each field the first failing message is kept, as in the reference; a row
is valid when no field has a message. A NULL input counts as the zero value of its
type ('' for text, 0 for numbers, the zero time for timestamps).

The whole set compiles to one ``coalesce(when(...), ...)`` per field, then either
one column per field or one ``map<string,string>`` column: a single projection, no
shuffle, no UDF.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions.predicates import EMAIL_PATTERN
from muster.schemas import ATTENDANCE_STATUSES, CATEGORIES, CHECKS, SEXES, TOKEN_TEXT_BYTES

ZERO_TIME = "0001-01-01 00:00:00"


@dataclass(frozen=True)
class Rule:
    field: str
    check: str          # see _ok()
    arg: object = None
    message: str = "must be provided"
    column: str | None = None   # source column when it differs from the field name


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _num(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def _time(c: str) -> Column:
    return F.coalesce(F.col(c).cast("timestamp_ntz"), F.lit(ZERO_TIME).cast("timestamp_ntz"))


def _ok(rule: Rule) -> Column:
    c, a = rule.column or rule.field, rule.arg
    k = rule.check
    if k == "not_empty":
        return _text(c) != ""
    if k == "max_bytes":
        return F.octet_length(_text(c)) <= a
    if k == "min_bytes":
        return F.octet_length(_text(c)) >= a
    if k == "eq_bytes":
        return F.octet_length(_text(c)) == a
    if k == "in":
        return _text(c).isin(list(a))
    if k == "in_or_null":  # a CHECK passes on NULL
        return F.col(c).isNull() | F.col(c).isin(list(a))
    if k == "matches":
        return _text(c).rlike(a)
    if k == "gt":
        return _num(c) > a
    if k == "ge":
        return _num(c) >= a
    if k == "between":
        return (_num(c) >= a[0]) & (_num(c) <= a[1])
    if k == "not_zero_time":
        return _time(c) != F.lit(ZERO_TIME).cast("timestamp_ntz")
    if k == "after":
        return _time(c) > _time(a)
    raise ValueError(f"unknown check {k!r}")


def fields_of(rules) -> list[str]:
    out: list[str] = []
    for r in rules:
        if r.field not in out:
            out.append(r.field)
    return out


def field_messages(rules) -> dict[str, Column]:
    """field -> first failing message (NULL when every rule of the field passes)."""
    return {f: F.coalesce(*[F.when(~_ok(r), F.lit(r.message)) for r in rules if r.field == f],
                          F.lit(None).cast("string"))
            for f in fields_of(rules)}


def validate(df: DataFrame, rules, errors_col: str = "errors") -> DataFrame:
    """V0: add ``errors`` (map field -> message, empty when valid) and ``valid``."""
    msgs = field_messages(rules)
    keys = F.array(*[F.lit(f) for f in msgs])
    vals = F.array(*msgs.values())
    errs = F.map_filter(F.map_from_arrays(keys, vals), lambda k, v: v.isNotNull())
    return df.withColumn(errors_col, errs).withColumn("valid", F.size(F.col(errors_col)) == 0)


def validate_columns(df: DataFrame, rules, prefix: str = "err_") -> DataFrame:
    """V0 with one message column per field (``err_<field>``) and ``valid``."""
    msgs = field_messages(rules)
    out = df
    for f, m in msgs.items():
        out = out.withColumn(prefix + f, m)
    valid = None
    for f in msgs:
        term = F.col(prefix + f).isNull()
        valid = term if valid is None else valid & term
    return out.withColumn("valid", valid)


def _provided(*fields: str) -> list[Rule]:
    return [Rule(f, "not_empty") for f in fields]


# --- rule sets (fixed values: fields, checks and messages as the reference states them) ----
EMAIL_RULES = [Rule("email", "not_empty"),
               Rule("email", "matches", EMAIL_PATTERN, "must be a valid email address")]
PASSWORD_RULES = [Rule("password", "not_empty"),
                  Rule("password", "min_bytes", 8, "must be at least 8 bytes long"),
                  Rule("password", "max_bytes", 72, "must not be more than 72 bytes long")]

RULES: dict[str, list[Rule]] = {
    "officers": [
        Rule("first_name", "not_empty"),
        Rule("first_name", "max_bytes", 100, "must not exceed 100 bytes"),
        Rule("last_name", "not_empty"),
        Rule("last_name", "max_bytes", 100, "must not exceed 100 bytes"),
        Rule("sex", "not_empty"),
        Rule("sex", "in", SEXES, "must be male, female, or unknown"),
        Rule("rank_code", "not_empty"),
    ],
    "courses": [
        Rule("title", "not_empty"),
        Rule("title", "max_bytes", 255, "must not exceed 255 bytes"),
        Rule("category", "not_empty"),
        Rule("category", "in", CATEGORIES, "invalid category type"),
        Rule("default_credit_hours", "gt", 0, "must be greater than zero"),
    ],
    "sessions": [
        Rule("course_id", "not_empty"),
        Rule("start_datetime", "not_zero_time"),
        Rule("end_datetime", "not_zero_time"),
        Rule("end_datetime", "after", "start_datetime", "must be after start_datetime"),
        Rule("location_text", "not_empty"),
    ],
    "facilitators": _provided("first_name", "last_name"),
    "attendance": [
        *_provided("officer_id", "session_id"),
        Rule("status", "in", ATTENDANCE_STATUSES, "must be one of attended, absent, or excused"),
        Rule("credited_hours", "ge", 0, "must be zero or greater"),
    ],
    "session_feedback": [
        *_provided("session_id", "officer_id", "facilitator_id"),
        Rule("rating", "between", (1, 5), "must be between 1 and 5"),
    ],
    "session_facilitators": _provided("session_id", "facilitator_id"),
    "import_jobs": _provided("type"),
    "email": EMAIL_RULES,
    "password": PASSWORD_RULES,
    "users": EMAIL_RULES + PASSWORD_RULES,
    "token": [Rule("token", "not_empty"),
              Rule("token", "eq_bytes", TOKEN_TEXT_BYTES, "must be 26 bytes long")],
}

# The DDL value checks (role is checked only by the DDL, never by the rules)
DDL_CHECK_MESSAGE = "violates check constraint"


def ddl_check_rules(table: str) -> list[Rule]:
    return [Rule(col, "in_or_null", values, DDL_CHECK_MESSAGE) for col, values in CHECKS.get(table, ())]

