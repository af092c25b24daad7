"""Predicates used by filters and validation rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: e-mail pattern. The final anchor is \z rather than $ because Java's $
# also accepts a trailing newline and the reference's regex engine does not.
EMAIL_PATTERN = (
    r"^[a-zA-Z0-9.!#$%&'*+\/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
    r"(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*\z"
)

# RFC 3339 date-time (fixed format): date, 'T', time, optional fraction, zone
RFC3339_PATTERN = (
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})\z"
)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ci_equal(col: Column | str, value: str) -> Column | None:
    """Optional case-insensitive equality; ``None`` (no predicate) for an empty argument."""
    if value == "":
        return None
    return F.lower(_c(col)) == F.lit(value.lower())


def id_equal(col: Column | str, value: str) -> Column | None:
    """Optional exact, case-sensitive match of an id rendered as text."""
    if value == "":
        return None
    return _c(col).cast("string") == F.lit(value)


def in_list(col: Column | str, values) -> Column:
    return _c(col).isin(list(values))


def octet_len(col: Column | str) -> Column:
    return F.octet_length(_c(col))


def rfc3339_pattern_ok(col: Column | str) -> Column:
    return _c(col).rlike(RFC3339_PATTERN)
