"""Time helpers that do not depend on the session time zone.

Every time-dependent operator takes its "now" as an argument. Domain times are
``timestamp_ntz`` holding UTC wall-clock time; conversions below never go through
the session time zone, so results are the same whatever zone the caller's session
uses.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPOCH_NTZ = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def ntz_literal(value) -> Column:
    """A ``timestamp_ntz`` literal from an ISO string or a naive datetime (taken as UTC)."""
    text = value.isoformat(sep=" ") if isinstance(value, dt.datetime) else str(value)
    return F.lit(text).cast("timestamp_ntz")


def as_of_literal(as_of) -> Column:
    """The caller's "now": a column, an ISO string or a naive UTC datetime."""
    return as_of if isinstance(as_of, Column) else ntz_literal(as_of)


def epoch_micros(col: Column, data_type=None) -> Column:
    """Microseconds since 1970-01-01 UTC of a ``timestamp_ntz`` (UTC wall clock) or
    ``timestamp`` column."""
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(col)
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), col)


def utc_as(col: Column, data_type) -> Column:
    """A UTC wall-clock time as a column of ``data_type`` (an instant or a wall-clock time)."""
    return F.timestamp_micros(epoch_micros(col)) if isinstance(data_type, T.TimestampType) else col


def instant_to_utc_ntz(col: Column) -> Column:
    """A ``timestamp`` (an instant) as UTC wall-clock ``timestamp_ntz``."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(col), F.expr(_EPOCH_NTZ))
