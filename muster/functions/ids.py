"""Deterministic canonical ids.

Entity ids are lower-case canonical UUID strings; lower-case hex strings order
bytewise exactly as PostgreSQL orders UUIDs. For stand-in tables derived from
integer keys we place the key in the last group, so string order equals key order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID_PREFIX = "00000000-0000-4000-8000-"


def key_uuid(key: Column | str) -> Column:
    """UUID-shaped id for a non-negative integer key (< 10**12)."""
    col = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(UUID_PREFIX), F.lpad(col.cast("string"), 12, "0"))


def line_id(*parts: Column | str) -> Column:
    """Composite text id of integer parts joined by '-' (used where a table has no single key)."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws("-", *[c.cast("bigint").cast("string") for c in cols])


def content_uuid(*cols: Column | str) -> Column:
    """Deterministic UUID-shaped id (version nibble 5) from the SHA-256 of the given values.

    Unlike ``uuid()``, a recomputation after a lost executor yields the same id, so a
    retried task cannot give an inserted row a second identity.
    """
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    h = F.sha2(F.to_json(F.struct(*parts)), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4),
                       F.concat(F.lit("5"), F.substring(h, 14, 3)),
                       F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
