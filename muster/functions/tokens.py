"""Token hashing: the stored key of a token is SHA-256 of its text, as lower-case hex."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_hash(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.sha2(c, 256)
