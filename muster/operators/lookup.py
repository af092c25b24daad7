"""Point lookups in bulk (F5, F6): many keys at once, with a found / not_found outcome.

The requested keys drive a left join onto the table. No broadcast hint: the key
list may be as large as the table. When it is small AQE turns the join into a
broadcast of the keys' matches at runtime.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.schemas import PUBLIC


def multi_get(table: DataFrame, keys: DataFrame, key_col: str = "id",
              columns=None, probe_col: str | None = None) -> DataFrame:
    """One output row per requested key: the table row (public columns) or NULLs, plus outcome.

    ``keys`` holds the requested key in ``probe_col`` (default: ``key_col``) and any
    request columns to carry along. The table's key must be unique.
    """
    probe_col = probe_col or key_col
    columns = [c for c in (columns or table.columns) if c != key_col]
    t = table.select(F.col(key_col).alias("_key"), *columns)
    joined = keys.join(t, keys[probe_col] == t["_key"], "left")
    return joined.withColumn(
        "outcome", F.when(F.col("_key").isNotNull(), "found").otherwise("not_found")).drop("_key")


def multi_get_public(table: DataFrame, name: str, keys: DataFrame, key_col: str = "id",
                     probe_col: str | None = None) -> DataFrame:
    return multi_get(table, keys, key_col, [c for c in PUBLIC[name] if c != key_col], probe_col)
