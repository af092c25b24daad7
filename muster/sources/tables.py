"""Table scans.

``load_table`` reads a Parquet table and brings it to its declared columns: only those are
read, in order; stored instants become UTC wall-clock times without going through the
session's zone; other types are cast where they differ. Columns that need no change are passed
through, so projections and filters on them still reach the reader.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muster.functions.time import instant_to_utc_ntz
from muster.schemas import SCHEMAS


def table_path(root: str, name: str) -> str:
    single = os.path.join(root, f"{name}.parquet")
    return single if os.path.exists(single) or "://" in root else os.path.join(root, name)


def load_table(spark: SparkSession, root: str, name: str,
               schema: T.StructType | None = None) -> DataFrame:
    """Scan one Parquet table (a ``name.parquet`` file or directory under ``root``)."""
    df = spark.read.parquet(table_path(root, name))
    schema = SCHEMAS.get(name) if schema is None else schema
    return df if schema is None else df.select(*[declared(df, f) for f in schema.fields])


def declared(df: DataFrame, field: T.StructField) -> Column:
    """A column of ``df`` in its declared type."""
    have = df.schema[field.name].dataType
    if have == field.dataType:
        return F.col(field.name)
    if isinstance(have, T.TimestampType) and isinstance(field.dataType, T.TimestampNTZType):
        return instant_to_utc_ntz(F.col(field.name)).alias(field.name)
    return F.col(field.name).cast(field.dataType).alias(field.name)


def load_jdbc(spark: SparkSession, url: str, table: str, schema: T.StructType,
              properties: dict | None = None, partition_column: str | None = None,
              lower=None, upper=None, partitions: int | None = None,
              predicates: list[str] | None = None) -> DataFrame:
    """The same table through JDBC, read in parallel: either by ranges of ``partition_column``
    (``lower``, ``upper``, ``partitions``) or by one task per predicate. One of the two is required, as
    without them one task would read the whole table."""
    ranges = {"column": partition_column, "lowerBound": lower, "upperBound": upper,
              "numPartitions": partitions}
    if predicates is None and any(v is None for v in ranges.values()):
        raise ValueError("give predicates, or partition_column with lower, upper and partitions")
    cols = ", ".join(f.name for f in schema.fields)
    source = f"(SELECT {cols} FROM {table}) AS t"
    how = {"predicates": predicates} if predicates is not None else ranges
    df = spark.read.jdbc(url, source, properties=properties or {}, **how)
    return df.select(*[declared(df, f) for f in schema.fields])
