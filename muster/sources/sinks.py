"""Sinks: JSON rows and page envelopes (S6), snapshot writes.

JSON members follow the reference's output: NULL members are left out (``to_json``
drops NULL fields), an empty string in an ``omitempty`` text field is left out too,
hidden columns never appear (public projection), times are RFC 3339 in UTC at full precision,
decimals print in their shortest form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muster.functions.time import instant_to_utc_ntz
from muster.plans.specs import MAX_PAGE_SIZE
from muster.schemas import PUBLIC

# text columns tagged omitempty on plain strings: '' is dropped like NULL
OMIT_EMPTY = {"courses": ("description",)}


def rfc3339(col: Column, data_type) -> Column:
    """A UTC time with as many fraction digits as it has (none for whole seconds)."""
    utc = instant_to_utc_ntz(col) if isinstance(data_type, T.TimestampType) else col
    fraction = F.rtrim(F.date_format(utc, "SSSSSS"), F.lit("0"))
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("Z"))


def shortest_number(col: Column) -> Column:
    """A decimal as a JSON number without trailing zeros (2.0 prints as 2)."""
    text = col.cast("string")
    return F.parse_json(F.when(F.contains(text, F.lit(".")), F.rtrim(F.rtrim(text, F.lit("0")), F.lit(".")))
                        .otherwise(text))


def json_object(df: DataFrame, table: str, columns=None) -> Column:
    cols = list(columns or PUBLIC[table])
    empty = set(OMIT_EMPTY.get(table, ()))
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def member(c: str) -> Column:
        if c in empty:
            return F.nullif(F.col(c), F.lit(""))
        if isinstance(kinds[c], (T.TimestampType, T.TimestampNTZType)):
            return rfc3339(F.col(c), kinds[c])
        if isinstance(kinds[c], T.DecimalType):
            return shortest_number(F.col(c))
        return F.col(c)

    return F.to_json(F.struct(*[member(c).alias(c) for c in cols]))


def json_rows(df: DataFrame, table: str, name: str | None = None, columns=None,
              keep=("id",)) -> DataFrame:
    """One ``{"<name>": {...}}`` document per row."""
    name = name or table.rstrip("s")
    doc = F.concat(F.lit(f'{{"{name}":'), json_object(df, table, columns), F.lit("}"))
    return df.select(*keep, doc.alias("json"))


def json_page_envelope(page: DataFrame, metadata: DataFrame, table: str, order: list[Column],
                       columns=None) -> DataFrame:
    """``{"<table>": [rows...], "metadata": {...}}`` for one page (at most 100 rows).

    The rows are gathered with ``collect_list`` — bounded by the page size limit,
    never by the table — and put back in page order by an explicit position.
    """
    from pyspark.sql import Window
    pos = F.row_number().over(Window.orderBy(*order))
    rows = page.select(pos.alias("_pos"), json_object(page, table, columns).alias("_j"))
    arr = rows.agg(F.array_sort(F.collect_list(F.struct("_pos", "_j"))).alias("_a"))
    # a page is at most MAX_PAGE_SIZE rows; anything longer is not one and fails the job
    most = F.when(F.size("_a") > MAX_PAGE_SIZE, F.raise_error(F.lit("more rows than a page can hold")).cast("boolean"))
    body = arr.where(most.isNull()).select(F.concat_ws(",", F.transform("_a", lambda s: s["_j"])).alias("_rows"))
    meta = metadata.select(F.to_json(F.struct(*metadata.columns)).alias("_m")).scalar()
    return body.select(
        F.concat(F.lit(f'{{"{table}":['), F.col("_rows"), F.lit('],"metadata":'), meta,
                 F.lit("}")).alias("json"))


def write_snapshot(df: DataFrame, path: str, partition_by=None) -> None:
    """Write a table version to a new directory (never in place)."""
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
